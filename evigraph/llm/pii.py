"""Personal data by patterns and a linear-chain conditional random field (operator 1).

Base spans come from four patterns (email, ip, card, phone), each leftmost and not
overlapping within its kind, each checked (parts of an address at most 255, Luhn and 13
to 19 digits of a card, 9 to 15 digits of a phone number); a failing match is dropped.

The field adds spans in notations the patterns don't read: numbers without a country
code, addresses spelt with "dot" or brackets, cards cut by other marks.  It labels tokens (runs
of letters, runs of digits, single marks) with O or the first or further token of a kind,
from the shapes of a token and of three on either side.  A token with no digit, at-sign or
"dot" within six tokens is O by definition, so only stretches around those are decoded,
by Viterbi over padded numpy batches of stretches; tokens never reach over a line's end.
It learns from the small labelled table below by gradient ascent on the log-likelihood.
A span it proposes must hold what its kind holds (digits of a number, Luhn, a dot and an at)
and must not touch a base span.

What it proposes holds a digit, an at-sign or a "dot", and first-order chains pass nothing but O between stretches, so
stretches lose no span of a whole line's decoding (the tests compare the two).

Offsets are code points, ends exclusive.  Null texts are empty.  Rows stand alone: repeated ids
and texts get equal results.  Texts of any length are read whole; other columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, slices, worker_cache

KINDS = ("email", "ip", "card", "phone")
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
REACH, SPAN = 3, 6
HELD = 100_000  # tokens decoded at once, but for longer stretches

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[^0-9]")
LOCALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCALS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in order of kind, then start."""
    out = [(0, a, z) for a, z in _emails(text)]
    if not any(c in text for c in "0123456789"):
        return out
    if "." in text:
        # parts are compared as text: int() refuses numbers of thousands of digits
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = DIGITS.sub("", m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGITS.sub("", m[0])) <= 15]
    return out


# ---------------------------------------------------------------- the field

#: Labelled lines: <kind:...> marks a span; what is not marked is O.
TABLE = """
Call me on <phone:(017) 555-7713> before noon.
call <phone:017 555 7713> or write
Phone: <phone:555-123-4567> ask for Ann
tel. <phone:020 7946 0958>, thanks
Tel <phone:(212) 555-0199>
fax <phone:(0)30 901820> for papers
my number is <phone:415-555-2671>.
reach us at <phone:1-800-555-0142> any day
mobile <phone:07700 900123> after six
the desk, <phone:(487) 555-7209> is open
Number <phone:(377) 555-0271> is hers
Call us at <phone:(415) 555-2671> today
at <phone:(206) 555-0100> they answer
or <phone:974.555.3436> in the evening
<phone:(132) 555-1352> rings
at <phone:243-555-5526> you can
write to <email:ann dot lee at mail dot example dot com> soon
mail <email:joe at example dot org>.
<email:sue [at] example [dot] com> answers
contact <email:max (at) mail (dot) example (dot) net> today
Send it to <email:lee@mail dot example dot com> please
her address <email:kim @ example.com> is new
ask <email:jan at host dot de> about it
<email:a.b (at) example.com> and others
host <ip:10[.]0[.]0[.]1> is down
from <ip:192[.]168[.]17[.]4> it came
server <ip:172 . 16 . 254 . 1> replied
<ip:97(.)51(.)17(.)173> was seen
gate <ip:83 . 229 . 25 . 121>, then
card <card:4111.1111.1111.1111> exp
pay with <card:4012/8888/8888/1881> now
<card:5500_0000_0000_0004> is the number
card no. <card:3782.822463.10005> please
my card: <card:6011/1111/1111/1117>.
the 3 of them and 14 more
in 2024 there were 1500 of these
version 3.11.2 came after 3.9
at 12:30 on 5 May 2023 they met
It cost 19.99 or 20 at most, not 1,250.00
pages 117-129 and 131
ISO 9001, RFC 3339, and so on
2024-01-05 12:00:01 was the time
room 101, floor 3, 5th street 12
token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" was there
sha 9b0b3c6a43eb78aa99cbd7049c572391524f37a8 of it
id 2641 and id 99812 were left
100% of 50 or 7/8 of it
a dot and a dash are 2 marks
the dot at the end of 1 line
put a dot there, not here
follow @ann and @joe99 there
score 3-2, then 4-1 and 10-12
chapter 4.2.1 and 4.2.1.7 of part 2
order 550123 of 12.03.2021 for 3 x 5 boxes
2669109448945250 of these and 908038 more
1. one 2. two 3. three
a1 b2 c3 and x86 or mp3
from 1990 - 1995 and 2001 - 2010
between 10 000 and 20 000 people
the ratio 16:9 and 4:3 on 27 inch
7 8 9 10 11 12 13
0.5 + 0.25 = 0.75
numbers (1) and (2) and (12) follow
about 300 km, 40 kg, 1000 m
55 said so. 12 did not. 1999 was it
tt 0 1 0 1 1 0
line 12, column 40, error 404
+1 and -1 and +20
$5,000 to $12,500 in 30 days
S. 12-15; Vol. 33; No. 4
ssn 078-05-1120 is no phone
number 219-09-9999 in the file
serial 445-7712 of the pump
part 881-2043, bin 3
no. 204-8813 in stock
the wars of 1914-1918 and 1939-1945
1789-1799-1815 were years
years 1848-1871-1914 in one row
case 020-1187-0045 was heard
file 030-2219-8871 is shut
docket 118-0042-7755 of may
ref 555-0199-2210 in the log
invoice 2019-0045-118 is paid
isbn 978-3-16-148410-0 on the back
they dot at 3 dot com lines
2 dot com firms failed
the dot com boom of 1999
look at 5 dot plots
meet at 3 dot matrix printers
mail <email:ana (at) firm dot org> first
from <email:bo(at)example.net> today
reach <email:tom(at)host.org>.
<email:lia(at)mail.example.com> wrote
at <email:eve at work dot co dot uk> or here
write <email:pat [at] site [dot] org> now
mail <email:ron (at) shop dot com>
it is <email:una (at) lab dot edu>, she said
phone <phone:(404) 555-0123>
<phone:(512) 555-0177> is the office
or <phone:(617) 555-0146>.
dial <phone:(708) 555 0134> for help
ring <phone:(808) 555.0155> or come
office <phone:(909) 555-0161>, home <phone:(909) 555-0162>
text <phone:310-555-0188> or <phone:310.555.0189>
her cell is <phone:720 555 0111>
dns <ip:9 . 9 . 9 . 9> first
use <ip:1 . 1 . 1 . 1>, please
resolver <ip:4 . 2 . 2 . 2> failed
node <ip:10(.)20(.)30(.)40> left
at <ip:192(.)0(.)2(.)7> now
<ip:203(.)0(.)113(.)9> is blocked
peer <ip:198[.]51[.]100[.]23>
ping <ip:127 . 0 . 0 . 1>
chapter 1 . 2 . 3 and more
and <email:kay(at)sample.org> too
you may mail <email:ned (at) club dot net> soon
Write to <email:ola(at)post.example.net>.
or <email:per (at) town dot org> in spring
see <email:gus(at)farm.com> about hay
then <email:liv (at) port dot com> today
Mobile <phone:07700 900456> today
mobile: <phone:07911 654321>
Mobile <phone:07400 123987> or later
toll free <phone:1-877-555-0133>
line <phone:1-866-555-0121> is
the card <card:5105_1051_0510_5100>, then
her card <card:4000_0566_5566_5556>, please
card <card:4222.2222.2222.2> ended
with <card:3530/1113/3330/0000> paid
<card:6304_0000_0000_0000> was used
"""

TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s\w]|\w")
KEPT = set("@.-+()[]/:,_%=$\"")


def _shape(token: str) -> str:
    c = token[0]
    if "0" <= c <= "9":
        n = len(token)
        return f"d{n}" if n <= 6 else "d7-12" if n < 13 else "d13-19" if n < 20 else "d20"
    if c.isalpha():
        low = token.lower()
        return low if low in ("dot", "at") else "w" if token == low else "W"
    return c if c in KEPT else "p"


SHAPES = ["<", "w", "W", "p", "at", "dot", *sorted(KEPT), *(f"d{i}" for i in range(1, 7)), "d7-12", "d13-19", "d20"]
NUMBER = {s + g: i * 2 + j for i, s in enumerate(SHAPES) for j, g in enumerate((" ", ""))}
TRIGGER = np.zeros(len(NUMBER), bool)
for _s, _i in NUMBER.items():
    TRIGGER[_i] = _s[0] == "d" and _s[1] != "o" or _s[:3] == "dot" or _s[0] == "@"


def tokens(line: str) -> tuple[list[int], list[int], np.ndarray]:
    """Starts, ends and shapes (with whether white space stands before) of a line's tokens."""
    starts, ends, shapes, last = [], [], [], -1
    for m in TOKEN.finditer(line):
        a, z = m.span()
        shapes.append(NUMBER[_shape(m[0]) + ("" if a == last else " ")])
        starts.append(a)
        ends.append(z)
        last = z
    return starts, ends, np.array(shapes, np.int64)


def near(shapes: np.ndarray) -> np.ndarray:
    """Tokens with a trigger within reach."""
    hit = TRIGGER[shapes]
    out = hit.copy()
    for k in range(1, SPAN + 1):
        out[k:] |= hit[:-k]
        out[:-k] |= hit[k:]
    return out


class Field:
    """Weights of shapes by offset, of neighbouring shape pairs, and of label pairs."""

    def __init__(self):
        n, k = len(NUMBER), len(LABELS)
        self.one = np.zeros((2 * REACH + 1, n, k))
        self.two = np.zeros((n * n, k))
        self.move = np.zeros((k + 1, k))  # last row: from the start
        self.free = np.ones((k + 1, k), bool)
        for a in range(k + 1):
            for b, name in enumerate(LABELS):
                if name[0] == "I":
                    self.free[a, b] = a < k and LABELS[a][1:] == name[1:]
        self.free[:, 0] = True

    def emissions(self, shapes: np.ndarray, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Emissions of the tokens from ``start`` to ``stop`` of a line."""
        stop = len(shapes) if stop is None else stop
        low, high = max(0, start - REACH), min(len(shapes), stop + REACH)
        padded = np.concatenate([np.zeros(REACH - (start - low), np.int64), shapes[low:high], np.zeros(REACH - (high - stop), np.int64)])
        n = stop - start
        out = sum(self.one[k, padded[k : k + n]] for k in range(2 * REACH + 1))
        return out + self.two[self.pairs(padded, n)] + self.two[self.pairs(padded, n, -1)]

    @staticmethod
    def pairs(padded, n, step=0):
        a = REACH + step
        return padded[a : a + n] * len(NUMBER) + padded[a + 1 : a + 1 + n]

    def moves(self) -> np.ndarray:
        return np.where(self.free, self.move, -1e9)

    def decode(self, stretches: list[np.ndarray], cells: int = 1 << 20) -> list[np.ndarray]:
        """Best labels of each stretch's emissions, followed by O, in padded batches of like lengths."""
        out: list = [None] * len(stretches)
        order = sorted(range(len(stretches)), key=lambda i: len(stretches[i]))
        move = self.moves()
        k = len(LABELS)
        at = 0
        while at < len(order):
            take, longest = 1, len(stretches[order[at]])
            while at + take < len(order) and (take + 1) * len(stretches[order[at + take]]) * k <= cells:
                longest = len(stretches[order[at + take]])
                take += 1
            ids = order[at : at + take]
            at += take
            longest = max(len(stretches[i]) for i in ids) + 1  # one O at least follows every stretch
            e = np.zeros((len(ids), longest, k))
            size = np.array([len(stretches[i]) for i in ids])
            for r, i in enumerate(ids):
                e[r, : len(stretches[i])] = stretches[i]
                e[r, len(stretches[i]) :, 1:] = -1e9  # padding is O
            best = np.empty((longest, len(ids), k), np.int8)
            score = move[k] + e[:, 0]
            for t in range(1, longest):
                options = score[:, :, None] + move[None, :k]
                best[t] = options.argmax(1)
                score = options.max(1) + e[:, t]
            label = score.argmax(1)
            path = np.empty((longest, len(ids)), np.int8)
            for t in range(longest - 1, -1, -1):
                path[t] = label
                if t:
                    label = best[t][np.arange(len(ids)), label]
            for r, i in enumerate(ids):
                out[i] = path[: size[r], r]
        return out


def _log_sum(x, axis):
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def labelled(table: str = TABLE) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(shapes, labels, near) of each line of a table with marked spans."""
    rows = []
    for line in filter(None, table.split("\n")):
        plain, spans, at = "", [], 0
        for m in re.finditer(r"<(\w+):([^>]*)>", line):
            plain += line[at : m.start()]
            spans.append((m[1], len(plain), len(plain) + len(m[2])))
            plain += m[2]
            at = m.end()
        plain += line[at:]
        starts, ends, shapes = tokens(plain)
        y = np.zeros(len(starts), np.int64)
        for kind, a, z in spans:
            inside = [i for i, s in enumerate(starts) if a <= s < z]
            for j, i in enumerate(inside):
                y[i] = LABELS.index(("I" if j else "B") + "-" + kind)
        rows.append((shapes, y, near(shapes)))
    return rows


def train(table: str = TABLE, steps: int = 220, rate: float = 0.15, decay: float = 0.0004) -> Field:
    """Ascend the log-likelihood of the labelled lines; deterministic."""
    field = Field()
    rows = labelled(table)
    k, longest = len(LABELS), max(len(r[0]) for r in rows)
    n = len(rows)
    shapes = np.zeros((n, longest + 2 * REACH), np.int64)
    y = np.zeros((n, longest), np.int64)
    real = np.zeros((n, longest), bool)
    far = np.ones((n, longest), bool)
    for i, (s, lab, close) in enumerate(rows):
        shapes[i, REACH : REACH + len(s)] = s
        y[i, : len(s)] = lab
        real[i, : len(s)] = True
        far[i, : len(s)] = ~close
    width = len(NUMBER)
    pair_at = [shapes[:, REACH + d : REACH + d + longest] * width + shapes[:, REACH + d + 1 : REACH + d + 1 + longest] for d in (0, -1)]
    params = [field.one, field.two, field.move]
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    gold = np.eye(k)[y]
    y_before = np.concatenate([np.full((n, 1), k), y[:, :-1]], 1)
    for step in range(1, steps + 1):
        e = sum(field.one[j, shapes[:, j : j + longest]] for j in range(2 * REACH + 1)) + sum(field.two[p] for p in pair_at)
        e[far, 1:] = -1e9
        move = field.moves()
        ahead = np.empty((n, longest, k))
        ahead[:, 0] = move[k] + e[:, 0]
        for t in range(1, longest):
            ahead[:, t] = _log_sum(ahead[:, t - 1, :, None] + move[None, :k], 1) + e[:, t]
        back = np.zeros((n, longest, k))
        for t in range(longest - 2, -1, -1):
            back[:, t] = _log_sum(move[None, :k] + (e[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        whole = _log_sum(ahead[:, -1], 1)
        p = np.exp(ahead + back - whole[:, None, None])
        diff = (gold - p) * real[:, :, None]
        diff[far] = 0
        g_one, g_two, g_move = np.zeros_like(field.one), np.zeros_like(field.two), np.zeros_like(field.move)
        flat = diff.reshape(-1, k)
        for j in range(2 * REACH + 1):
            np.add.at(g_one[j], shapes[:, j : j + longest].ravel(), flat)
        for q in pair_at:
            np.add.at(g_two, q.ravel(), flat)
        for t in range(1, longest):
            both = ahead[:, t - 1, :, None] + move[None, :k] + (e[:, t] + back[:, t])[:, None, :] - whole[:, None, None]
            g_move[:k] -= (np.exp(both) * real[:, t, None, None]).sum(0)
        g_move[k] -= p[:, 0].sum(0)
        np.add.at(g_move, (y_before[real], y[real]), 1)
        for v, g, (m, s) in zip(params, (g_one, g_two, g_move), moment):
            g -= decay * n * v
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v += rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return field


AT = re.compile(r"\s*[\[(]\s*at\s*[\])]\s*|\s+at\s+|\s*@\s*")
DOT = re.compile(r"\s*[\[(]\s*dot\s*[\])]\s*|\s+dot\s+|\s*\.\s*")
ADDRESS = re.compile(r"[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}")


def _holds(kind: int, text: str) -> bool:
    """Does a proposed span hold what its kind must?"""
    digits = DIGITS.sub("", text)
    if kind == 0:
        plain = DOT.sub(".", AT.sub("@", text.lower()))
        return ADDRESS.fullmatch(plain) is not None
    if kind == 1:
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15


HAS = re.compile(r"[0-9@]|[Dd][Oo][Tt]")


def added_spans(field: Field, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """Spans the field proposes for each text, beside its base spans."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    stretches, where, held = [], [], 0
    for n, text in enumerate(texts):
        at = 0
        while (m := HAS.search(text, at)) is not None:
            a = text.rfind("\n", 0, m.start()) + 1
            z = text.find("\n", m.end())
            z = len(text) if z < 0 else z
            starts, ends, shapes = tokens(text[a:z])
            close = np.flatnonzero(near(shapes)) if len(shapes) else []
            if len(close):
                for part in np.split(close, np.flatnonzero(np.diff(close) > 1) + 1):
                    first, last = int(part[0]), int(part[-1]) + 1
                    stretches.append(field.emissions(shapes, first, last))
                    where.append((n, a, starts[first:last], ends[first:last]))
                    held += last - first
                    if held > HELD:
                        _propose(field, stretches, where, texts, base, out)
                        stretches, where, held = [], [], 0
            at = z
    _propose(field, stretches, where, texts, base, out)
    return out


def _propose(field: Field, stretches, where, texts, base, out) -> None:
    """Decode stretches and add the spans that hold what their kind must."""
    for labels, (n, a, starts, ends) in zip(field.decode(stretches), where):
        i = 0
        while i < len(labels):
            if labels[i] % 2 == 1:  # the first token of a span
                j = i + 1
                while j < len(labels) and labels[j] == labels[i] + 1:
                    j += 1
                kind = (labels[i] - 1) // 2
                s, t = a + starts[i], a + ends[j - 1]
                if _holds(kind, texts[n][s:t]) and not any(s < z and b < t for _, b, z in base[n]):
                    out[n].append((int(kind), s, t))
                i = j
            else:
                i += 1


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for k, a, z in sorted(spans))


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs(doc_id, text)`` to counts of base spans by kind, their digest, all spans, and how many the field added."""
    field = field or train()
    shared = docs.sparkSession.sparkContext.broadcast((field.one, field.two, field.move))

    def run(batches):
        own = worker_cache("pii")
        if own.get("of") is not shared.value:
            own["field"] = Field()
            own["field"].one, own["field"].two, own["field"].move = own["of"] = shared.value
        model = own["field"]
        for whole in batches:
            for b in slices(whole, 1000, 4 << 20):
                texts = [t or "" for t in b.column("text").to_pylist()]
                base = [base_spans(t) for t in texts]
                more = added_spans(model, texts, base)
                counts = np.zeros((len(texts), 4), np.int64)
                for i, spans in enumerate(base):
                    for k, _, _ in spans:
                        counts[i, k] += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").cast(pa.int64()),
                        *(pa.array(counts[:, k]) for k in range(4)),
                        pa.array([hashlib.sha256(_joined(s).encode()).hexdigest() for s in base], pa.string()),
                        pa.array([_joined([*s, *m]) for s, m in zip(base, more)], pa.string()),
                        pa.array([len(m) for m in more], pa.int64()),
                    ],
                    names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
                )

    return map_arrow(
        docs.select("doc_id", "text"), run,
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long",
    )
