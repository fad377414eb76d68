"""Operators against plain re-computations, and details of their contracts."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from evigraph.llm import cws, langid, mixing, pii, quality, queries, tokenfile

SF = "/root/testdata/sf0.01"

#: Lines the field never learned from.
HELD_OUT = """
please mail <email:jo (at) corp dot com> tonight
or <email:kim(at)example.org> instead
office line <phone:(303) 555-0182>
try <ip:8 . 8 . 4 . 4> as well
the box <ip:172(.)16(.)0(.)3> is up
contact <email:rita at example dot net> for it
we use <email:sam [at] corp [dot] io> here
her <phone:212-555-0107> is off
fax: <phone:(718) 555-0160>
on <phone:646 555 0119> after ten
Mobile <phone:07911 123456> please
gateway <ip:10[.]1[.]2[.]3> again
pay by <card:4111/1111/1111/1111>
my visa <card:4012.8888.8888.1881> expired
the card <card:5555_5555_5555_4444>, thanks
send to <email:max(at)mail.example.org>.
ask <email:zoe (at) bank dot de>
at <phone:(202) 555 0143> now
server <ip:203 . 0 . 113 . 77> answers
number is <phone:1-888-555-0175>
his ssn 123-45-6789 leaked
serial 123-4567 on the plate
the years 1914-1918-1939
case 020-7946-0958 was closed
they sold 3 dot com names, dot at the end
in 2019 about 12 of 40
version 4.18.0-305 of it
score 21-19, 15-21, 21-17
1 . 2 . 3 and 4
pages 101-118, vol 12
part 330-1182 was late
order 2020-11-05 shipped
isbn 978-0-306-40615-7 here
we look at 7 dot org sites
between 1 000 and 2 500
"""


@pytest.fixture(scope="module")
def field():
    return pii.train()


@pytest.fixture(scope="module")
def texts(spark):
    return [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(400).collect()]


def marked(table):
    for line in filter(None, table.split("\n")):
        plain, spans, at = "", set(), 0
        for m in re.finditer(r"<(\w+):([^>]*)>", line):
            plain += line[at : m.start()]
            spans.add((pii.KINDS.index(m[1]), len(plain), len(plain) + len(m[2])))
            plain += m[2]
            at = m.end()
        yield plain + line[at:], spans


def test_field_on_held_out_lines(field):
    hit = false = missed = 0
    for plain, spans in marked(HELD_OUT):
        assert plain not in pii.TABLE
        base = pii.base_spans(plain)
        got = {*base, *pii.added_spans(field, [plain], [base])[0]}
        hit, false, missed = hit + len(got & spans), false + len(got - spans), missed + len(spans - got)
    assert hit / (hit + false) >= 0.9 and hit / (hit + missed) >= 0.85


def test_stretches_lose_no_span_of_whole_lines(field, texts, monkeypatch):
    lines = [t for _, t, _ in texts] + [plain for plain, _ in marked(HELD_OUT)]
    base = [pii.base_spans(t) for t in lines]
    got = pii.added_spans(field, lines, base)
    monkeypatch.setattr(pii, "near", lambda shapes: np.ones(len(shapes), bool))
    monkeypatch.setattr(pii, "HELD", 500)
    assert pii.added_spans(field, lines, base) == got and any(got)


def test_personal_data_columns(spark, field, texts):
    rows = [(d, t) for d, t, _ in texts[:150]] + [(9000, None), (9001, "a@b.co 10.0.0.1 +1 (555) 010-0100 4111 1111 1111 1111")]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), field).collect()}
    for d, t in rows:
        base = sorted(pii.base_spans(t or ""))
        counts = Counter(k for k, _, _ in base)
        more = pii.added_spans(field, [t or ""], [base])[0]
        joined = lambda spans: ",".join(f"{pii.KINDS[k]}:{a}:{z}" for k, a, z in sorted(spans))
        r = got[d]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [counts[i] for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest() and r["spans"] == joined([*base, *more]) and r["n_added"] == len(more)


def test_a_very_long_line_is_decoded_in_parts(field):
    text = "words and more words " * 40_000 + "call (415) 555-0199 now " + "12 of them " * 20_000
    base = pii.base_spans(text)
    assert any(text[a:z] == "(415) 555-0199" for _, a, z in pii.added_spans(field, [text], [base])[0])


# ---------------------------------------------------------------- quality and language


def plain_statistics(text):
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(quality.NAMES)
    share = [sum(c in of for c in raw) / len(raw) for of in quality.CLASSES.values()]
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    if not words:
        return share + [0.0] * 8
    blanks, stops = sum(c in b" \t\n" for c in raw), sum(c in b".,;:" for c in raw)
    return share + [
        math.log1p(len(words)), (len(raw) - blanks) / len(words), len(set(words)) / len(words) ** 0.8, max(words.count(w) for w in set(words)) / len(words),
        sum(a == b for a, b in zip(words, words[1:])) / len(words), 1 - len(set(lines)) / len(lines) if lines else 0,
        math.log1p(len(words) / max(len(lines), 1)), math.log1p(len(words) / (1 + stops)),
    ]


def test_quality_equals_a_plain_computation(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    ranker = quality.learn(docs, labels.where(~quality.held_out()))
    rows = [(r["doc_id"], r["text"]) for r in docs.where("length(text) < 3000").orderBy("doc_id").limit(120).collect()] + [(9000, None), (9001, ""), (9002, " \n ")]
    for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string"), ranker).collect():
        stats = plain_statistics(dict(rows)[r["doc_id"]])
        raw, at = 0.0, 0
        for value, edges in zip(stats, ranker.edges):
            for edge in edges:
                raw += ranker.weights[at] * (value > edge)
                at += 1
        want = 1 / (1 + math.exp(-((raw - ranker.at) / ranker.scale + math.log(0.3 / 0.7))))
        assert abs(r["score"] - want) < 1e-9 and r["predicted"] == (want >= 0.3)


def test_rows_that_share_an_id_teach_once(spark):
    rows = [(1, f"text number {i}") for i in range(50)] + [(2, "BAD!!")]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality.learn(spark.createDataFrame(rows, "doc_id long, text string"), labels) is not None


def test_language_equals_a_plain_pass(texts):
    model = langid.train([t[:300] for _, t, _ in texts[:120]], [x for _, _, x in texts[:120]], steps=15)
    rows = [t for _, t, _ in texts[120:135] if t] + ["é", "ab" * 70]
    names, scores = langid.predict(model, rows, at_once=7)
    for text, name, score in zip(rows, names, scores):
        raw, total = text.encode(), 0.0
        for a in range(0, len(raw), langid.WINDOW):
            part = raw[a : a + langid.WINDOW].ljust(langid.WINDOW)
            states = {}
            for d, order in (("f", range(langid.WINDOW)), ("b", reversed(range(langid.WINDOW)))):
                h, x, u = np.zeros(langid.HIDDEN), model["x" + d].astype(float), model["u" + d].astype(float)
                for t in order:
                    a_, b_, n = x[part[t]], h @ u, langid.HIDDEN
                    soft = lambda v: v / (1 + np.abs(v))
                    z, r = 0.5 + 0.5 * soft(a_[:n] + b_[:n]), 0.5 + 0.5 * soft(a_[n : 2 * n] + b_[n : 2 * n])
                    h = z * h + (1 - z) * soft(a_[2 * n :] + r * b_[2 * n :])
                    states[d, t] = h
            for t in range(min(langid.WINDOW, len(raw) - a)):
                logit = states["f", t] @ model["wf"] + states["b", t] @ model["wb"] + model["c"]
                p = np.exp(logit - logit.max())
                total = total + p / p.sum()
        pooled = total / len(raw)
        assert abs(pooled.max() - score) < 2e-3 and (model["names"][int(pooled.argmax())] == name or np.sort(pooled)[-2] > pooled.max() - 2e-3)


def test_letters_are_of_category_l(texts):
    model = langid.train([t[:100] for _, t, _ in texts[:40]], [x for _, _, x in texts[:40]], steps=3)
    names, scores = langid.predict(model, ["\u00b2", "\u00bd \u00b3", "\u2167 12", "\u00bd a", "\u6f22", None])
    assert names[:3] == ["und"] * 3 and scores[:3] == [0.0] * 3 and names[5] == "und"
    assert names[3] != "und" and names[4] != "und"


# ---------------------------------------------------------------- fingerprints, token files, mixes


def test_white_space_beyond_ascii_is_a_term(spark):
    assert cws.signatures(["\u00a0"]).any() and not cws.signatures([" \t\n", ""]).any()
    rows = [(3, "\u00a0"), (2, ""), (1, " \n")]
    got = {r["doc_id"]: r for r in cws.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[3]["near_next"] == 0.0 and got[2]["near_next"] == 1.0 and set(got[2]["fingerprint"]) == {"0"}


def test_long_texts_are_sampled_in_blocks(texts, monkeypatch):
    long = " ".join(f"w{i} " * (1 + i % 3) for i in range(3000))
    rows = [t for _, t, _ in texts[:40]] + [long] + [t for _, t, _ in texts[40:60]]
    whole = cws.signatures(rows)
    monkeypatch.setattr(cws, "BLOCK", 64)
    assert (cws.signatures(rows) == whole).all()
    assert (np.concatenate([cws.signatures([t]) for t in rows]) == whole).all()


def test_token_files_ignore_a_limit_of_records(spark, texts, tmp_path):
    rows = [(d % 40, t) for d, t, _ in texts[:80]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 2)
    try:
        tokenfile.write(docs, queries.tokenizer_path(), f"file://{tmp_path}/t")
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    got = sorted(tokenfile.starts(spark, f"file://{tmp_path}/t").collect(), key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in got] == sorted(d for d, _ in rows)


def test_mixed_rows_come_in_the_order_of_slots(spark):
    rows = [(i, f"{'abc'[i % 3]} " + "word " * (5 + i % 9), "abc"[i % 3]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    got = [[r["source"] for r in part] for part in mixing.mixed(docs).rdd.glom().collect() if part]
    for part in got:
        want = Counter(part)
        for at in range(100, len(part), 100):  # every stretch has the sources' shares
            seen = Counter(part[:at])
            assert all(abs(seen[s] / at - want[s] / len(part)) < 0.12 for s in want)
    assert max(map(len, got)) > 200


def test_repeated_rows_share_their_slots(spark):
    rows = [(1, "one two three", "a")] * 4 + [(2, "four five", "b")] * 3 + [(None, "six", "b"), (None, "ten", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = sum(r["taken"] for r in mixing.taken(docs).collect())
    words = sum(len(r["text"].split()) for r in mixing.mixed(docs).collect())
    assert abs(words - taken) <= 3 * 2
