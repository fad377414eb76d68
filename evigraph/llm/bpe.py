"""BPE encoding and decoding by per-prefix dynamic programming (operator 8).

A word's encoding is found left to right.  For every prefix exactly one token can
come last in the prefix's own encoding: the one among the vocabulary entries ending
there (an Aho-Corasick automaton over the vocabulary, whose suffix links list them)
that starts at 0 or is compatible with the last token of the shorter prefix.  Two
tokens are compatible when no merge across their border would have happened before
the merges that made them; that is decided by undoing merges on either side of the
border.  Back-pointers from the whole word's last token give the exact ids.

Words come from the tokenizer's own normaliser and splitting rule.  Results are
remembered per worker for words and white-space-delimited pieces; both memories are
emptied when full, so memory is bounded and results do not change.  Where only ids are
wanted, smaller memories of ids alone are kept: workers outlive a stage, and what they
hold stays in the executor's memory while later stages run.

Nulls and empty texts have no ids; repeated rows are encoded each by itself; other
columns of the input, whatever their names, are ignored by the digest query.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, slices, worker_cache

PIECES, FITS = 300_000, 1_000_000
FEW_PIECES, FEW_FITS = 200_000, 200_000  # where only ids are kept
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"
END = "\x00"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = [""] * 256, 0
    for b in range(256):
        if b in kept:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + n)
            n += 1
    return out


def cut_pieces(text: str) -> list[str]:
    """A text's pieces between white space, which no token crosses.

    Python also splits at four control characters that the tokenizer doesn't call white space; texts with any of
    them are cut at spaces and line feeds only.
    """
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return [p for p in text.replace("\n", " ").split(" ") if p]
    return text.split()


class Pieces(dict):
    """What each piece without white space is encoded to, in two generations: a full one
    becomes the old one, from which pieces still in use are taken over.

    Where a piece is letters and then punctuation, only the lower-cased letters are
    encoded, by ``word``: splitting such a piece there, and lower-casing it, changes
    nothing for a tokenizer that lower-cases and keeps letters and punctuation apart.
    ``general`` encodes any other piece.
    """

    def __init__(self, general, word, join, room: int = PIECES):
        super().__init__()
        self.general, self.word, self.join, self.room = general, word, join, room
        self.old: dict = {}

    def __missing__(self, piece: str):
        got = self.old.get(piece)
        if got is None:
            head = piece.rstrip(MARKS)
            low = head.lower()
            if (
                head
                and len(head) < 40
                and low.isalpha()
                and (low.isascii() or (head.isalpha() and "\u03a3" not in head and unicodedata.is_normalized("NFC", head)))
            ):
                if low == piece:
                    got = self.word(low)
                else:
                    got = self[low] if len(head) == len(piece) else self.join(self[low], self[piece[len(head) :]])
            else:
                got = self.general(piece)
        if len(piece) < 48:
            if len(self) >= self.room:
                self.old = dict(self)
                self.clear()
            self[piece] = got
        return got


def _joined(a: tuple, b: tuple) -> tuple:
    return a[0] + b" " + b[0], a[1] + b" " + b[1], a[2] + b[2]


class Bpe:
    """Encoder and decoder of a byte-level BPE vocabulary with word-end suffixes, from its tokenizer file."""

    def __init__(self, spec: str, room: int = PIECES, fits_room: int = FITS):
        import ahocorasick
        import regex

        j = json.loads(spec)
        model = j["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.symbols = byte_symbols()
        self.byte_of = {s: b for b, s in enumerate(self.symbols)}
        self.text_of = {i: t for t, i in vocab.items()}
        self.added = [(t["content"], t["id"]) for t in j["added_tokens"]]
        self.text_of.update({i: t for t, i in self.added})
        pattern = next(p for p in j["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.word = regex.compile(pattern)
        self.space = regex.compile(r"\s+")
        self.split_added = regex.compile("(" + "|".join(regex.escape(t) for t, _ in self.added) + ")") if self.added else None
        self.added_id = dict(self.added)
        self.pair: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ", 1)
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.pair[x, y] = r
            if z not in self.parts:
                self.parts[z], self.rank[z] = (x, y), r
        self.made = {p: vocab[self.text_of[p[0]] + self.text_of[p[1]]] for p in self.pair}
        table = ahocorasick.Automaton()
        for t, i in vocab.items():
            if i in self.parts or len(self._bare(t)) == 1:
                # only tokens that merging can reach: single symbols and merge results
                key = (self._bare(t) + END) if self._ends(t) else t
                table.add_word(key, (i, len(key)))
        table.make_automaton()
        self.table = table
        self.fits: dict[tuple[int, int], bool] = {}
        self.fits_room = fits_room
        self.pieces = Pieces(self._piece, self._word, _joined, room)
        self.packed = Pieces(self._packed_piece, self._packed_word, bytes.__add__, room)

    @cached_property
    def number(self) -> dict[int, bytes]:
        return {i: str(i).encode() for i in self.text_of}

    @cached_property
    def token(self) -> dict[int, bytes]:
        return {i: t.encode() for i, t in self.text_of.items()}

    def _rendered(self, ids: list[int]) -> tuple[bytes, bytes, bytes]:
        number, token = self.number, self.token
        return b" ".join([number[i] for i in ids]), b" ".join([token[i] for i in ids]), array("i", ids).tobytes()

    def _piece(self, text: str) -> tuple[bytes, bytes, bytes]:
        return self._rendered(self.ids_of(text))

    def _word(self, text: str) -> tuple[bytes, bytes, bytes]:
        return self._rendered(self._word_ids(text))

    def _word_ids(self, text: str) -> list[int]:
        if not text.isascii():
            symbols = self.symbols
            text = "".join([symbols[b] for b in text.encode()])
        return self.encode_word(text)

    def _packed_piece(self, text: str) -> bytes:
        return array("i", self.ids_of(text)).tobytes()

    def _packed_word(self, text: str) -> bytes:
        return array("i", self._word_ids(text)).tobytes()

    def _ends(self, token: str) -> bool:
        return bool(self.suffix) and token.endswith(self.suffix) and token != self.suffix

    def _bare(self, token: str) -> str:
        return token[: -len(self.suffix)] if self._ends(token) else token

    def compatible(self, left: int, right: int) -> bool:
        """Would ``left`` and ``right`` stay apart where they meet?"""
        limit = 1 << 60  # merges from this rank on happen after the border's sides were complete
        pair, rank, parts = self.pair, self.rank, self.parts
        while True:
            r = pair.get((left, right))
            if r is not None and r < limit:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                # a merge between equal ranks would be taken from the left, so the left part counts itself out
                limit, left = a, parts[left][1]
            else:
                limit, right = b + 1, parts[right][0]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-split word given in byte stand-ins."""
        text = word + END
        n = len(text)
        last = [-1] * n
        size = [0] * n
        fits = self.fits
        done = -1
        for at, (token, length) in self.table.iter(text):
            if at == done:
                continue
            before = at - length
            if before >= 0:
                prior = last[before]
                if prior < 0:
                    continue
                ok = fits.get((prior, token))
                if ok is None:
                    if len(fits) >= self.fits_room:
                        fits.clear()
                    ok = fits[prior, token] = self.compatible(prior, token)
                if not ok:
                    continue
            last[at] = token
            size[at] = length
            done = at
        out, at = [], n - 1
        while at >= 0:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def split(self, text: str) -> list[str]:
        """Normalise a piece without added tokens and split it into words, in byte stand-ins."""
        text = self.space.sub(" ", unicodedata.normalize("NFC", text))
        text = "".join(_lower(c) for c in text) if not text.isascii() else text.lower()
        symbols = self.symbols
        found = self.word.findall(text)
        return [w if w.isascii() and w.isprintable() else "".join([symbols[b] for b in w.encode()]) for w in found]

    def ids_of(self, text: str) -> list[int]:
        """Ids of a piece of text of any kind."""
        ids: list[int] = []
        for part in self.split_added.split(text) if self.split_added and "<|" in text else [text]:
            if part in self.added_id:
                ids.append(self.added_id[part])
            else:
                for w in self.split(part):
                    ids.extend(self.encode_word(w))
        return ids

    def pieces_of(self, text: str) -> list[tuple]:
        """(ids as decimal text, decoded text, ids as 32-bit numbers) of each piece, in order."""
        known = self.pieces
        return [known[p] for p in cut_pieces(text)]

    def packed_of(self, text: str) -> bytes:
        """A text's ids as 32-bit numbers; of its pieces nothing else is kept."""
        known = self.packed
        return b"".join([known[p] for p in cut_pieces(text)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join([p[2] for p in self.pieces_of(text)]), "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        """As the library without a decoder: the tokens joined by single spaces."""
        return " ".join(self.text_of[i] for i in ids)


def _lower(c: str) -> str:
    # character by character, as the library does: no final-sigma rule
    return c.lower()


def load(spec: str, key: str = "bpe", **rooms: int) -> Bpe:
    """The worker's encoder for a tokenizer file's content."""
    kept = worker_cache(key)
    mark = hash(spec)
    if kept.get("mark") != mark:
        kept["bpe"], kept["mark"] = Bpe(spec, **rooms), mark
    return kept["bpe"]


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_tokens, ids array<int>)``; a null text has no ids."""
    shared = docs.sparkSession.sparkContext.broadcast(read_spec(path))

    def run(batches):
        bpe = load(shared.value, "bpe_ids", room=FEW_PIECES, fits_room=FEW_FITS)
        for whole in batches:
            for b in slices(whole, 1000, 2 << 20):
                rows = [bpe.packed_of(t.as_py() or "") for t in b.column("text")]
                ends = np.cumsum([0, *(len(r) // 4 for r in rows)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), "<i4")))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").cast(pa.int64()), pa.array(np.diff(ends), pa.int64()), ids],
                    names=["doc_id", "n_tokens", "ids"],
                )

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded(doc_id, ids)`` to ``(doc_id, text)``: each list of ids decoded; null ids give ''."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_spec(path))

    def run(batches):
        bpe = load(shared.value)
        for b in batches:
            texts = [bpe.decode(i.as_py() or []) for i in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of ``docs(doc_id, text)``, without keeping the ids."""
    shared = docs.sparkSession.sparkContext.broadcast(read_spec(path))

    def run(batches):
        bpe = load(shared.value)
        for b in (part for whole in batches for part in slices(whole, 1000, 2 << 20)):
            counts, of_ids, of_text = [], [], []
            for t in b.column("text"):
                got = bpe.pieces_of(t.as_py() or "")
                a, d, _ = zip(*got) if got else ((), (), ())
                ids, text = b" ".join(a), b" ".join(d)
                if b"" in a:  # a piece of white space only has no ids
                    ids, text = b" ".join(filter(None, a)), b" ".join(filter(None, d))
                counts.append(ids.count(b" ") + 1 if ids else 0)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").cast(pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array(of_ids, pa.string()),
                    pa.array(of_text, pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return map_arrow(
        docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
