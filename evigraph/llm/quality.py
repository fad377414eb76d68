"""Document quality by Bradley-Terry ranking (operator 2).

A document's raw score is linear in step features of its text's character and word
statistics.  The weights come from preference pairs (a document of label 1 over one of
label 0) by the logistic loss on the difference of their features.  The threshold is the
quantile of the learned documents' raw scores that their share of label 0 names, placed
between the two scores next to it; scores are a sigmoid of the raw score about it, so that
``CUT`` is met exactly there.

Learning takes a bounded sample of labelled rows (``rows`` in all, chosen by hash of the
id); scoring reads every whole text and nothing else.  Null and empty texts score as an empty
text does.  With no labels, or labels of one kind, every score is 0.5.  Repeated rows score alike, rows that share
an id by their own texts.  Texts of any length are read whole, an empty table gives no rows, and columns other than doc_id
and text aren't read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, hash_share, map_arrow, slices

CUT = 0.3
STEPS = 8
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "bang": b"!?",
    "mark": b"#$%&*@^~=+<>{}[]\\/_",
    "pipe": b"|",
    "stop": b".,;:",
    "space": b" \t",
    "line": b"\n",
}
TABLE = np.zeros((256, len(CLASSES)))
for _i, _c in enumerate(CLASSES.values()):
    TABLE[list(_c), _i] = 1
NAMES = [*CLASSES, "length", "word", "distinct", "top", "again", "lines_again", "words_a_line", "words_a_stop"]


def statistics(text: str | None) -> np.ndarray:
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    out = np.zeros(len(NAMES))
    if not n:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    by_class = counts @ TABLE
    out[: len(CLASSES)] = by_class / n
    words = raw.split()
    w = len(words)
    lines = [x for x in raw.split(b"\n") if x]
    if w:
        seen = Counter(words)
        out[len(CLASSES) :] = (
            math.log1p(w),
            (n - by_class[6] - by_class[7]) / w,
            len(seen) / w**0.8,
            max(seen.values()) / w,
            sum(map(bytes.__eq__, words, words[1:])) / w,
            1 - len(set(lines)) / len(lines) if lines else 0,
            math.log1p(w / max(len(lines), 1)),
            math.log1p(w / (1 + by_class[5])),
        )
    return out


class Ranker:
    """Edges of the step features, their weights, and the threshold with its scale."""

    def __init__(self, edges: np.ndarray, weights: np.ndarray, at: float, scale: float):
        self.edges, self.weights, self.at, self.scale = edges, weights, at, scale

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return steps(stats, self.edges) @ self.weights

    def scores(self, stats: np.ndarray) -> np.ndarray:
        z = (self.raw(stats) - self.at) / self.scale + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def steps(stats: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For each statistic, which of its edges it exceeds."""
    return (stats[:, :, None] > edges[None]).reshape(len(stats), -1).astype(np.float64)


def fit(stats: np.ndarray, labels: np.ndarray, pairs: int = 20_000, rounds: int = 250, seed: int = 2) -> Ranker | None:
    """Learn from statistics and labels 0 or 1; None where a label is missing."""
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return None
    # edges from quantiles of either label, so a kind of text that is rare gets its own steps
    q = np.linspace(0.02, 0.98, STEPS)
    edges = np.sort(np.concatenate([np.quantile(stats[good], q, axis=0), np.quantile(stats[bad], q, axis=0)]), axis=0).T
    x = steps(stats, edges)
    rng = np.random.default_rng(seed)
    d = x[rng.choice(good, pairs)] - x[rng.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    m, s = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))  # chance given to the wrong order
        g = p @ d / len(d) - 0.001 * w
        m += 0.1 * (g - m)
        s += 0.01 * (g * g - s)
        w += 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    raw = np.sort(x @ w)
    k = len(bad)
    at = (raw[k - 1] + raw[k]) / 2 if k < len(raw) else raw[-1]
    return Ranker(edges, w, float(at), float(max(raw.std(), 1e-6) / 2))


def learn(docs: DataFrame, labels: DataFrame, rows: int = 6000) -> Ranker | None:
    """Learn from ``labels(doc_id, quality)``, rows to learn from only, and the texts of ``docs``.

    About ``rows`` of the labelled ids are used, by hash; that many small rows are gathered.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", "quality").distinct()
    n = known.count()
    chosen = known.where(hash_share("doc_id", 21) < min(1.0, rows / max(n, 1)))
    named = F.broadcast(chosen.select(F.col("doc_id").alias("of"), "quality"))  # bounded by ``rows``
    # of the rows that share an id one text teaches, the least by hash: what is gathered is bounded by the ids
    texts = (
        docs.select("doc_id", "text").join(named, F.expr("doc_id = of")).groupBy("doc_id", "quality")
        .agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    )

    def run(batches):
        for b in batches:
            stats = [statistics(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("quality"), pa.array([list(s) for s in stats], pa.list_(pa.float64()))],
                names=["doc_id", "quality", "stats"],
            )

    got = map_arrow(texts.withColumn("quality", F.col("quality").cast("int")), run, "doc_id long, quality int, stats array<double>").collect()
    got.sort(key=lambda r: (r["doc_id"], r["quality"], r["stats"]))
    if not got:
        return None
    return fit(np.array([r["stats"] for r in got]), np.array([r["quality"] for r in got]))


def score(docs: DataFrame, ranker: Ranker | None) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, score, predicted)``."""
    shared = docs.sparkSession.sparkContext.broadcast(ranker and (ranker.edges, ranker.weights, ranker.at, ranker.scale))

    def run(batches):
        model = Ranker(*shared.value) if shared.value else None
        for whole in batches:
            for b in slices(whole, 4000, 8 << 20):
                stats = np.array([statistics(t.as_py()) for t in b.column("text")])
                s = model.scores(stats) if model else np.full(len(stats), 0.5)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").cast(pa.int64()), pa.array(s), pa.array((s >= CUT).astype(np.int32))],
                    names=["doc_id", "score", "predicted"],
                )

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double, predicted int")


def held_out(column: str = "doc_id"):
    """Rows whose labels are never learned from: crc32 of the id's text, modulo 5, is 0."""
    return crc_bucket(column, 5) == 0
