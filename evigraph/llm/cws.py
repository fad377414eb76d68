"""Document fingerprints by consistent weighted sampling (operator 7).

A document is its lower-cased words with their counts as weights.  For each of
``SAMPLES`` samples and each word, gamma-distributed r and c and a uniform shift b follow from
the word's hash alone; with t = floor(ln weight / r + b), the word with the least
ln c - r (t - b) - r is drawn, and (word, t) is the sample.  Two documents share a sample with a
probability equal to their generalised Jaccard similarity (sum of the lesser weights over
sum of the greater).  A sample is kept as 16 bits of its hash, so the share of equal samples
is corrected for chance.

The text that follows each document (in descending id order, the first after the last) comes
without a global sort: ids fall into ranges between bounds, every range is one group
of rows in its own task's sorted stream, and the largest id below a range's lower bound is
sent to that range too.  Texts are shuffled once.

Null texts are empty; a text without words (of ASCII white space alone, say) has no samples: its fingerprint is all zeros, and it is like
another such text (1) and unlike any other (0).  Repeated ids follow one another in the order of
their texts; null ids come last.  Texts of any length are sampled whole, ``BLOCK`` terms at a time; other columns aren't
read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices

SAMPLES = 128
GRAIN = 1 << 16
BLOCK = 4096  # terms drawn at once; the draws of 32 times as many are kept for the texts that share them


def _tables():
    """Quantiles of Gamma(2, 1), their logarithms, and of the uniform distribution, in GRAIN steps."""
    u = (np.arange(GRAIN) + 0.5) / GRAIN
    x = np.full(GRAIN, 1.7)
    lo, hi = np.zeros(GRAIN), np.full(GRAIN, 60.0)
    for _ in range(60):  # bisect 1 - exp(-x)(1 + x) = u
        x = (lo + hi) / 2
        less = 1 - np.exp(-x) * (1 + x) < u
        lo, hi = np.where(less, x, lo), np.where(less, hi, x)
    return x.astype(np.float32), np.log(x).astype(np.float32), u.astype(np.float32)


R, LN_C, U = _tables()
SEEDS = np.random.default_rng(7).integers(0, 2**63, SAMPLES, dtype=np.uint64)


def _mix(x):
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def draws(hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (word, weight) rows: what each sample minimises, and 16 bits naming (word, t)."""
    with np.errstate(over="ignore"):
        x = _mix(hashes[:, None] ^ SEEDS[None, :])
        r = R[(x & np.uint64(0xFFFF)).astype(np.int32)]
        b = U[((x >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int32)]
        key = LN_C[((x >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int32)]
        t = np.floor(np.log(weights.astype(np.float32))[:, None] / r + b)
        key = key - r * (t - b) - r
        name = (_mix(x + t.astype(np.int64).view(np.uint64)) >> np.uint64(48)).astype(np.uint16)
    return key, name


def _terms(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


def signatures(texts: list[str]) -> np.ndarray:
    """(len(texts), SAMPLES) of uint16; zeros for texts without words.  Each distinct (word, weight) is drawn once for a run of texts."""
    from collections import Counter

    import xxhash

    digest = xxhash.xxh3_64_intdigest
    out = np.zeros((len(texts), SAMPLES), np.uint16)
    sample = np.arange(SAMPLES)

    def made(first: int, rows: list[list[int]], index: dict):
        hashes = np.fromiter((digest(w) for w, _ in index), np.uint64, len(index))
        weights = np.fromiter((n for _, n in index), np.float64, len(index))
        if len(rows) == 1:  # a text may have any number of terms: the least draws so far are kept
            least, name = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.uint16)
            for a in range(0, len(index), BLOCK // 2):
                key, names = draws(hashes[a : a + BLOCK // 2], weights[a : a + BLOCK // 2])
                best = key.argmin(0)
                better = key[best, sample] < least
                least = np.where(better, key[best, sample], least)
                name = np.where(better, names[best, sample], name)
            if len(index):
                out[first] = name
            return
        key = np.empty((len(index), SAMPLES), np.float32)
        names = np.empty((len(index), SAMPLES), np.uint16)
        for a in range(0, len(index), BLOCK // 2):
            key[a : a + BLOCK // 2], names[a : a + BLOCK // 2] = draws(hashes[a : a + BLOCK // 2], weights[a : a + BLOCK // 2])
        for i, r in enumerate(rows):
            if r:
                at = np.array(r)
                best = key[at].argmin(0)
                out[first + i] = names[at[best], sample]

    first, rows, index = 0, [], {}
    for n, t in enumerate(texts):
        terms = sorted(Counter(_terms(t)).items())
        if rows and len(index) + len(terms) > 32 * BLOCK:
            made(first, rows, index)
            first, rows, index = n, [], {}
        rows.append([index.setdefault(item, len(index)) for item in terms])
    if rows:
        made(first, rows, index)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated generalised Jaccard similarity of rows of signatures: the share of equal samples, less chance."""
    same = (a == b).mean(-1)
    return np.clip((same - 2**-16) / (1 - 2**-16), 0.0, 1.0)


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many (or all) of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _range_of(rows: DataFrame, rows_per_range: int, most: int):
    """``rows`` with pid: the number of the id range, growing with the id; -1 for null ids."""
    from pyspark.ml.feature import Bucketizer

    known = rows.where("doc_id is not null").select(F.col("doc_id").cast("double").alias("at"))
    count = min(most, -(-known.count() // rows_per_range))
    cuts = sorted(set(known.approxQuantile("at", [i / count for i in range(1, count)], 0.25 / count))) if count > 1 else []
    if not cuts:
        return rows.withColumn("pid", F.when(F.col("doc_id").isNull(), -1).otherwise(0))
    split = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="at", outputCol="range")
    placed = split.transform(rows.withColumn("at", F.coalesce(F.col("doc_id"), F.lit(0)).cast("double")))
    return placed.withColumn("pid", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("range").cast("int"))).drop("at", "range")


def with_next(docs: DataFrame, rows_per_range: int = 250, most: int = 20_000) -> DataFrame:
    """A stream of rows (pid, doc_id, text, role) in tasks that hold whole ranges, in descending order.

    ``role``: 0 a row of the range, 1 the row that follows the range's last.  Bounds are approximate quantiles of
    the ids, at most ``most`` of them; one row a range is gathered on the driver.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = _range_of(rows, rows_per_range, most).withColumn("role", F.lit(0))
    tops = own.groupBy("pid").agg(F.max("doc_id").alias("doc_id")).collect()
    got = sorted(((r["pid"], r["doc_id"]) for r in tops), reverse=True)
    follow = [(p, *got[(i + 1) % len(got)]) for i, (p, _) in enumerate(got)]
    named = F.broadcast(docs.sparkSession.createDataFrame(follow, "to int, of int, next_id long"))  # ``most`` + 1 rows
    sent = (
        own.join(named, F.expr("pid = of and doc_id <=> next_id"))
        .groupBy("to", "doc_id").agg(F.max("text").alias("text"))
        .select(F.col("to").alias("pid"), "doc_id", "text", F.lit(1).alias("role"))
    )
    both = own.select("pid", "doc_id", "text", "role").unionByName(sent)
    return both.repartition("pid").sortWithinPartitions(
        F.col("pid"), F.col("role"), F.col("doc_id").desc_nulls_last(), F.col("text").desc()
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Signature of each text, of its edited text, and how alike they and the next document's are."""

    def run(batches):
        held: list[tuple] = []  # rows of one range whose next row has not come
        size = 0

        def made(rows, following):
            """Rows with the row that follows each."""
            texts = [r[2] for r in rows]
            nexts = [*texts[1:], following]
            changed = [edited(t, x) for t, x in zip(texts, nexts)]
            s = signatures([*texts, following, *changed])
            own, after, other = s[: len(rows)], s[1 : len(rows) + 1], s[len(rows) + 1 :]
            empty = np.array([not _some(t) for t in [*texts, following]])
            blank = np.array([not _some(t) for t in changed])

            def alike(x, y, no_x, no_y):
                v = likeness(x, y)
                v[no_x != no_y] = 0.0
                v[no_x & no_y] = 1.0
                return v

            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
                    pa.array([x.astype(">u2").tobytes().hex() for x in own], pa.string()),
                    pa.array([x.astype(">u2").tobytes().hex() for x in other], pa.string()),
                    pa.array(alike(own, other, empty[:-1], blank)),
                    pa.array(alike(own, after, empty[:-1], empty[1:])),
                ],
                names=NAMES,
            )

        for whole in batches:
            for b in slices(whole, 256, 1 << 20):
                for row in zip(*(b.column(c).to_pylist() for c in ("pid", "doc_id", "text", "role"))):
                    if row[3] == 1:
                        if held:
                            yield made(held, row[2])
                        held, size = [], 0
                    else:
                        held.append(row)
                        size += len(row[2])
                        if len(held) > 1 and (len(held) > 200 or size > 1 << 20):
                            yield made(held[:-1], row[2])
                            held, size = [row], len(row[2])

    return map_arrow(with_next(docs), run, SCHEMA)


def _some(text: str) -> bool:
    """Has the text a term?"""
    return bool(text.encode("utf-8", "surrogatepass").strip())


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
