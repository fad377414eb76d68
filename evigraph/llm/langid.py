"""Language identification by a bidirectional gated recurrent network over bytes (operator 5).

Texts are read as UTF-8 bytes in windows of ``WINDOW`` positions.  One GRU runs over a
window from the left, one from the right; at every position their states give a
probability for each language, and a document's probability is the mean over all its
positions, whole text included.  Gates use x / (1 + |x|) in place of tanh, in training and
use alike: it costs a fifth.  Training is backpropagation through time in numpy with
Adam, on a bounded sample: about ``rows_per_language`` rows of each language, one stretch
of ``stretch`` characters from each.

A null text, or one without a letter (Unicode category L), is ``und`` with score 0, as is everything where no
row teaches a language.  Texts of any length are read whole; an empty table gives no rows.  Ties go to the language that sorts first.  Repeated rows and
ids get equal results; columns other than doc_id, text and (to learn) lang are ignored.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BATCH, aside, crc_bucket, hash_share, map_arrow, slices

WINDOW, HIDDEN = 64, 8
ALNUM = re.compile(r"[^\W\d_]")  # letters, and numbers such as fractions that aren't decimal digits
F32 = np.float32


def _soft(x):
    return x / (1 + np.abs(x))


def _init(rng, languages: int) -> dict[str, np.ndarray]:
    h, p = HIDDEN, {}
    for d in "fb":
        p["x" + d] = rng.normal(0, 0.5, (256, 3 * h))
        p["u" + d] = rng.normal(0, 0.4, (h, 3 * h))
        p["x" + d][:, :h] += 0.8  # remember at first
        p["w" + d] = rng.normal(0, 0.3, (h, languages))
    p["c"] = np.zeros(languages)
    return {k: v.astype(F32) for k, v in p.items()}


def _run(x, u, ids):
    """States after each position, with what backpropagation needs; ids (T, B)."""
    h = HIDDEN
    state = np.zeros((ids.shape[1], h), F32)
    out, kept = np.empty((*ids.shape, h), F32), []
    for t in range(len(ids)):
        a, b = x[ids[t]], state @ u
        pre = a[:, : 2 * h] + b[:, : 2 * h]
        gates = 0.5 + 0.5 * _soft(pre)
        z, r = gates[:, :h], gates[:, h:]
        inner = a[:, 2 * h :] + r * b[:, 2 * h :]
        n = _soft(inner)
        kept.append((state, pre, z, r, b[:, 2 * h :], inner, n))
        state = n + z * (state - n)
        out[t] = state
    return out, kept


def _back(x, u, ids, kept, grad_out):
    """Gradients of byte table and recurrent weights from those of the states."""
    h = HIDDEN
    gx, gu = np.zeros_like(x), np.zeros_like(u)
    carry = np.zeros_like(kept[0][0])
    for t in range(len(ids) - 1, -1, -1):
        before, pre, z, r, b, inner, n = kept[t]
        g = carry + grad_out[t]
        gn, gz = g * (1 - z), g * (before - n)
        gi = gn / (1 + np.abs(inner)) ** 2
        gr = gi * b
        gp = np.concatenate([gz, gr], 1) * (0.5 / (1 + np.abs(pre)) ** 2)
        gb = np.concatenate([gp, gi * r], 1)
        np.add.at(gx, ids[t], np.concatenate([gp, gi], 1))
        gu += before.T @ gb
        carry = g * z + gb @ u.T
    return gx, gu


def train(texts: list[str], labels: list[str], steps: int = 260, batch: int = 192, seed: int = 5) -> dict:
    """A model from texts with their languages; deterministic."""
    names = sorted(set(labels))
    rng = np.random.default_rng(seed)
    p = _init(rng, max(len(names), 1))
    model = {"names": names, **p}
    if len(names) < 2:
        return model
    length = WINDOW
    where: dict[int, list[np.ndarray]] = {i: [] for i in range(len(names))}
    for t, lab in zip(texts, labels):
        raw = t.encode("utf-8", "replace")
        for a in range(0, max(1, len(raw) - length // 2), length):
            piece = raw[a : a + length].ljust(length)
            where[names.index(lab)].append(np.frombuffer(piece, np.uint8))
    pools = [np.stack(v) for v in where.values()]
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    for step in range(1, steps + 1):
        y = rng.integers(0, len(names), batch)
        ids = np.stack([pools[c][rng.integers(len(pools[c]))] for c in y]).T.astype(np.int64)
        hf, kf = _run(p["xf"], p["uf"], ids)
        hb, kb = _run(p["xb"], p["ub"], ids[::-1])
        hb = hb[::-1]
        logits = hf @ p["wf"] + hb @ p["wb"] + p["c"]
        q = np.exp(logits - logits.max(2, keepdims=True))
        q /= q.sum(2, keepdims=True)
        q[:, np.arange(batch), y] -= 1
        q *= F32(1 / q[..., 0].size)
        flat = q.reshape(-1, len(names))
        g = {"wf": hf.reshape(-1, HIDDEN).T @ flat, "wb": hb.reshape(-1, HIDDEN).T @ flat, "c": flat.sum(0)}
        g["xf"], g["uf"] = _back(p["xf"], p["uf"], ids, kf, q @ p["wf"].T)
        g["xb"], g["ub"] = _back(p["xb"], p["ub"], ids[::-1], kb, (q @ p["wb"].T)[::-1])
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, v in p.items():
            m, s = moment[k]
            m += 0.1 * (g[k] - m)
            s += 0.01 * (g[k] ** 2 - s)
            v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return model


def _pass(x, u, ids, each):
    """Run one direction without keeping anything; ``each(t, state)`` sees every state."""
    h, n = HIDDEN, ids.shape[1]
    state = np.zeros((n, h), F32)
    a, b = np.empty((n, 3 * h), F32), np.empty((n, 3 * h), F32)
    low = np.empty((n, 2 * h), F32)
    inner, bottom = np.empty((n, h), F32), np.empty((n, h), F32)
    for t in range(len(ids)):
        np.take(x, ids[t], axis=0, out=a, mode="clip")
        np.matmul(state, u, out=b)
        pre = a[:, : 2 * h]
        pre += b[:, : 2 * h]
        np.abs(pre, out=low)
        low += 1
        np.divide(pre, low, out=low)
        low *= 0.5
        low += 0.5
        np.multiply(low[:, h:], b[:, 2 * h :], out=inner)
        inner += a[:, 2 * h :]
        np.abs(inner, out=bottom)
        bottom += 1
        inner /= bottom
        state -= inner
        state *= low[:, :h]
        state += inner
        each(t, state)


def window_sums(model: dict, windows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Summed probabilities of each language over the first ``sizes`` positions of each window (B, WINDOW)."""
    n, k = len(windows), len(model["names"])
    ids = np.ascontiguousarray(windows.T)
    logits = np.empty((WINDOW, n, k), F32)
    total = np.zeros((n, k), F32)

    def ahead(t, state):
        np.matmul(state, model["wf"], out=logits[t])

    def behind(t, state):
        at = WINDOW - 1 - t
        q = logits[at]
        q += state @ model["wb"]
        q += model["c"]
        np.clip(q, -30, 30, out=q)
        np.exp(q, out=q)
        q /= (q @ np.ones((k, 1), F32))
        if at >= least:
            q *= (sizes > at)[:, None]
        np.add(total, q, out=total)

    least = int(sizes.min()) if n else 0
    _pass(model["xf"], model["uf"], ids, ahead)
    _pass(model["xb"], model["ub"], ids[::-1], behind)
    return total


def has_letter(text: str) -> bool:
    return any(unicodedata.category(m[0])[0] == "L" for m in ALNUM.finditer(text))


def predict(model: dict, texts: list[str | None], at_once: int = 4096) -> tuple[list[str], list[float]]:
    """Language and pooled probability of each text."""
    names = model["names"]
    preds, scores = ["und"] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if t and has_letter(t)] if names else []
    if not known:
        return preds, scores
    raw = [texts[i].encode("utf-8", "surrogatepass") for i in known]
    lens = np.array([len(r) for r in raw])
    counts = -(-lens // WINDOW)
    flat = np.frombuffer(b"".join([r.ljust(c * WINDOW) for r, c in zip(raw, counts)]), np.uint8).reshape(-1, WINDOW)
    first = np.cumsum(counts) - counts
    sizes = np.full(len(flat), WINDOW)
    sizes[first + counts - 1] = lens - (counts - 1) * WINDOW
    sums = np.concatenate(
        [window_sums(model, flat[a : a + at_once], sizes[a : a + at_once]) for a in range(0, len(flat), at_once)]
    )
    pooled = np.add.reduceat(sums.astype(np.float64), first, axis=0) / lens[:, None]
    for i, row in zip(known, pooled):
        best = int(row.argmax())
        preds[i], scores[i] = names[best], float(min(max(row[best], 0.0), 1.0))
    return preds, scores


def fit(docs: DataFrame, rows_per_language: int = 300, stretch: int = 384, steps: int = 260) -> dict:
    """Learn from ``docs(doc_id, text, lang)``: rows to learn from, all of them with a language or null."""
    known = docs.where("lang is not null")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return train([], [])
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, rows_per_language / n))])
    room = F.greatest(F.lit(0), F.length("text") - stretch)
    # by id and text, so that rows that share an id are drawn one by one, and copies come once
    drawn = known.where("text is not null").withColumn("draw", F.xxhash64("doc_id", "text"))
    rows = (
        drawn.where(hash_share("draw", 11) < share[F.col("lang")])
        .select("doc_id", "lang", F.substring("text", (room * hash_share("draw", 12)).cast("int") + 1, F.lit(stretch)).alias("part"))
        .distinct().collect()
    )
    rows.sort(key=lambda r: (r["lang"], r["doc_id"] is not None, r["doc_id"] or 0, r["part"]))
    return train([r["part"] for r in rows], [r["lang"] for r in rows], steps)


def identify(docs: DataFrame, model: dict, batch: int | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` after its own columns (which must not have these names; see ``aside``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches):
        for whole in batches:
            for b in slices(whole, 2000, 4 << 20):
                preds, scores = predict(shared.value, b.column(b.schema.get_field_index("text")).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64())],
                    names=[*names, "lang_pred", "score"],
                )

    schema = docs.schema

    out = T.StructType([*schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return map_arrow(docs, run, out, batch)


def held_out(docs: DataFrame):
    """Rows never learned from: crc32 of the id's text, modulo 3, is 1."""
    return crc_bucket("doc_id", 3) == 1


def accepted(docs: DataFrame, min_score: float = 0.3, **fitting) -> DataFrame:
    """The rows whose language is recognised (not ``und``, score of ``min_score`` or more), with the columns of ``docs``."""
    rows, back = aside(docs, "doc_id", "text", "lang")
    model = fit(rows.where(~held_out(rows)), **fitting)
    return identify(rows, model, BATCH).where((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).select(*back)
