"""Lexical search over an inverted index held as DataFrames.

``tokens`` is (doc, field, term, pos); an index write keeps it bucketed by term.  Scores are closed-form
BM25 (k1 1.2, b 0.75); statistics cover every document.  Results are ordered by score, then id.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BudgetExceeded, InvalidRequest

K1, B = 1.2, 0.75
BOOSTS = {"name": 3.0, "aliases": 2.0}
#: Words of a question that tell nothing of what it is after.
STOP = frozenset("a all an and are find for from identify in is list of on or show that the this tied to what which with".split())
STATUS_SIGNAL = {"validated": 1.0, "exportable": 1.0, "exported": 1.0, "needs_review": 0.7, "needs_evidence": 0.6, "candidate": 0.5}
NEUTRAL_CONFIDENCE = 0.5
SPLIT = "[^\\p{L}\\p{N}]+"


def terms_of(text: str) -> list[str]:
    """Lower-cased runs of letters and digits of two bytes or more, as :func:`term_array` has them."""
    return [t for t in re.split(r"[\W_]+", text.lower()) if len(t.encode()) >= 2]


def objective_terms(text: str) -> list[str]:
    """Distinct terms of a question without stop words; a question of nothing else is refused."""
    got = list(dict.fromkeys(t for t in terms_of(text) if t not in STOP))
    if not got:
        raise InvalidRequest("the objective has no term of its own")
    return got


def term_array(text: F.Column) -> F.Column:
    return F.filter(F.split(F.lower(text), SPLIT), lambda t: F.octet_length(t) >= 2)


def tokens(docs: DataFrame, text_fields: list[str], key: str = "id") -> DataFrame:
    """(doc, field, term, pos) of the fields of each document."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("")).alias("text")) for f in text_fields])
    one = docs.select(F.col(key).alias("doc"), F.explode(fields).alias("f"))
    return one.select("doc", F.col("f.field").alias("field"), F.posexplode(term_array(F.col("f.text"))).alias("pos", "term"))


def lengths(docs: DataFrame, text_fields: list[str], key: str = "id") -> DataFrame:
    """(doc, length): terms of each document, without exploding them."""
    total = None
    for f in text_fields:
        n = F.size(term_array(F.coalesce(F.col(f).cast("string"), F.lit(""))))
        total = n if total is None else total + n
    return docs.select(F.col(key).alias("doc"), total.cast("long").alias("length"))


def _count(words: F.Column, term: str) -> F.Column:
    return F.size(F.filter(words, lambda x: x == F.lit(term)))


def bm25(docs: DataFrame, text_fields: list[str], query: list[str], key: str = "id", boosts: dict | None = None, every: bool = True) -> DataFrame:
    """(doc, score) of the documents that hold all (or any) of the query's terms.

    Terms are filtered before anything is shuffled: one row a document and term moves, none for other words.
    """
    boosts = boosts or {}
    query = list(dict.fromkeys(query))
    parts, size = [], None
    for f in text_fields:
        words = term_array(F.coalesce(F.col(f).cast("string"), F.lit("")))
        n = F.size(words)
        size = n if size is None else size + n
        parts.append((words, boosts.get(f, 1.0)))
    counted = docs.select(
        F.col(key).alias("doc"), size.cast("double").alias("length"),
        *[sum((_count(w, t) * F.lit(b) for w, b in parts), F.lit(0.0)).alias(f"_tf{i}") for i, t in enumerate(query)],
    )
    stats = counted.agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("length").alias("mean"),
        *[F.sum((F.col(f"_tf{i}") > 0).cast("double")).alias(f"_df{i}") for i in range(len(query))],
    )
    rows = counted.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(query)):
        tf, df = F.col(f"_tf{i}"), F.col(f"_df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.greatest(F.col("mean"), F.lit(1.0))))
    has = [F.col(f"_tf{i}") > 0 for i in range(len(query))]
    keep = has[0]
    for h in has[1:]:
        keep = keep & h if every else keep | h
    return rows.where(keep).select("doc", score.alias("score"))


def phrase(docs: DataFrame, field: str, text: str, key: str = "id") -> DataFrame:
    """(doc, hits): documents in which the terms stand next to one another, in order."""
    want = terms_of(text)
    if not want:
        raise InvalidRequest("an empty phrase")
    rows = docs.select(F.col(key).alias("doc"), F.explode(F.array(F.struct(term_array(F.coalesce(F.col(field), F.lit(""))).alias("w")))).alias("_t"))
    # the explode of one row computes the terms once, not for every place of the lambda below
    rows = rows.select("doc", F.col("_t.w").alias("_w")).where(F.array_contains("_w", want[0]))
    places = F.sequence(F.lit(1), F.greatest(F.size("_w") - len(want) + 1, F.lit(1)))
    return rows.select("doc", F.size(F.filter(places, lambda i: _stands(i, want))).cast("long").alias("hits")).where("hits > 0")


def _stands(at, want: list[str]) -> F.Column:
    """Do the terms stand at a place, one after another?"""
    out = None
    for n, t in enumerate(want):
        here = F.coalesce(F.get("_w", at - 1 + n) == F.lit(t), F.lit(False))
        out = here if out is None else out & here
    return out


def _terms_where(docs: DataFrame, field: str, key: str, test) -> DataFrame:
    words = F.array_distinct(term_array(F.coalesce(F.col(field), F.lit(""))))
    return docs.select(F.col(key).alias("doc"), F.size(F.filter(words, test)).cast("long").alias("hits")).where("hits > 0")


def prefix(docs: DataFrame, field: str, start: str, key: str = "id") -> DataFrame:
    """(doc, hits): distinct terms of a document that begin so."""
    return _terms_where(docs, field, key, lambda t: t.startswith(start.lower()))


def fuzzy(docs: DataFrame, field: str, term: str, distance: int = 1, key: str = "id") -> DataFrame:
    """(doc, hits): distinct terms within one or two edits; lengths are compared before edits are counted."""
    if distance not in (1, 2):
        raise InvalidRequest("fuzzy distances are 1 and 2")
    word = term.lower()
    return _terms_where(
        docs, field, key,
        lambda t: (F.abs(F.length(t) - len(word)) <= distance) & (F.levenshtein(t, F.lit(word)) <= distance),
    )


def search(docs: DataFrame, text_fields: list[str], text: str, mode: str = "term", *, key: str = "id", distance: int = 1, filters: dict | None = None, allowed=None, limit: int = 10, max_candidates: int | None = None) -> DataFrame:
    """(doc, score) of the best documents; access and exact filters (any value of a field) come first."""
    if not 1 <= limit <= 1000:
        raise InvalidRequest("limit is 1 to 1000")
    rows = docs if allowed is None else docs.where(allowed)
    for f, values in (filters or {}).items():
        rows = rows.where(F.col(f).isin(values)) if f in rows.columns else rows.where(F.lit(False))
    if mode == "term":
        found = bm25(rows, text_fields, terms_of(text), key, BOOSTS)
    else:
        one = {"phrase": phrase, "prefix": prefix, "fuzzy": fuzzy}[mode]
        parts = [
            (one(rows, f, text, distance, key=key) if mode == "fuzzy" else one(rows, f, text, key=key)).select("doc", (F.col("hits") * BOOSTS.get(f, 1.0)).alias("score"))
            for f in text_fields
        ]
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        found = found.groupBy("doc").agg(F.sum("score").alias("score"))
    if max_candidates is not None and found.limit(max_candidates + 1).count() > max_candidates:
        raise BudgetExceeded(f"more than {max_candidates} candidates")
    return found.orderBy(F.desc("score"), F.asc("doc")).limit(limit)


def snippets(chunks: DataFrame, query: str, width: int = 160) -> DataFrame:
    """(doc, snippet): a window of the first chunk that holds the text, with the match marked."""
    low = query.lower()
    at = F.instr(F.lower("text"), low)
    first = chunks.where(at > 0).groupBy("doc").agg(F.min_by("text", "ordinal").alias("text"))
    start = F.greatest(F.lit(1), F.instr(F.lower("text"), low) - (width - len(query)) // 2)
    window = F.substring("text", start, F.lit(width))
    return first.select("doc", F.regexp_replace(window, "(?i)(" + re.sub(r"([\\.^$|()\[\]{}*+?])", r"\\\1", query) + ")", "<mark>$1</mark>").alias("snippet"))


def seeds(docs: DataFrame, text_fields: list[str], degree: DataFrame, objective: str, key: str = "id", k: int = 10, lexical_only: bool = False) -> DataFrame:
    """Hybrid seeds: 0.70 lexical, 0.15 degree, 0.10 confidence, 0.05 status; (doc, score, rank, ambiguous).

    ``docs`` may have confidence and status; the lexical part is s / (s + 2), the degree part
    ln(1 + d) / ln(1 + most).  A missing confidence counts 0.5, a missing status as a candidate's; rejected and
    tombstoned documents are no seeds.  The boundary is ambiguous when the next score is within 1e-9.
    """
    if "status" in docs.columns:
        docs = docs.where(~F.coalesce(F.col("status").isin("rejected", "tombstoned"), F.lit(False)))
    found = bm25(docs, text_fields, objective_terms(objective), key, every=False)
    most = degree.agg(F.max("degree").alias("most"))
    extra = docs.select(
        F.col(key).alias("doc"),
        (F.col("confidence").cast("double") if "confidence" in docs.columns else F.lit(None).cast("double")).alias("confidence"),
        (F.col("status") if "status" in docs.columns else F.lit(None).cast("string")).alias("status"),
    )
    rows = (
        found.join(extra, "doc").join(degree.select(F.col("id").alias("doc"), "degree"), "doc", "left")
        .crossJoin(F.broadcast(most))  # one row
    )
    lexical = F.col("score") / (F.col("score") + 2.0)
    by_degree = F.when(F.coalesce("most", F.lit(0)) > 0, F.log1p(F.coalesce("degree", F.lit(0)).cast("double")) / F.log1p(F.col("most").cast("double"))).otherwise(0.0)
    by_status = F.element_at(F.create_map(*[F.lit(x) for kv in STATUS_SIGNAL.items() for x in kv]), F.coalesce("status", F.lit("candidate")))
    score = lexical if lexical_only else (
        0.70 * lexical + 0.15 * by_degree + 0.10 * F.coalesce("confidence", F.lit(NEUTRAL_CONFIDENCE)) + 0.05 * F.coalesce(by_status, F.lit(0.0))
    )
    from pyspark.sql import Window

    top = rows.select("doc", score.alias("score")).orderBy(F.desc("score"), F.asc("doc")).limit(k + 1)  # k + 1 rows
    w = Window.orderBy(F.desc("score"), F.asc("doc"))
    return (
        top.withColumn("rank", F.row_number().over(w)).withColumn("following", F.lead("score").over(w))
        .withColumn("ambiguous", (F.col("rank") == k) & F.coalesce(F.abs(F.col("score") - F.col("following")) < 1e-9, F.lit(False)))
        .where(F.col("rank") <= k).select("doc", "score", F.col("rank").cast("long").alias("rank"), "ambiguous")
    )


def reciprocal_rank(results: DataFrame, relevant: DataFrame, top: int = 10) -> DataFrame:
    """Mean reciprocal rank: ``results(query, doc, rank)``, ``relevant(query, doc)``."""
    hit = relevant.join(results, ["query", "doc"], "left")
    return hit.agg(F.avg(F.when(F.col("rank") <= top, 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr"))
