"""Line dedup by content-defined chunks of lines (operator 9), in DataFrame and SQL functions only.

A line's value is the first 32 bits of its md5.  A rolling hash over the values of two
successive lines ends a chunk where it is divisible by ``divisor``, so boundaries depend
on nearby lines alone and inserted lines shift nothing further on.  A line of
``heavy`` words or more is a chunk by itself, so a long passage is found whatever
stands around it.  A chunk counts if it has two lines with words, or is a heavy line.

Counting chunks that occur again anywhere are removed but for the first occurrence by
(doc_id, place in the text); null ids come last.  Chunks are met by their md5, then the
bytes of all occurrences are compared; should bytes ever differ under one md5, all of
these chunks stay.  Rows with the same id and text are one occurrence and end up alike.

Shuffles: chunk keys (no text), then twice the texts of documents by a row key that is
unique, so no task gets more than its share; keys that are common are joined by a join
Spark can split.  Null texts count as empty, have one empty line, and stay null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, cut

HEAVY, DIVISOR = 50, 3
WORD = "[^\\\\x20\\\\x09-\\\\x0D]"


def _once(df: DataFrame, **columns: str) -> DataFrame:
    """Add columns that are computed once a row, however often (or in a lambda) later expressions use them."""
    return df.select("*", F.expr("inline(array(struct(" + ", ".join(f"{e} as {c}" for c, e in columns.items()) + ")))"))


def _chunked(docs: DataFrame, heavy: int, divisor: int) -> DataFrame:
    """``docs`` with _lines and _chunks: array of (k, s, e, counts), lines s to e - 1."""
    df = _once(docs, _lines="split(coalesce(text, ''), '\\n', -1)")
    df = _once(
        df,
        _seen="transform(_lines, x -> struct(cast(conv(substr(md5(x), 1, 8), 16, 10) as bigint) as v, "
        f"regexp_count(x, '{WORD}+') as w))",
    )
    df = _once(
        df,
        _starts="filter(sequence(0, size(_lines) - 1), i -> i = 0 "
        f"or get(_seen, i).w >= {heavy} or get(_seen, i - 1).w >= {heavy} "
        f"or (coalesce(get(_seen, i - 2).v, 0L) * 1000003L + get(_seen, i - 1).v) % {divisor} = 0)",
    )
    df = _once(df, _ends="concat(slice(_starts, 2, size(_starts)), array(size(_lines)))")
    df = _once(
        df,
        _chunks="transform(_starts, (s, k) -> struct(k as k, s as s, get(_ends, k) as e, "
        f"get(_seen, s).w >= {heavy} or size(filter(slice(_seen, s + 1, get(_ends, k) - s), x -> x.w > 0)) >= 2 as counts))",
    )
    return df.drop("_seen", "_starts", "_ends")


def _text_of(chunk: str) -> str:
    return f"array_join(slice(_lines, {chunk}.s + 1, {chunk}.e - {chunk}.s), '\\n')"


def _with_row(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_row", F.expr("concat_ws('-', cast(doc_id as string), md5(coalesce(text, '')))"))


def repeated_chunks(docs: DataFrame, heavy: int = HEAVY, divisor: int = DIVISOR) -> DataFrame:
    """``docs(doc_id, text)`` to ``(_row, removed array<int>)``: numbers of the chunks that go, for rows that lose any."""
    base = _with_row(docs.select("doc_id", "text"))
    places = (
        _chunked(base, heavy, divisor)
        .withColumn("_keys", F.expr(f"transform(filter(_chunks, c -> c.counts), c -> struct(c.k as k, unhex(md5({_text_of('c')})) as key))"))
        .select("doc_id", "_row", F.explode("_keys").alias("c"))
        .select("doc_id", "_row", "c.k", "c.key")
    )
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row", "k")
    again = cut(
        places.groupBy("key").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1").select("key", "first")
    )
    mine = cut(
        places.join(again, "key")
        .select("_row", "k", "key", ((F.col("first._row") == F.col("_row")) & (F.col("first.k") == F.col("k"))).alias("first"))
    )
    # byte comparison of all occurrences
    wanted = mine.groupBy("_row").agg(F.collect_set(F.struct("k", "key")).alias("wanted"))
    unequal = cut(
        _chunked(base.select("_row", "text").join(wanted, "_row"), heavy, divisor)
        .withColumn("_texts", F.expr(f"transform(wanted, w -> struct(w.key as key, {_text_of('get(_chunks, w.k)')} as bytes))"))
        .select(F.explode("_texts").alias("t"))
        .select("t.key", "t.bytes")
        .groupBy("key", "bytes").agg(F.count("*").alias("n"))
        .groupBy("key").agg(F.count("*").alias("kinds"))
        .where("kinds > 1").select("key")
    )
    return mine.where("not first").join(unequal, "key", "left_anti").groupBy("_row").agg(F.collect_set("k").alias("removed"))


def dedup_lines(docs: DataFrame, heavy: int = HEAVY, divisor: int = DIVISOR) -> DataFrame:
    """``docs(doc_id, text)`` with text less its repeated chunks, and n_lines, n_chunks, n_removed_chunks, n_removed_lines.

    Further columns stay, whatever their names; one that has the name of a count gives way to it.
    """
    rows, back = aside(docs, "doc_id", "text")
    removed = repeated_chunks(rows, heavy, divisor)
    joined = _chunked(_with_row(rows).join(removed, "_row", "left"), heavy, divisor)
    kept = _once(joined, _keep="array_except(transform(_chunks, c -> c.k), coalesce(removed, cast(array() as array<int>)))")
    kept = _once(kept, _left="flatten(transform(_keep, k -> slice(_lines, get(_chunks, k).s + 1, get(_chunks, k).e - get(_chunks, k).s)))")
    counts = {
        "n_lines": F.size("_lines"), "n_chunks": F.size("_chunks"), "n_removed_chunks": F.size("_chunks") - F.size("_keep"),
        "n_removed_lines": F.size("_lines") - F.size("_left"),
    }
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join("_left", "\n")).alias("text")
    own = [text if c == "text" else b for c, b in zip(docs.columns, back) if c not in counts]
    return kept.select(*own, *[n.cast("long").alias(c) for c, n in counts.items()])


def drop_repeats(docs: DataFrame, **options) -> DataFrame:
    """The columns of ``docs`` with repeated chunks gone from text; documents that lose all their words go too."""
    rows, back = aside(docs, "doc_id", "text")
    done = dedup_lines(rows, **options)
    return done.where((F.col("n_removed_chunks") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]")).select(*back)


SQL = f"""
WITH line AS (
  SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS l,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), seen AS (
  SELECT *, ('0x' || substr(md5(l), 1, 8))::BIGINT AS v,
         len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) AS w
  FROM line
), near AS (
  SELECT *, lag(v) OVER o AS v1, lag(v, 2) OVER o AS v2, lag(w) OVER o AS w1 FROM seen WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), cut AS (
  SELECT *, sum(CASE WHEN i = 1 OR w >= {HEAVY} OR w1 >= {HEAVY} OR (coalesce(v2, 0) * 1000003 + v1) % {DIVISOR} = 0 THEN 1 ELSE 0 END)
         OVER (PARTITION BY doc_id ORDER BY i) AS k
  FROM near
), chunk AS (
  SELECT doc_id, k, string_agg(l, chr(10) ORDER BY i) AS body, count(*) AS n, max(w) >= {HEAVY} OR count(*) FILTER (w > 0) >= 2 AS counts
  FROM cut GROUP BY doc_id, k
), ranked AS (
  SELECT *, counts AND row_number() OVER (PARTITION BY body, counts ORDER BY doc_id, k) > 1 AS gone FROM chunk
)
SELECT doc_id, sum(n)::BIGINT AS n_lines, count(*)::BIGINT AS n_chunks,
       (count(*) FILTER (gone))::BIGINT AS n_removed_chunks, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed_lines,
       sha256(coalesce(string_agg(body, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM ranked GROUP BY doc_id
"""
