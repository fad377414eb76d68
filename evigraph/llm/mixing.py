"""Mixing sources to target weights by a low-discrepancy schedule (operator 4), in SQL functions.

Targets: each source's weight shares ``repeat`` times all words; a source stops at
``most`` times its own words and the excess is shared anew by weight, which settles at
target = least(most * size, level * weight) with one level for all.

Blocks: the documents of a source, in the order of md5 of the id, form one endless
stream that starts anew after its last word; it is cut into blocks of ``block`` words.
Slots: golden-ratio point i (the fractional part of i times 0.618...) falls in the
cumulative weights of one source; the r-th slot of a source takes the r-th block of its
stream.  A source has exactly ceil(target / block) slots, the last one cut so that it ends
at the target; points beyond that are passed over and slots that the points leave out (a
handful, by the sequence's low discrepancy) follow at the end.

Running sums go by buckets of the order's leading hex digits: sums in a bucket, then over
the buckets (one row each), so a source with a third of all rows is spread over many tasks.
The table of sources has one row a source.

Null and empty texts have size 0 and take nothing; a null source is a source of its own,
last.  Rows that agree in id, source and size share what is taken of them evenly.  Null ids
are placed like the text ''.  No other column than doc_id, text and source is looked at.  Words of a text of any
length count; an empty table has an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, cut

WEIGHTS = (3, 1, 2)
GOLDEN = 0.6180339887498949


def sized_text():
    return F.expr("cast(regexp_count(coalesce(text, ''), '[^\\\\x20\\\\x09-\\\\x0D]+') as bigint)")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): words of each text."""
    return docs.select("doc_id", "source", sized_text().alias("size"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, repeat: float = 1.5, most: float = 2.0) -> DataFrame:
    """(s, source, source_size, weight, target): one row a source; s numbers the sources by code point, null last."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    got = per.withColumn("s", F.row_number().over(named) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("s") % len(weights) + 1).cast("int"))
    )
    # sources by the level at which they stop; before[k] have stopped when the level is below the next one's
    got = got.withColumn("full", F.col("source_size") * F.lit(most)).withColumn("stop", F.col("full") / F.col("weight"))
    w = Window.orderBy("stop", "s")
    everything = Window.partitionBy()
    got = (
        got.withColumn("stopped", F.coalesce(F.sum("full").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(w.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("whole", F.sum("source_size").over(everything) * F.lit(repeat))
        .withColumn("level", (F.col("whole") - F.col("stopped")) / F.col("open"))
    )
    # the level of the first source that does not stop; none is reached only if every source stops
    first = F.min_by(F.col("level"), F.when(F.col("level") <= F.col("stop"), F.struct("stop", "s"))).over(everything)
    return got.withColumn("at", first).select(
        "s", "source", "source_size", "weight",
        F.when(F.col("at").isNull(), F.col("full")).otherwise(F.least("full", F.col("at") * F.col("weight"))).alias("target"),
    )


def small(rows: DataFrame, most: int = 50_000) -> DataFrame:
    """A table with one row a source: broadcast if it has no more than ``most`` rows, else joined as Spark sees fit."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def placed(sizes: DataFrame, targets: DataFrame, bucket_rows: int = 20_000) -> DataFrame:
    """Documents with words and their first word's place in the stream of their source: (doc_id, s, size, start)."""
    digits = 2
    while 16**digits * bucket_rows < sizes.count() * 16 and digits < 6:
        digits += 1
    rows = (
        sizes.where("size > 0")
        .join(small(targets.select("s", F.col("source").alias("name"))), F.expr("source <=> name"))
        .withColumn("shuffle", F.md5(F.concat(F.lit("mix-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
        .withColumn("bucket", F.substring("shuffle", 1, digits))
        .select("doc_id", "s", "size", "shuffle", "bucket")
    )
    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("s", "bucket").agg(F.sum("size").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = Window.partitionBy("s", "bucket").orderBy("shuffle", "size").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        base.select("s", "bucket", "base"), ["s", "bucket"]
    ).select("doc_id", "s", "size", (F.col("base") + F.col("within")).alias("start"))


def block_size(targets: DataFrame, largest: int = 4096) -> int:
    """Words a block: ``largest``, or less so that the mix has at least 4096 blocks, and never less than 1."""
    whole = targets.agg(F.sum("target")).first()[0] or 0.0
    return max(1, min(largest, int(whole) // 4096))


def schedule(spark, targets: DataFrame, block: int, chunk: int = 1 << 16) -> DataFrame:
    """(slot, s, rank, first, last): the mix in order; a slot takes words first to last - 1 of its source's stream."""
    quota = targets.where("target >= 1").select(
        "s", "target", F.ceil(F.floor("target") / F.lit(float(block))).cast("long").alias("quota"), F.floor("target").cast("long").alias("words")
    )
    share = quota.withColumn("whole", F.sum("target").over(Window.partitionBy())).withColumn(
        "high", F.sum("target").over(Window.orderBy("s")) / F.col("whole")
    ).withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("s")), F.lit(0.0))).withColumn(
        "high", F.when(F.lead("s").over(Window.orderBy("s")).isNull(), F.lit(1.0)).otherwise(F.col("high"))
    )
    share = cut(share.select("s", "quota", "words", "low", "high"))
    points = share.agg(F.sum("quota")).first()[0] or 0
    # which source a point falls in: cells of the unit interval keep this an equi-join
    cells = 1 << 10
    spans = share.select(
        "s", "low", "high",
        F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))).alias("cell"),
    )
    drawn = spark.range(0, max(points, 1)).where(F.lit(points) > 0).select(
        F.col("id").alias("i"), (F.col("id") * F.lit(GOLDEN) - F.floor(F.col("id") * F.lit(GOLDEN))).alias("x")
    ).withColumn("cell", F.floor(F.col("x") * cells))
    hit = drawn.join(spans, "cell").where("x >= low and x < high").select("i", "s", F.expr(f"i div {chunk}").alias("part"))
    before = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = hit.groupBy("s", "part").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0)))
    ranked = hit.withColumn("r", F.row_number().over(Window.partitionBy("s", "part").orderBy("i")) - 1).join(
        sums.select("s", "part", "base"), ["s", "part"]
    ).select("s", "i", (F.col("r") + F.col("base")).alias("rank"))
    had = hit.groupBy("s").agg(F.count("*").alias("had"))
    tail = share.join(had, "s", "left").where("coalesce(had, 0) < quota").select(
        "s", F.explode(F.expr("sequence(coalesce(had, 0L), quota - 1)")).alias("rank")
    ).select("s", (F.lit(points) + F.col("rank")).alias("i"), "rank")
    return (
        ranked.unionByName(tail).join(share.select("s", "quota", "words"), "s").where("rank < quota")
        .select(F.col("i").alias("slot"), "s", "rank", (F.col("rank") * block).alias("first"), F.least((F.col("rank") + 1) * block, F.col("words")).alias("last"))
    )


def mix(docs: DataFrame, weights=WEIGHTS, repeat: float = 1.5, most: float = 2.0):
    """Targets, sizes, and the pieces of the mix: (slot, s, doc_id, size, first, last), words first to last - 1 of a document."""
    spark = docs.sparkSession
    sizes = cut(sized(docs))
    targets = cut(source_targets(sizes, weights, repeat, most))
    block = block_size(targets)
    slots = schedule(spark, targets, block)
    pieces = (
        placed(sizes, targets)
        .join(targets.select("s", "source_size", F.floor("target").cast("long").alias("words")), "s")
        .withColumn("lap", F.explode(F.expr("filter(sequence(0L, greatest(0L, (words - 1) div source_size)), p -> p * source_size + start < words)")))
        .withColumn("a", F.col("lap") * F.col("source_size") + F.col("start"))
        .withColumn("b", F.col("a") + F.col("size"))
        .withColumn("rank", F.explode(F.expr(f"sequence(a div {block}, (b - 1) div {block})")))
        .select("doc_id", "s", "size", "a", "b", "rank")
    )
    used = pieces.join(slots, ["s", "rank"]).select(
        "slot", "s", "doc_id", "size", (F.greatest("a", "first") - F.col("a")).alias("first"), (F.least("b", "last") - F.col("a")).alias("last")
    ).where("last > first")
    return sizes, targets, used


def taken(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of ``docs``."""
    sizes, targets, used = mix(docs, **options)
    words = used.groupBy("doc_id", "s", "size").agg(F.sum(F.col("last") - F.col("first")).alias("n"))
    of_source = small(targets.select("s", F.col("source").alias("name"), "source_size", "target"))
    rows = sizes.join(of_source, F.expr("source <=> name")).groupBy("doc_id", "s", "size", "source_size", "target").agg(F.count("*").alias("times"))
    return (
        rows.join(words.select(F.col("doc_id").alias("of"), F.col("s").alias("in_s"), F.col("size").alias("at"), "n"), F.expr("doc_id <=> of and s = in_s and size = at"), "left")
        .withColumn("time", F.explode(F.expr("sequence(1L, times)")))
        .select(
            "doc_id", "size", "source_size", "target",
            F.expr("coalesce(n div times + if(time <= n % times, 1, 0), 0)").cast("long").alias("taken"),
        )
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The columns of ``docs``, a document as often as the mix takes it, in the order of the mix.

    A document comes once for each lap in which its first word is taken, at the slot that takes it.  Every task holds a part of
    the rows dealt by hash and sorts it by slot, so a written file is a random part of the mix in the mix's order, and texts are
    shuffled once; texts stay whole and a source's words come within one document of its target.  Rows that agree in id,
    source and size share their slots in turn.
    """
    sizes, targets, used = mix(docs, **options)
    slots = used.where("first = 0").groupBy("doc_id", "s", "size").agg(F.sort_array(F.collect_list("slot")).alias("slots"))
    named = small(targets.select("s", F.col("source").alias("name")))
    chosen = slots.join(named, "s").select(F.col("doc_id").alias("of"), "name", F.col("size").alias("at"), "slots")
    rows, back = aside(docs, "doc_id", "text", "source")
    rows = rows.withColumn("_size", sized_text())
    found = rows.join(chosen, F.expr("doc_id <=> of and source <=> name and _size = at"))
    repeated = cut(sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("times")).where("times > 1"))
    if repeated.isEmpty():
        found = found.withColumn("_slot", F.explode("slots"))
    else:
        again = repeated.select(F.col("doc_id").alias("of2"), F.col("source").alias("name2"), F.col("size").alias("at2"), "times")
        found = found.join(again, F.expr("doc_id <=> of2 and source <=> name2 and _size = at2"), "left").withColumn("times", F.coalesce("times", F.lit(1)))
        turn = F.row_number().over(Window.partitionBy("doc_id", "source", "_size").orderBy(F.xxhash64("text"))) - 1
        found = found.withColumn("_turn", turn).withColumn("_slot", F.explode(F.expr("filter(slots, (x, i) -> i % times = _turn)")))
    return found.sortWithinPartitions("_slot").select(*back)


SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), p AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s FROM d GROUP BY source
), w AS (
  SELECT *, CASE s % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM p
), v AS (
  SELECT *, cap / weight AS stop,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS stopped,
    sum(weight) OVER (ORDER BY cap / weight, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
    sum(source_size) OVER () * 1.5::DOUBLE AS whole
  FROM w
), l AS (
  SELECT (whole - stopped) / open AS level FROM v WHERE (whole - stopped) / open <= stop ORDER BY stop, s LIMIT 1
), t AS (
  SELECT source, source_size, coalesce(least(cap, (SELECT level FROM l) * weight), cap) AS target FROM v
), o AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS words,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix-' || coalesce(d.doc_id::VARCHAR, '')), d.size
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0
       ELSE (words // source_size) * size + greatest(0, least(size, words % source_size - start)) END::BIGINT AS taken
FROM o
"""
