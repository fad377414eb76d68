"""What retrievals teach: decayed traces, completeness, prefetch metrics, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def traces(events: DataFrame, decay: float = 0.9) -> DataFrame:
    """(scope, edge, tick, value): sum of deltas decayed to each edge's last tick; one aggregation, no ordered state.

    Accumulating value * decay ** (ticks passed) + delta in order gives the sum of delta * decay ** (last - tick).
    """
    last = events.groupBy("scope", "edge").agg(F.max("tick").alias("last"))
    rows = events.join(last, ["scope", "edge"])
    return rows.groupBy("scope", "edge").agg(
        F.max("last").alias("tick"), F.sum(F.col("delta") * F.pow(F.lit(decay), F.col("last") - F.col("tick"))).alias("value")
    )


def dead_ends(events: DataFrame) -> DataFrame:
    """(scope, edge, count): admitted edges whose node was later marked a dead end, a supernode or irrelevant."""
    admitted = events.where(F.col("decision") == "admit").groupBy("scope", "node").agg(F.min_by("edge", "seq").alias("edge"), F.min("seq").alias("seq"))
    bad = events.where(F.col("decision").isin("dead_end", "supernode", "irrelevant")).select("scope", "node", F.col("seq").alias("at"))
    return bad.join(admitted, ["scope", "node"]).where("at > seq").groupBy("scope", "edge").agg(F.count(F.lit(1)).alias("count"))


def completeness(events: DataFrame, key: str = "retrieval") -> DataFrame:
    """Share of what could be followed that was: warm attachments count half; nothing to follow is complete."""
    def n(kind):
        return F.count_if(F.col("decision") == kind)

    c = events.groupBy(key).agg(
        n("expanded").alias("expanded"), n("warm").alias("warm"),
        (n("skipped") + n("stopped") + n("deferred") + n("supernode")).alias("missed"),
    )
    got = F.col("expanded") + 0.5 * F.col("warm")
    whole = got + F.col("missed") + 0.5 * F.col("warm")
    return c.select(key, F.when(whole > 0, got / whole).otherwise(1.0).alias("completeness"))


def prefetch(decisions: DataFrame) -> DataFrame:
    return decisions.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("hit", "miss", "waste")])


def bucket(*parts) -> F.Column:
    """A sticky bucket from 0 to 9999 of the parts' SHA-256."""
    return (F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 15), 16, 10).cast("long") % 10_000).cast("int")


def routed(share_basis_points: int, *parts) -> F.Column:
    return bucket(*parts) < share_basis_points


def expand(seeds: DataFrame, edges: DataFrame, max_nodes: int, max_edges: int, supernode: int | None = None) -> DataFrame:
    """One hop from a seed set within budgets: edges by (seed, id) until a budget is spent; crowded seeds are left out.

    Only the rows within the budget are ranked together.
    """
    from pyspark.sql import Window

    rows = edges.join(seeds.select(F.col("id").alias("src")), "src", "left_semi")
    if supernode is not None:
        crowded = rows.groupBy("src").count().where(F.col("count") >= supernode).select("src")
        rows = rows.join(crowded, "src", "left_anti")
    first = rows.select("src", "id", "dst").orderBy("src", "id").limit(max_edges)
    w = Window.orderBy("src", "id")
    fresh = first.withColumn("place", F.row_number().over(w)).withColumn("new", (F.row_number().over(Window.partitionBy("dst").orderBy("src", "id")) == 1).cast("int"))
    return fresh.withColumn("nodes", F.sum("new").over(w)).where(F.col("nodes") <= max_nodes).select("src", "id", "dst")


def frontier(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Payload-free boundary of a working set: edges that leave it."""
    ids = seeds.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select("id", "src", "dst")
