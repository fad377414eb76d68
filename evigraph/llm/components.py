"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations and two joins; a hub's many links are reduced by
partial aggregation and its join is one that Spark can split.  Nothing of the
graph is gathered on the driver: a round ends with a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Point each neighbour at the smallest node around (large: neighbours above the centre; small: those below)."""
    if large:
        around = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = links
    least = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = around.join(least, "a")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return moved.where("a <> b").distinct()


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``links(u, v)`` of longs to ``(node, component)``: the smallest id reachable, for nodes with links.

    Self links, repeated links and either direction are fine; rows with a null end are no links.
    ``rounds`` guards against an endless loop (each round at least halves the distances; 60 covers 2**60 nodes).
    """
    edges = cut(
        links.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct()
    )

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = mark(edges)
    if before[0] == 0:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(rounds):
        edges = cut(_star(_star(edges, True), False))
        after = mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not settle")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
