"""Bounded walks over adjacency: neighbours, breadth-first traversal, subgraphs, degrees.

A walk is a driver loop of at most eight joins; each level is written to the checkpoint folder, so lineage
stays short and a lost executor costs one level.  Only counts come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import BudgetExceeded, InvalidRequest

OUT, IN, BOTH = "outgoing", "incoming", "both"
SMALL = 50_000  # nodes of a level that are broadcast once they have been counted


@dataclass
class Policy:
    """Limits and filters of a walk."""

    max_depth: int = 3
    direction: str = BOTH
    rel_types: list[str] = field(default_factory=list)
    max_results: int | None = 1_000
    max_expansions: int | None = 10_000
    supernode: int | None = 10_000
    neighbour: F.Column | None = None  # a filter on node columns

    def check(self) -> None:
        if not 1 <= self.max_depth <= 8:
            raise InvalidRequest("a walk is 1 to 8 levels deep")
        if self.direction not in (OUT, IN, BOTH):
            raise InvalidRequest(f"unknown direction {self.direction}")


def shared_folder(spark) -> str:
    """The folder that all nodes share: ``spark.checkpoint.dir``, or the checkpoint folder that was set, or one beside the warehouse."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """(rel, owner, other, rel_type): incident edges by the node they are followed from."""
    out = edges.select(F.col("id").alias("rel"), F.col("src").alias("owner"), F.col("dst").alias("other"), "rel_type")
    if direction == OUT:
        return out
    back = edges.select(F.col("id").alias("rel"), F.col("dst").alias("owner"), F.col("src").alias("other"), "rel_type")
    return back if direction == IN else out.unionByName(back.where("owner <> other"))


def neighbours(edges: DataFrame, nodes: DataFrame, seeds: list[str], policy: Policy | None = None) -> DataFrame:
    """(owner, id, rel): visible neighbours of the seeds, one hop."""
    policy = policy or Policy(max_depth=1)
    rows = directed(edges, policy.direction).where(F.col("owner").isin(seeds))
    if policy.rel_types:
        rows = rows.where(F.col("rel_type").isin(policy.rel_types))
    seen = nodes if policy.neighbour is None else nodes.where(policy.neighbour)
    return rows.join(seen.select(F.col("id").alias("other")), "other", "left_semi").select("owner", F.col("other").alias("id"), "rel").dropDuplicates(["owner", "rel"])


def adjacency(edges: DataFrame, path: str, direction: str = BOTH) -> DataFrame:
    """:func:`directed` edges written once in ranges of (owner, rel), for walks that would else read every edge in each level.

    A supernode's edges lie in as many files as they need; a level's owners are found by the row groups' statistics.
    """
    directed(edges, direction).repartitionByRange("owner", "rel").sortWithinPartitions("owner", "rel").write.mode("overwrite").parquet(path)
    return edges.sparkSession.read.parquet(path)


def crowded(moves: DataFrame, limit: int) -> DataFrame:
    """(id, degree) of the nodes with more than ``limit`` edges to follow: what a walk without filters refuses to expand."""
    return moves.groupBy(F.col("owner").alias("id")).agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") > limit)


def walk(edges: DataFrame, nodes: DataFrame, seeds: list[str], policy: Policy | None = None, moves: DataFrame | None = None) -> DataFrame:
    """Breadth-first: (id, depth, parent, rel) of every node reached, each by its first path.

    First: in the order of the parents, then of the relationship's id.  More edges than ``max_expansions``, or
    an unfiltered node of more than ``supernode`` edges, fail the walk; ``max_results`` cuts it in order.
    ``moves`` may be a written :func:`adjacency` of the edges.  Levels of up to ``SMALL`` nodes, by count, are broadcast, so the
    edges aren't shuffled for them.
    """
    policy = policy or Policy()
    policy.check()
    moves = directed(edges, policy.direction) if moves is None else moves
    if policy.rel_types:
        moves = moves.where(F.col("rel_type").isin(policy.rel_types))
    seen = nodes if policy.neighbour is None else nodes.where(policy.neighbour)
    ids = seen.select(F.col("id").alias("other"))
    spark = edges.sparkSession
    start = spark.createDataFrame([(s, i) for i, s in enumerate(dict.fromkeys(seeds))], "id string, place long")
    level = start.join(nodes.select("id"), "id", "left_semi").select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("rel"), "place")
    reached = frontier = cut(level)
    spent, total = 0, frontier.count()
    size = total
    for depth in range(1, policy.max_depth + 1):
        level = frontier.select(F.col("id").alias("owner"), F.col("place").alias("at"))
        steps = moves.join(F.broadcast(level) if size <= SMALL else level, "owner")
        if policy.supernode is not None and not policy.rel_types and policy.neighbour is None:
            if (top := crowded(steps, policy.supernode).first()) is not None:
                raise BudgetExceeded(f"{top['id']} has {top['degree']} edges; filter the walk")
        if policy.max_expansions is not None:
            spent += steps.limit(policy.max_expansions - spent + 1).count()
            if spent > policy.max_expansions:
                raise BudgetExceeded(f"more than {policy.max_expansions} edges")
        met = cut(steps.groupBy("other").agg(F.min(F.struct("at", "rel", "owner")).alias("first")))
        met = met if met.limit(SMALL + 1).count() > SMALL else F.broadcast(met)
        # ids and reached may be far larger than a level: they are streamed past it, not shuffled, where it is small
        found = ids.join(met, "other").select("other", "first").distinct()
        found = found.join(F.broadcast(reached.select(F.col("id").alias("other"))) if total <= SMALL else reached.select(F.col("id").alias("other")), "other", "left_anti")
        rows = found.select(F.col("other").alias("id"), F.lit(depth).alias("depth"), F.col("first.owner").alias("parent"), F.col("first.rel").alias("rel"), F.col("first.at").alias("at"))
        if policy.max_results is not None:
            rows = rows.orderBy("at", "rel", "id").limit(max(0, policy.max_results - total))
            place = F.row_number().over(Window.orderBy("at", "rel", "id")).cast("long")  # at most max_results rows
        else:
            place = F.col("at")  # nothing is cut: parents that share a place are told apart by their edge's id
        frontier = cut(rows.withColumn("place", place).drop("at"))
        n = frontier.count()
        total += n
        size = n
        if n == 0:
            break
        reached = reached.unionByName(frontier)
    return reached.drop("place")


def subgraph(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes reached."""
    ids = reached.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): edges in and out of each node; reduced in each task before the shuffle."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


# ---------------------------------------------------------------- structural checks


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rel, side, missing): edges with an end that no visible node has."""
    ids = nodes.select("id")
    parts = [
        edges.join(ids.withColumnRenamed("id", c), c, "left_anti").select(F.col("id").alias("rel"), F.lit(side).alias("side"), F.col(c).alias("missing"))
        for c, side in (("src", "source"), ("dst", "target"))
    ]
    return parts[0].unionByName(parts[1])


def bad_ends(edges: DataFrame, kinds: DataFrame, rules: dict) -> DataFrame:
    """(rel, rel_type, source_kind, target_kind): edges of known types whose ends are of kinds the rules don't allow, or of none."""
    rows = [(t, a, b) for t, (froms, tos) in rules.items() for a in froms for b in tos]
    table = edges.sparkSession.createDataFrame(rows, "rel_type string, source_kind string, target_kind string")
    known = edges.where(F.col("rel_type").isin(list(rules)))
    return (
        known.join(kinds.select(F.col("id").alias("src"), F.col("kind").alias("source_kind")), "src", "left")
        .join(kinds.select(F.col("id").alias("dst"), F.col("kind").alias("target_kind")), "dst", "left")
        .join(F.broadcast(table), ["rel_type", "source_kind", "target_kind"], "left_anti")  # a few dozen rules
        .select(F.col("id").alias("rel"), "rel_type", "source_kind", "target_kind")
    )


def cyclic_edges(edges: DataFrame, rounds: int = 10_000) -> DataFrame:
    """Edges of the part of a graph that holds all its cycles: nodes without a way in, or out, are peeled off until none is left."""
    left = cut(edges.select("id", "src", "dst"))
    n = left.count()
    for _ in range(rounds):
        ins, outs = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
        left = cut(left.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("id", "src", "dst"))
        now = left.count()
        if now == n:
            return left
        n = now
    raise RuntimeError("peeling of cyclic edges did not settle")
