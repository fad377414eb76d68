"""Logs of decisions: probes, responses, promotions, timelines, drawings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Conflict, InvalidRequest
from .traverse import cut

PROBES = {"unsupported_claim": "find_support", "circular_source": "find_independent_source", "open_contradiction": "resolve_contradiction", "stale_evidence": "refresh_evidence"}
RESPONSES = ("quarantine", "reduce_priority", "request_verification", "propose_repair")


def probes(findings: DataFrame, log: DataFrame) -> DataFrame:
    """(kind, target) of new probes: one for each finding whose kind and target have none open in ``log(kind, target, seq, state)``."""
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in PROBES.items() for x in kv]), F.col("rule"))
    wanted = findings.select(kind.alias("kind"), F.col("id").alias("target")).where("kind is not null").distinct()
    opened = log.groupBy("kind", "target").agg(F.max_by("state", "seq").alias("state")).where("state = 'open'")
    return wanted.join(opened, ["kind", "target"], "left_anti")


def respond(findings: DataFrame, response: str, actor: str, at: str) -> DataFrame:
    """Audit rows of a response to findings."""
    if response not in RESPONSES or not actor.strip():
        raise InvalidRequest("a response is one of four kinds and names its actor")
    return findings.select(F.col("id").alias("record"), "rule", F.lit(response).alias("response"), F.lit(actor).alias("actor"), F.lit(at).alias("at"))


def decide(log: DataFrame, branch: str, decision: str, validated: bool, references: list[str], contradictions: int) -> DataFrame:
    """The log row of a branch's end: merging needs validation, a reference outside the base and no open contradiction."""
    if log.where((F.col("branch") == branch) & F.col("decision").isin("merge", "discard")).limit(1).count():
        raise Conflict("the branch has ended")
    if decision not in ("merge", "discard"):
        raise InvalidRequest("a branch is merged or discarded")
    if decision == "merge" and not (validated and any(not r.startswith("base:") for r in references) and contradictions == 0):
        raise Conflict("the branch can't be merged")
    return log.sparkSession.createDataFrame([(branch, decision, references)], "branch string, decision string, references array<string>")


def timeline(spans: DataFrame, most: int = 64) -> DataFrame:
    """``spans(id, parent, start, end)`` with depth; parents hold their children in time, and there is no cycle."""
    known = spans.select(F.col("id").alias("pid"), F.col("start").alias("ps"), F.col("end").alias("pe"))
    bad = spans.join(known, F.col("parent") == F.col("pid"), "left").where("parent is not null and (pid is null or start < ps or end > pe)")
    if bad.limit(1).count():
        raise InvalidRequest("a span is outside its parent, or has none")
    level = cut(spans.where("parent is null").select("id", F.lit(0).alias("depth")))
    out = level
    for depth in range(1, most + 1):
        level = cut(spans.join(level.select(F.col("id").alias("parent")), "parent", "left_semi").select("id", F.lit(depth).alias("depth")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    if out.count() != spans.count():
        raise InvalidRequest("spans form a cycle or are too deep")
    return spans.join(out, "id")


def drawing(nodes: DataFrame, edges: DataFrame, most_nodes: int, most_edges: int) -> tuple[DataFrame, DataFrame, dict]:
    """Nodes in id order up to a budget, edges between them up to theirs, and how much was left out."""
    shown = cut(nodes.orderBy("id").limit(most_nodes))
    ids = shown.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    drawn = inside.orderBy("id").limit(most_edges)
    return shown, drawn, {"nodes": max(0, nodes.count() - most_nodes), "edges": max(0, inside.count() - most_edges)}


def merged_properties(records: DataFrame) -> DataFrame:
    """(key, value, conflict) of records merged into one: the target's value, else the first by id; differing values conflict.

    ``records(id, target boolean, props map)``; one row a property.
    """
    rows = records.select("id", "target", F.explode("props").alias("key", "value"))
    w = Window.partitionBy("key").orderBy(F.desc("target"), "id")
    return rows.withColumn("n", F.row_number().over(w)).groupBy("key").agg(
        F.min_by("value", "n").alias("value"), (F.count_distinct("value") > 1).alias("conflict")
    )
