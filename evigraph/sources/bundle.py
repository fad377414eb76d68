"""Threat-intelligence bundles (STIX 2.1 JSON): read into records, written from them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Conflict, InvalidRequest
from ..functions.core import normalised_confidence, sanitized_type


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, type, source, target, rel_type, confidence, modified, body) of the objects of bundles; bodies are JSON text.

    A file that isn't a bundle, or one id with two contents, is refused.
    """
    files = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    if files.where(F.coalesce(F.expr("try_variant_get(v, '$.type', 'string')"), F.lit("")) != "bundle").limit(1).count():
        raise InvalidRequest("not a bundle")
    objects = files.select(F.explode(F.expr("try_variant_get(v, '$.objects', 'array<variant>')")).alias("o"))

    def get(name):
        return F.expr(f"try_variant_get(o, '$.{name}', 'string')")

    rows = objects.select(
        get("id").alias("id"), get("type").alias("type"), get("source_ref").alias("source"), get("target_ref").alias("target"),
        sanitized_type(get("relationship_type")).alias("rel_type"), normalised_confidence(F.expr("try_variant_get(o, '$.confidence', 'double')")).alias("confidence"),
        get("modified").alias("modified"), F.to_json("o").alias("body"),
    ).distinct()
    if rows.groupBy("id").count().where("count > 1").limit(1).count():
        raise Conflict("one id with two contents")
    return rows


def label(kind) -> F.Column:
    """``threat-actor`` to ``ThreatActor``."""
    return F.replace(F.initcap(F.replace(kind, F.lit("-"), F.lit(" "))), F.lit(" "), F.lit(""))


def nodes(rows: DataFrame, now: str) -> DataFrame:
    return rows.where(F.col("type") != "relationship").select(
        "id", F.lit(1).cast("long").alias("version"), F.array(label(F.col("type"))).alias("labels"),
        F.create_map(F.lit("body"), F.col("body")).alias("props"), F.lit("candidate").alias("status"), "confidence",
        F.array().cast("array<string>").alias("evidence_refs"), F.lit(now).alias("recorded_at"),
    )


def rels(rows: DataFrame, now: str) -> DataFrame:
    return rows.where(F.col("type") == "relationship").select(
        "id", F.lit(1).cast("long").alias("version"), F.col("source").alias("src"), F.col("target").alias("dst"), "rel_type",
        F.create_map(F.lit("body"), F.col("body")).alias("props"), F.lit("candidate").alias("status"), "confidence",
        F.array().cast("array<string>").alias("evidence_refs"), F.lit(now).alias("recorded_at"),
    )


def plan_export(nodes: DataFrame, rels: DataFrame, findings: DataFrame, labels: list[str], strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges to export: of the profile's labels, without blocking findings, edges between exported nodes only."""
    chosen = nodes.where(F.arrays_overlap("labels", F.array(*[F.lit(x) for x in labels])))
    blocked = chosen.join(findings.select("id").distinct(), "id", "left_semi")
    if strict and blocked.limit(1).count():
        raise Conflict("findings block the export")
    out = chosen.join(findings.select("id").distinct(), "id", "left_anti")
    ids = out.select("id")
    return out, rels.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def write(nodes: DataFrame, rels: DataFrame, path: str) -> str:
    """Objects as JSON lines in id order over the files, and the bundle's id (the same for the same content)."""
    rows = nodes.select("id", F.col("props")["body"].alias("body")).unionByName(rels.select("id", F.col("props")["body"].alias("body")))
    rows.repartitionByRange("id").sortWithinPartitions("id").select(F.col("body").alias("value")).write.text(path)
    from ..operators.records import fingerprint

    return "bundle--" + str(uuid.UUID(fingerprint(rows, "id", "body").first()["digest"][:32]))


def write_rows(rows: DataFrame, path: str, columns: list[str], key: str, required: list[str] | None = None) -> DataFrame:
    """Rows of a table (bibliography, evidence table, claim records) as JSON in key order; returns the incomplete ones."""
    rows.select(*columns).repartitionByRange(key).sortWithinPartitions(key).write.json(path)
    missing = F.lit(False)
    for c in required or []:
        missing = missing | F.col(c).isNull()
    return rows.where(missing).select(key)
