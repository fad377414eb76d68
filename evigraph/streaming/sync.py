"""Ordered change batches into a versioned store, as Structured Streaming micro-batches.

Operations carry (operation, seq, id, action, labels, props).  A batch drops operations that were applied
or repeat within it, quarantines malformed ones, applies the last state of each record, and commits once; the
high-water mark is part of the commit's receipts, so a replayed micro-batch changes nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidRequest
from ..operators.mutate import live_or_version

SCHEMA = "operation string, seq long, id string, action string, labels array<string>, props map<string,string>"
PHASES = {"snapshot": ("snapshot", "catch_up"), "catch_up": ("catch_up", "steady"), "steady": ("steady",)}


class Sync:
    def __init__(self, store, name: str = "sync", now: str = "1970-01-01T00:00:00Z"):
        self.store, self.name, self.now = store, name, now

    def state(self) -> dict:
        kept = self.store.versions("receipts").where(F.col("workspace") == f"sync:{self.name}").agg(F.max_by("response", F.col("key").cast("long"))).first()[0]
        return json.loads(kept) if kept else {"seq": -1, "phase": "snapshot", "batches": 0, "applied": 0, "quarantined": 0}

    def apply(self, batch: DataFrame, phase: str | None = None) -> dict:
        state = self.state()
        phase = phase or state["phase"]
        if phase not in PHASES[state["phase"]]:
            raise InvalidRequest(f"{state['phase']} isn't followed by {phase}")
        ok = F.col("id").isNotNull() & F.col("seq").isNotNull() & F.coalesce(F.col("action").isin("create", "update", "delete"), F.lit(False))
        fresh = batch.where(F.col("seq").isNull() | (F.col("seq") > state["seq"])).dropDuplicates(["operation"]).cache()
        good = fresh.where(ok)
        last = good.groupBy("id").agg(F.max_by(F.struct("action", "labels", "props"), "seq").alias("o"))
        current = live_or_version(self.store.newest("nodes")).select("id", "version", F.col("labels").alias("had"), F.col("props").alias("old"), "confidence", "evidence_refs")
        new = last.join(current, "id", "left").select(
            "id", (F.coalesce("version", F.lit(0)) + 1).cast("long").alias("version"), F.coalesce("o.labels", "had").alias("labels"),
            F.coalesce("o.props", "old").alias("props"), F.when(F.col("o.action") == "delete", "tombstoned").otherwise("candidate").alias("status"),
            "confidence", F.coalesce("evidence_refs", F.array().cast("array<string>")).alias("evidence_refs"), F.lit(self.now).alias("recorded_at"),
        )
        n = fresh.agg(F.count_if(ok).alias("good"), F.count_if(~ok).alias("bad"), F.max(F.when(ok, F.col("seq"))).alias("top")).first()
        state |= {"phase": phase, "batches": state["batches"] + 1, "applied": state["applied"] + n["good"], "quarantined": state["quarantined"] + n["bad"], "seq": max(state["seq"], n["top"] if n["top"] is not None else -1)}
        receipt = self.store.spark.createDataFrame([(f"sync:{self.name}", str(state["batches"]), "", json.dumps(state))], "workspace string, key string, request string, response string")
        self.store.commit(receipts=receipt, **({"nodes": new} if n["good"] else {}))
        fresh.unpersist()
        return state

    def start(self, stream: DataFrame, checkpoint: str):
        """Apply whatever a stream has now, then stop; the checkpoint remembers what was read."""
        return (
            stream.writeStream.foreachBatch(lambda batch, _: self.apply(batch)).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )


def directory(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """A stream of JSON files as they arrive: the offline stand-in of an incremental collection."""
    return spark.readStream.schema(schema).json(path)


def windows(events: DataFrame, time: str, size: str, late: str, *keys: str) -> DataFrame:
    """Event counts by tumbling window, with rows later than the watermark left out; works on streams and tables."""
    return events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), *keys).agg(F.count(F.lit(1)).alias("count")).select(F.col("w.start").alias("start"), *keys, "count")


def sessions(events: DataFrame, time: str, gap: str, *keys: str) -> DataFrame:
    """Sessions that end after a gap."""
    return events.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("count")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "count")


def jobs(queue: DataFrame, now: int, attempts: int = 3) -> DataFrame:
    """State of each file job from its events (job, seq, event, until): queued, leased, done or quarantined."""
    s = queue.groupBy("job").agg(F.max_by(F.struct("event", "until"), "seq").alias("last"), F.count_if(F.col("event") == "failed").alias("failed"))
    state = (
        F.when(F.col("last.event") == "done", "done").when(F.col("failed") >= attempts, "quarantined")
        .when((F.col("last.event") == "leased") & (F.col("last.until") > now), "leased").otherwise("queued")
    )
    return s.select("job", state.alias("state"), "failed")
