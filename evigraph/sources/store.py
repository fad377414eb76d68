"""A versioned store: append-only Parquet folders per table, published by numbered manifests.

Every commit writes the new versions (changed records only) to a folder of its own and then creates the next manifest,
a line that lists the folders of each table.  Readers take the whole manifest of the highest number, so they see a commit
as a whole or not at all, and never a gap; a writer that dies leaves folders no manifest names, or half a manifest that
readers pass over.  A manifest is only ever created, never replaced: of two writers at the same revision one fails.
Manifests are written through Hadoop's file systems, so any store Spark can reach will do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Conflict, NotFound
from ..model import NODE, REL, latest, visible
from .manifest import Manifests

TABLES = {"nodes": NODE, "rels": REL, "receipts": "workspace string, key string, request string, response string", "evidence": "id string, source string, digest string, payload string"}


class GraphStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._manifests = Manifests(spark, self.root)

    # -- manifests

    def manifest(self) -> dict:
        return self._manifests.read() or {"revision": 0, "folders": {t: [] for t in TABLES}}

    def _publish(self, manifest: dict) -> None:
        self._manifests.publish(manifest)

    # -- reads

    def versions(self, table: str, manifest: dict | None = None) -> DataFrame:
        folders = (manifest or self.manifest())["folders"].get(table, [])
        schema = TABLES[table]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def newest(self, table: str) -> DataFrame:
        """The last version of every record, tombstones too: what the next version follows."""
        return latest(self.versions(table))

    def nodes(self) -> DataFrame:
        """Current, visible nodes."""
        return visible(self.newest("nodes"))

    def rels(self) -> DataFrame:
        return visible(self.newest("rels"))

    def between(self, source: str, target: str, rel_type: str | None = None) -> DataFrame:
        """Current relationships from one node to another."""
        rows = self.rels().where((F.col("src") == source) & (F.col("dst") == target))
        return rows if rel_type is None else rows.where(F.col("rel_type") == rel_type)

    def history(self, table: str, record: str) -> DataFrame:
        return self.versions(table).where(F.col("id") == record).orderBy("version")

    def version(self, table: str, record: str, version: int) -> DataFrame:
        return self.versions(table).where((F.col("id") == record) & (F.col("version") == version))

    def get(self, record: str) -> DataFrame:
        """The current node of an id, by its own id, its canonical id or one of its identifiers; empty if none."""
        own = F.col("id") == record
        canonical = F.col("props")["canonical_id"] == F.lit(json.dumps(record))
        listed = F.array_contains(F.from_json(F.col("props")["identifiers"], "array<string>"), record)
        return self.nodes().where(own | F.coalesce(canonical, F.lit(False)) | F.coalesce(listed, F.lit(False)))

    # -- writes

    def commit(self, expected: int | None = None, **frames: DataFrame) -> int:
        """Append versions to tables as one revision; ``expected`` guards against a lost update."""
        manifest = self.manifest()
        if expected is not None and manifest["revision"] != expected:
            raise Conflict(f"revision is {manifest['revision']}, not {expected}")
        revision = manifest["revision"] + 1
        folders = {t: list(f) for t, f in manifest["folders"].items()}
        for name, frame in frames.items():
            columns = [F.col(f.split()[0]) for f in TABLES[name].split(", ")]
            folder = f"{name}/{revision}-{uuid.uuid4().hex}"
            frame.select(*columns).write.parquet(f"{self.root}/{folder}")
            folders.setdefault(name, []).append(folder)
        self._publish({"revision": revision, "folders": folders})
        return revision

    def snapshot(self, name: str) -> None:
        """Keep the current manifest under a name; data folders are never changed, so this is the whole backup."""
        self._manifests.create(f"{self.root}/snapshots/{name}.json", self.manifest(), replace=True)

    def restore(self, name: str) -> None:
        at = f"{self.root}/snapshots/{name}.json"
        if not self._manifests.exists(at):
            raise NotFound(name)
        kept = json.loads(self._manifests.text(at))
        self._publish({"revision": self.manifest()["revision"] + 1, "folders": kept["folders"]})

    def compact(self) -> None:
        """Rewrite each table's folders as one, ordered by id, so that point reads skip row groups."""
        manifest = self.manifest()
        revision = manifest["revision"] + 1
        folders = {}
        for t in TABLES:
            if manifest["folders"].get(t):
                folder = f"{t}/{revision}-{uuid.uuid4().hex}"
                rows = self.versions(t, manifest)
                key = "id" if "id" in rows.columns else "key"
                rows.repartitionByRange(key).sortWithinPartitions(key).write.parquet(f"{self.root}/{folder}")
                folders[t] = [folder]
            else:
                folders[t] = []
        self._publish({"revision": revision, "folders": folders})

    def changed(self, before: dict, table: str = "nodes") -> DataFrame:
        """Versions that the current manifest has and ``before`` had not."""
        return self.versions(table).join(self.versions(table, before).select("id", "version"), ["id", "version"], "left_anti")


def sealed(rows: DataFrame) -> DataFrame:
    """Rows with a checksum of their content."""
    return rows.withColumn("checksum", F.sha2(F.to_json(F.struct(*rows.columns)), 256))


def broken(rows: DataFrame) -> DataFrame:
    """Sealed rows whose content and checksum disagree."""
    content = [c for c in rows.columns if c != "checksum"]
    return rows.where(F.col("checksum") != F.sha2(F.to_json(F.struct(*content)), 256))
