"""Memory operations: records of a workspace, with idempotent receipts."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Conflict, InvalidRequest, NotFound
from .mutate import encode
from .search import objective_terms
from .traverse import Policy, walk


class Memory:
    """Remember, relate, recall, update, forget, consolidate and trace on a store."""

    def __init__(self, store, workspace: str, now: str = "1970-01-01T00:00:00Z"):
        self.store, self.workspace, self.now = store, workspace, now

    def _once(self, key: str, request: dict, act):
        """Answer a repeated request from its receipt; the same key with another request is a conflict."""
        if not 1 <= len(key) <= 256:
            raise InvalidRequest("an idempotency key has 1 to 256 characters")
        digest = hashlib.sha256(json.dumps(request, sort_keys=True).encode()).hexdigest()
        kept = self.store.versions("receipts").where((F.col("workspace") == self.workspace) & (F.col("key") == key)).first()
        if kept:
            if kept["request"] != digest:
                raise Conflict("the key was used for another request")
            return json.loads(kept["response"])
        response, frames = act()
        receipt = self.store.spark.createDataFrame([(self.workspace, key, digest, json.dumps(response))], "workspace string, key string, request string, response string")
        self.store.commit(receipts=receipt, **frames)
        return response

    def _node(self, record: str, version: int, kind: str, props: dict, status="candidate", evidence=()):
        row = (record, version, [kind], {k: encode(v) for k, v in props.items()}, status, None, list(evidence), self.now)
        return self.store.spark.createDataFrame([row], "id string, version long, labels array<string>, props map<string,string>, status string, confidence double, evidence_refs array<string>, recorded_at string")

    def _current(self, record: str):
        got = self.store.nodes().where((F.col("id") == record) & (F.col("props")["workspace"] == encode(self.workspace))).first()
        if got is None:
            raise NotFound(record)
        return got

    def _next(self, table: str, record: str) -> int:
        """The version that follows a record's last one, deleted or not."""
        return (self.store.newest(table).where(F.col("id") == record).agg(F.max("version")).first()[0] or 0) + 1

    def remember(self, key: str, identity: str, kind: str, content: str, evidence=(), **props) -> dict:
        record = "memory--" + hashlib.sha256(f"{self.workspace}|{identity}".encode()).hexdigest()[:32]

        def act():
            before = self.store.newest("nodes").where(F.col("id") == record).first()
            version = (before["version"] if before else 0) + 1
            alive = before is not None and before["status"] != "tombstoned"
            refs = list(dict.fromkeys([*(before["evidence_refs"] if alive else []), *evidence]))
            values = {"workspace": self.workspace, "kind": kind, "content": content, "lifecycle": "active", **props}
            return {"id": record, "version": version}, {"nodes": self._node(record, version, "Memory", values, evidence=refs)}

        return self._once(key, {"op": "remember", "identity": identity, "kind": kind, "content": content, "props": props}, act)

    def relate(self, key: str, source: str, kind: str, target: str, evidence=()) -> dict:
        def act():
            self._current(source)
            self._current(target)
            record = "relation--" + hashlib.sha256(f"{source}|{kind}|{target}".encode()).hexdigest()[:32]
            version = self._next("rels", record)
            row = (record, version, source, target, kind, {"workspace": encode(self.workspace)}, "candidate", None, list(evidence), self.now)
            frame = self.store.spark.createDataFrame([row], "id string, version long, src string, dst string, rel_type string, props map<string,string>, status string, confidence double, evidence_refs array<string>, recorded_at string")
            return {"id": record, "version": version}, {"rels": frame}

        return self._once(key, {"op": "relate", "s": source, "k": kind, "t": target}, act)

    def _replace(self, key: str, request: dict, record: str, expected: int | None, changes: dict, status: str | None = None) -> dict:
        def act():
            got = self._current(record)
            if expected is not None and got["version"] != expected:
                raise Conflict(f"version is {got['version']}, not {expected}")
            props = {k: json.loads(v) for k, v in got["props"].items()} | changes
            frame = self._node(record, got["version"] + 1, got["labels"][0], props, status or got["status"], got["evidence_refs"])
            return {"id": record, "version": got["version"] + 1}, {"nodes": frame}

        return self._once(key, request, act)

    def update(self, key: str, record: str, expected: int, **changes) -> dict:
        return self._replace(key, {"op": "update", "id": record, "v": expected, "c": changes}, record, expected, changes)

    def forget(self, key: str, record: str, mode: str = "tombstone", expires_at: str | None = None) -> dict:
        if mode not in ("expire", "tombstone", "delete") or (mode == "expire") != (expires_at is not None):
            raise InvalidRequest("expire needs a time; tombstone and delete take none")
        changes = {"expires_at": expires_at} if mode == "expire" else {"lifecycle": "deleted"}
        return self._replace(key, {"op": "forget", "id": record, "m": mode, "e": expires_at}, record, None, changes, None if mode == "expire" else "tombstoned")

    def consolidate(self, key: str, records: list[str], content: str, apply: bool = False, disagreements: list[str] | None = None) -> dict:
        if not 2 <= len(set(records)) <= 100:
            raise InvalidRequest("2 to 100 records are consolidated")
        if apply and disagreements is None:
            raise InvalidRequest("what the records disagree on is kept")
        proposal = "memory--" + hashlib.sha256("|".join(sorted(set(records))).encode()).hexdigest()[:32]

        def act():
            if not apply:
                return {"proposal": proposal, "applied": False}, {}
            frames = self._node(proposal, self._next("nodes", proposal), "Memory", {"workspace": self.workspace, "kind": "summary", "content": content, "lifecycle": "active", "disagreements": disagreements})
            links = []
            for r in sorted(set(records)):
                got = self._current(r)
                props = {k: json.loads(v) for k, v in got["props"].items()} | {"lifecycle": "superseded"}
                frames = frames.unionByName(self._node(r, got["version"] + 1, got["labels"][0], props, got["status"], got["evidence_refs"]))
                link = f"relation--{proposal[8:24]}{r[8:24]}"
                links.append((link, self._next("rels", link), proposal, r, "SUPERSEDES", {}, "candidate", None, [], self.now))
            rels = self.store.spark.createDataFrame(links, "id string, version long, src string, dst string, rel_type string, props map<string,string>, status string, confidence double, evidence_refs array<string>, recorded_at string")
            return {"proposal": proposal, "applied": True}, {"nodes": frames, "rels": rels}

        return self._once(key, {"op": "consolidate", "r": sorted(set(records)), "c": content, "a": apply}, act)

    def _visible(self) -> DataFrame:
        nodes = self.store.nodes().where((F.col("props")["workspace"] == encode(self.workspace)) & (F.col("props")["lifecycle"] == '"active"'))
        expires = F.from_json(F.concat(F.lit('{"v":'), F.coalesce(F.col("props")["expires_at"], F.lit("null")), F.lit("}")), "v string")["v"]
        return nodes.where(expires.isNull() | (expires > self.now))

    def recall(self, objective: str, explicit: list[str] | None = None, items: int = 50, offset: int = 0, **limits) -> DataFrame:
        """(id, depth, matches, score): explicit and lexical seeds, walked outwards; score is matches + 1 / (depth + 1)."""
        nodes = self._visible()
        hits = lexical_matches(nodes.select("id", F.lower(F.concat_ws(" ", "id", F.col("props")["kind"], F.col("props")["content"])).alias("text")), objective_terms(objective))
        seeds = list(dict.fromkeys([*(explicit or []), *(r["id"] for r in hits.orderBy(F.desc("matches"), "id").limit(items).collect())]))
        found = walk(self.store.rels().select("id", "src", "dst", "rel_type"), nodes, seeds, Policy(**({"max_depth": 2, "max_expansions": 1_000, "supernode": 1_000, "max_results": items} | limits)))
        n = F.coalesce("matches", F.lit(0))
        return found.join(hits, "id", "left").select("id", "depth", n.alias("matches"), (n + 1.0 / (F.col("depth") + 1)).alias("score")).orderBy(F.desc("score"), "id").offset(offset).limit(items)

    def trace(self, record: str, most: int = 1000) -> dict:
        """Versions of a record and the relations around it, up to ``most`` of them; ``truncated`` says whether there are more."""
        history = [r.asDict() for r in self.store.history("nodes", record).collect()]
        if not history:
            raise NotFound(record)
        around = self.store.rels().where((F.col("src") == record) | (F.col("dst") == record)).orderBy("id").limit(most + 1).collect()
        return {"versions": history, "relations": [r.asDict() for r in around[:most]], "truncated": len(around) > most}


def lexical_matches(rows: DataFrame, terms: list[str]) -> DataFrame:
    """(id, matches): how many of the terms each text contains, as substrings; texts with none are left out."""
    total = F.lit(0)
    for t in terms:
        total = total + F.contains("text", F.lit(t)).cast("int")
    return rows.select("id", total.cast("long").alias("matches")).where("matches > 0")
