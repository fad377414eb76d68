"""Versions, changes, snapshots, memory and change streams."""

import json

import pytest
from pyspark.sql import functions as F

from evigraph.errors import BudgetExceeded, Conflict, InvalidRequest, NotFound
from evigraph.operators import mutate as mu
from evigraph.operators.memory import Memory
from evigraph.sources import store as st
from evigraph.streaming.sync import Sync, directory


@pytest.fixture
def store(spark, tmp_path):
    s = st.GraphStore(spark, f"file://{tmp_path}/graph")
    mu.run(s, "CREATE (a:Actor {name: 'alpha', score: 3}), (b:Actor {name: 'beta'}), (e:Evidence {name: 'proof'})")
    return s


def ids(frame):
    return sorted(r["id"] for r in frame.select("id").collect())


def test_create_and_read(store):
    assert ids(store.nodes()) == ["node--1", "node--2", "node--3"]
    got = mu.run(store, "MATCH (a:Actor) WHERE a.score >= 2.5 CREATE (a)-[:KNOWS]->(c:Actor {name: 'new'})").first().asDict()
    assert got["nodes_created"] == got["rels_created"] == 1
    rel = store.rels().first()
    assert (rel["src"], rel["dst"], rel["rel_type"]) == ("node--1", "node--4", "KNOWS")


def test_set_remove_delete_keep_history(store):
    mu.run(store, "MATCH (a:Actor {name: 'alpha'}) SET a.score = 4, a.confidence = 0.9, a.status = 'Validated'")
    mu.run(store, "MATCH (a:Actor {name: 'alpha'}) REMOVE a.score")
    row = store.nodes().where("id = 'node--1'").first()
    assert row["version"] == 3 and row["props"]["score"] == "null" and row["confidence"] == 0.9 and row["status"] == "validated"
    assert [r["props"]["score"] for r in store.history("nodes", "node--1").collect()] == ["3", "4", "null"]
    mu.run(store, "MATCH (a:Actor {name: 'alpha'}) DELETE a")
    assert "node--1" not in ids(store.nodes())
    assert store.version("nodes", "node--1", 1).count() == 1


def test_set_is_checked_before_anything_is_written(store):
    before = store.manifest()
    for text in ("SET a.x = 1, a.confidence = 2", "SET a.status = 'tombstoned'", "SET a.evidence_refs = 'e'", "SET a.status = 'exportable'"):
        with pytest.raises(InvalidRequest):
            mu.run(store, "MATCH (a:Actor) " + text)
    assert store.manifest() == before
    mu.run(store, "MATCH (a:Actor {name: 'beta'}), (e:Evidence) SET a.evidence_refs = [e.id], a.confidence = 1")
    assert store.nodes().where("id = 'node--2'").first()["evidence_refs"] == ["node--3"]
    mu.run(store, "MATCH (a:Actor {name: 'beta'}) SET a.status = 'exportable'")


def test_merge_reuses(store):
    first = mu.run(store, "MERGE (a:Actor {name: 'alpha'})").first()
    assert first["nodes_merged"] == 1 and first["nodes_created"] == 0
    text = "MATCH (a:Actor {name: 'alpha'}) MERGE (a)-[:LIKES]->(t:Topic {name: 'x'})"
    assert mu.run(store, text).first()["rels_created"] == 1
    again = mu.run(store, text).first()
    assert again["rels_merged"] == 1 and again["rels_created"] == 0 and again["nodes_merged"] == 1


def test_return_after_a_change(store):
    got = mu.run(store, "MATCH (a:Actor) WHERE a.name IN ['alpha'] SET a.seen = true RETURN a, a.name").collect()
    assert [tuple(r) for r in got] == [("node--1", '"alpha"')]


def test_mutation_budget(store, monkeypatch):
    monkeypatch.setattr(mu, "MAX_MUTATIONS", 1)
    with pytest.raises(BudgetExceeded):
        mu.run(store, "MATCH (a:Actor) SET a.x = 1")


def test_snapshot_restore_compact(store):
    store.snapshot("one")
    mu.run(store, "MATCH (a:Actor) DELETE a")
    assert ids(store.nodes()) == ["node--3"]
    store.restore("one")
    assert len(ids(store.nodes())) == 3
    store.compact()
    assert len(ids(store.nodes())) == 3 and len(store.manifest()["folders"]["nodes"]) == 1
    with pytest.raises(NotFound):
        store.restore("none")
    with pytest.raises(Conflict):
        store.commit(0, nodes=store.versions("nodes"))


def test_changed_versions_and_identifiers(store, spark):
    before = store.manifest()
    mu.run(store, "MATCH (a:Actor {name: 'beta'}) SET a.canonical_id = 'cid', a.identifiers = ['x1', 'x2']")
    assert ids(store.changed(before)) == ["node--2"]
    for name in ("node--2", "cid", "x2"):
        assert ids(store.get(name)) == ["node--2"]
    assert store.get("none").count() == 0


def test_checksums_find_tampering(spark):
    rows = st.sealed(spark.createDataFrame([("a", 1), ("b", 2)], "id string, n long"))
    assert st.broken(rows).count() == 0
    assert ids(st.broken(rows.withColumn("n", F.when(F.col("id") == "b", 3).otherwise(F.col("n"))))) == ["b"]


def test_write_batches(store, spark):
    schema = "id string, action string, expected long, labels array<string>, props map<string,string>"
    rows = [("node--1", "update", 1, None, {"name": '"z"'}), ("new", "create", None, ["Actor"], {}), ("node--2", "delete", 1, None, None)]
    got = {r["id"]: r["outcome"] for r in mu.write_batch(store, spark.createDataFrame(rows, schema)).collect()}
    assert got == {"node--1": "updated", "new": "created", "node--2": "deleted"}
    bad = spark.createDataFrame([("node--1", "update", 1, None, {}), ("other", "create", None, ["Actor"], {})], schema)
    with pytest.raises(Conflict):
        mu.write_batch(store, bad)
    assert {r["outcome"] for r in mu.write_batch(store, bad, atomic=False).collect()} == {"conflict", "created"}


def test_memory(store):
    m = Memory(store, "w", "2024-01-01T00:00:00Z")
    a = m.remember("k1", "one", "note", "the river floods in spring", evidence=["e1"])
    assert m.remember("k1", "one", "note", "the river floods in spring", evidence=["e1"]) == a
    with pytest.raises(Conflict):
        m.remember("k1", "one", "note", "other")
    b = m.remember("k2", "two", "note", "bridges close when water rises")
    m.relate("k3", a["id"], "CAUSES", b["id"])
    got = [(r["id"], r["depth"], r["matches"]) for r in m.recall("the river flood?").collect()]
    assert got[0] == (a["id"], 0, 2) and got[1][:2] == (b["id"], 1)
    with pytest.raises(Conflict):
        m.update("k4", a["id"], 7, content="x")
    assert m.update("k5", a["id"], 1, content="it floods")["version"] == 2
    assert m.forget("k6", b["id"])["version"] == 2
    with pytest.raises(NotFound):
        m.update("k7", b["id"], 2, content="x")
    c = m.remember("k8", "three", "note", "third")
    done = m.consolidate("k9", [a["id"], c["id"]], "both", apply=True, disagreements=["none"])
    assert done["applied"] and [r["id"] for r in m.recall("both of them").collect()][0] == done["proposal"]
    assert len(m.trace(a["id"])["versions"]) == 3
    with pytest.raises(InvalidRequest):
        m.consolidate("k10", [a["id"]], "x")


def test_change_stream_is_idempotent(spark, tmp_path):
    store = st.GraphStore(spark, f"file://{tmp_path}/graph")
    sync = Sync(store)
    (tmp_path / "in").mkdir()

    def put(name, *ops):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(o) for o in ops))

    put("1.json", {"operation": "o1", "seq": 1, "id": "x", "action": "create", "labels": ["A"], "props": {"v": "1"}},
        {"operation": "o2", "seq": 2, "id": "x", "action": "update", "props": {"v": "2"}}, {"operation": "o3", "seq": 3, "id": None, "action": "create"})
    stream = directory(spark, str(tmp_path / "in"))
    sync.start(stream, str(tmp_path / "check")).awaitTermination()
    put("2.json", {"operation": "o2", "seq": 2, "id": "x", "action": "update", "props": {"v": "9"}}, {"operation": "o4", "seq": 4, "id": "y", "action": "create", "labels": ["A"], "props": {}})
    sync.start(stream, str(tmp_path / "check")).awaitTermination()
    state = sync.state()
    assert (state["seq"], state["applied"], state["quarantined"], state["batches"]) == (4, 3, 1, 2)
    assert {r["id"]: r["props"].get("v") for r in store.nodes().collect()} == {"x": "2", "y": None}
    with pytest.raises(InvalidRequest):
        sync.apply(spark.createDataFrame([], "operation string, seq long, id string, action string, labels array<string>, props map<string,string>"), "steady")


def test_deleted_records_can_be_created_again(store, spark):
    """Versions go on after a tombstone, whichever way a record comes back."""
    m = Memory(store, "w")
    a = m.remember("k1", "one", "note", "first", evidence=["e1"])
    m.forget("k2", a["id"])
    assert m.remember("k3", "one", "note", "second", evidence=["e2"]) == {"id": a["id"], "version": 3}
    row = store.nodes().where(F.col("id") == a["id"]).first()
    assert row["props"]["content"] == '"second"' and row["evidence_refs"] == ["e2"]
    schema = "id string, action string, expected long, labels array<string>, props map<string,string>"
    for action in ("create", "delete", "create"):
        mu.write_batch(store, spark.createDataFrame([("again", action, None, ["Actor"], {"n": '"1"'} if action == "create" else None)], schema))
    assert store.nodes().where("id = 'again'").first()["version"] == 3
    with pytest.raises(Conflict):
        mu.write_batch(store, spark.createDataFrame([("again", "create", None, ["Actor"], {})], schema))
    sync, ops = Sync(store), "operation string, seq long, id string, action string, labels array<string>, props map<string,string>"
    for i, action in enumerate(("create", "delete", "create")):
        sync.apply(spark.createDataFrame([(f"o{i}", i, "s", action, ["A"] if i != 1 else None, {"i": str(i)} if i != 1 else None)], ops))
    row = store.nodes().where("id = 's'").first()
    assert (row["version"], row["props"], row["status"]) == (3, {"i": "2"}, "candidate")


def test_manifests_are_created_and_never_replaced(store, spark, tmp_path):
    before = store.manifest()
    half = tmp_path / "graph/manifests" / f"{before['revision'] + 1:012d}.json"
    half.write_text('{"revision": 99, "fold')  # a writer that died
    assert store.manifest() == before and len(ids(store.nodes())) == 3
    store.commit(before["revision"], nodes=store.versions("nodes").limit(0))
    after = store.manifest()
    assert after["revision"] == before["revision"] + 1
    with pytest.raises(Conflict):
        store._publish({"revision": after["revision"], "folders": {}})
    assert store.manifest() == after
    assert ids(store.between("node--1", "node--2")) == []
