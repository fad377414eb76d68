"""Predicates, access, pages, walks, search, functions, bundles and validators on small inputs."""

import re

import pytest
from pyspark.sql import functions as F

from evigraph.errors import BudgetExceeded, Conflict, InvalidRequest, NotFound
from evigraph.functions import core as fn
from evigraph.operators import access as ac
from evigraph.operators import epistemic as ep
from evigraph.operators import navigation as nv
from evigraph.operators import order as od
from evigraph.operators import records as rc
from evigraph.operators import search as se
from evigraph.operators import traverse as tr
from evigraph.operators.predicate import Filter, Group, validate
from evigraph.sources import bundle, extract


@pytest.fixture(scope="module")
def records(spark):
    rows = spark.createDataFrame(
        [("a", 1, 1.5, ["x", "y"], [{"k": "p", "v": 1}, {"k": "q", "v": 5}], "2024-01-01T10:00:00Z"), ("b", None, None, [], [{"k": "p", "v": 5}], "bad"), ("c", 3, 2.0, None, None, "2024-01-02T23:30:00Z")],
        "id string, n long, w double, tags array<string>, items array<struct<k:string,v:long>>, at string",
    )
    return rc.to_records(rows, "Thing").cache()


@pytest.mark.parametrize(
    "rule, ids",
    [
        (Filter("n", "equal", 1), "a"), (Filter("n", "equal", 1.0), ""), (Filter("n", "gte", 1.0), "ac"), (Filter("tags", "equal", "x"), "a"),
        (Filter("n", "not_equal", 1), "c"), (Filter("tags", "not_equal", "x"), "ab"), (Filter("n", "not_in", [1]), "c"), (Filter("tags", "not_in", ["x"]), "b"),
        (Filter("n", "exists"), "ac"), (Filter("n", "not_exists"), "b"), (Filter("zz", "not_exists"), "abc"), (Filter("at", "wildcard", "2024-*:?0:00Z"), "ac"),
        (Filter("items", "nested", Group("all", [Filter("k", "equal", "p"), Filter("v", "gt", 3)])), "b"), (Filter("n", "lt", "x"), ""),
        (Group("any", [Filter("n", "equal", 3), Filter("tags", "in", ["y", "z"])]), "ac"), (Filter("type", "equal", "Thing"), "abc"), (Filter("items.k", "exists"), ""),
    ],
)
def test_contract_predicates(records, rule, ids):
    assert "".join(sorted(r["id"] for r in rc.selected(records, rc.Read(predicate=rule)).collect())) == ids


def test_predicate_limits():
    deep = Filter("a", "exists")
    for _ in range(17):
        deep = Group("all", [deep])
    for bad in (deep, Group("all", []), Group("any", [Filter("a", "exists")] * 200), Filter("a", "in", "x"), Filter("a", "odd"), Filter("", "exists"), Filter("a", "gt", None)):
        with pytest.raises(InvalidRequest):
            validate(bad)


def test_aggregations(records):
    def of(plan, **more):
        return [tuple(r) for r in rc.aggregate_records(records, rc.Read(), plan, **more).collect()]

    assert of(rc.Aggregation("count")) == [(3,)]
    assert of(rc.Aggregation("terms", "tags")) == [("x", 1), ("y", 1)]
    assert of(rc.Aggregation("cardinality", "tags")) == [(2,)]
    assert of(rc.Aggregation("average", "n")) == [(2.0,)] and of(rc.Aggregation("sum", "missing")) == [(None,)]
    assert [c for _, c in of(rc.Aggregation("date_histogram", "at", step="day", fill=True))] == [1, 1]
    assert len(of(rc.Aggregation("date_histogram", "at", step="hour", fill=True))) == 38
    nested = rc.Aggregation("nested", "items", inner=rc.Aggregation("terms", "k"))
    assert of(nested) == [("p", 2), ("q", 1)]
    back = rc.Aggregation("nested", "items", inner=rc.Aggregation("filter", predicate=Filter("v", "equal", 5), inner=rc.Aggregation("reverse_nested", inner=rc.Aggregation("count"))))
    assert of(back) == [(2,)]
    with pytest.raises(BudgetExceeded):
        of(rc.Aggregation("count"), candidate_limit=2)
    for bad in (rc.Aggregation("terms"), rc.Aggregation("terms", "a", limit=0), rc.Aggregation("date_histogram", "a", step="week"), rc.Aggregation("nested", "a")):
        with pytest.raises(InvalidRequest):
            of(bad)


def test_cache_and_fingerprint(records):
    calls = []
    cache = rc.ResultCache()

    def make():
        calls.append(1)
        return rc.counted(records, rc.Read())

    assert cache.get("k", make) == cache.get("k", make) and len(calls) == 1
    cache.clear()
    cache.get("k", make)
    assert len(calls) == 2
    a = rc.fingerprint(records, "id", "revision").first()
    assert a == rc.fingerprint(records.repartition(7), "id", "revision").first()
    assert a["digest"] != rc.fingerprint(records.where("id <> 'a'"), "id", "revision").first()["digest"]


def test_pages(records):
    codec = od.TokenCodec(b"k" * 32)
    read = rc.Read(order=[("n", True)], limit=1)
    seen, token = [], None
    while True:
        rows, token = od.page(records, read, codec, token)
        seen += [r["id"] for r in rows]
        if token is None:
            break
    assert seen == ["c", "a", "b"]
    _, token = od.page(records, read, codec)
    with pytest.raises(Conflict):
        od.page(records.where("id <> 'b'"), read, codec, token)
    with pytest.raises(Conflict):
        od.page(records, rc.Read(order=[("n", False)], limit=1), codec, token)
    with pytest.raises(InvalidRequest):
        od.page(records, read, codec, token[:-1] + ("0" if token[-1] != "0" else "1"))
    with pytest.raises(InvalidRequest):
        od.TokenCodec(b"short")


def test_access_ladder(spark):
    base = {"markings": [], "tenants": [], "denied": [], "owner": None, "creators": [], "members": [], "authorities": [], "public": False, "shared": [], "organisations": [], "malformed": False}
    cases = {
        "open": ({}, True), "marked": ({"markings": ["red"]}, False), "held": ({"markings": ["green"]}, True), "tenant": ({"tenants": ["t2"]}, False),
        "denied": ({"denied": ["org"], "owner": "ann"}, False), "owner": ({"owner": "ann"}, True), "other": ({"owner": "bob"}, False), "creator": ({"owner": "bob", "creators": ["ann"]}, True),
        "member": ({"owner": "bob", "members": ["g1"]}, True), "authority": ({"owner": "bob", "authorities": ["au"]}, True), "public": ({"owner": "bob", "public": True}, True),
        "organisation": ({"owner": "bob", "organisations": ["org"]}, True), "malformed": ({"malformed": True}, False), "marked_owner": ({"markings": ["red"], "owner": "ann"}, False),
    }
    rows = [(k, base | v) for k, (v, _) in cases.items()] + [("none", None)]
    frame = spark.createDataFrame(rows, f"id string, access {ac.ACCESS}")
    policy = ac.compile_policy(ac.Context(user="ann", tenant="t1", markings=["green"], organisations=[" org "], groups=["g1"], authorities=["au"]))
    got = {r["id"] for r in frame.where(ac.allowed(policy, F.col("access"))).collect()}
    assert got == {k for k, (_, ok) in cases.items() if ok} | {"none"}
    assert frame.where(ac.allowed(ac.compile_policy(ac.Context(system=True)), F.col("access"))).count() == len(rows)
    assert policy.fingerprint == ac.compile_policy(ac.Context(user="ann", tenant="t1", markings=["green", "green "], organisations=["org"], groups=["g1"], authorities=["au"])).fingerprint
    with pytest.raises(InvalidRequest):
        ac.compile_policy(ac.Context())


def test_walks(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "id string")
    edges = spark.createDataFrame([("1", "a", "b", "X"), ("2", "a", "c", "X"), ("3", "b", "d", "X"), ("4", "c", "d", "Y"), ("5", "d", "e", "X"), ("6", "e", "gone", "X"), ("7", "f", "a", "X")], "id string, src string, dst string, rel_type string")
    got = {r["id"]: (r["depth"], r["parent"], r["rel"]) for r in tr.walk(edges, nodes, ["a"], tr.Policy(max_depth=3, direction=tr.OUT)).collect()}
    assert got == {"a": (0, None, None), "b": (1, "a", "1"), "c": (1, "a", "2"), "d": (2, "b", "3"), "e": (3, "d", "5")}
    both = {r["id"] for r in tr.walk(edges, nodes, ["a"], tr.Policy(max_depth=1)).collect()}
    assert both == {"a", "b", "c", "f"}
    only = {r["id"] for r in tr.walk(edges, nodes, ["a"], tr.Policy(max_depth=8, direction=tr.OUT, rel_types=["X"])).collect()}
    assert only == {"a", "b", "c", "d", "e"}
    assert [r["id"] for r in tr.walk(edges, nodes, ["a"], tr.Policy(max_depth=2, direction=tr.OUT, max_results=2)).orderBy("depth").collect()] == ["a", "b"]
    with pytest.raises(BudgetExceeded):
        tr.walk(edges, nodes, ["a"], tr.Policy(max_depth=3, max_expansions=2))
    with pytest.raises(BudgetExceeded):
        tr.walk(edges, nodes, ["a"], tr.Policy(max_depth=1, supernode=1))
    with pytest.raises(InvalidRequest):
        tr.walk(edges, nodes, ["a"], tr.Policy(max_depth=9))
    assert {tuple(r) for r in tr.dangling(edges, nodes).collect()} == {("6", "target", "gone")}
    loop = edges.unionByName(spark.createDataFrame([("8", "e", "b", "X")], edges.schema))
    assert {r["id"] for r in tr.cyclic_edges(loop).collect()} == {"3", "5", "8"}


def test_cyclic_edges_raises_when_rounds_run_out(spark):
    chain = spark.createDataFrame([(str(i), i, i + 1) for i in range(8)], "id string, src long, dst long")
    assert tr.cyclic_edges(chain).count() == 0
    with pytest.raises(RuntimeError):
        tr.cyclic_edges(chain, rounds=2)


def test_search_modes_and_relevance(spark):
    docs = spark.createDataFrame([(1, "Red river", "the river runs red"), (2, "Blue", "a quiet red river bank"), (3, "Other", "nothing to see"), (4, None, None)], "id long, name string, body string")
    hits = lambda *a, **k: [r["doc"] for r in se.search(docs, ["name", "body"], *a, **k).collect()]
    assert hits("red river") == [1, 2]
    assert hits("red river", "phrase") == [1, 2] and hits("river runs", "phrase") == [1]
    assert hits("riv", "prefix") == [1, 2] and hits("rivver", "fuzzy") == [1, 2] and hits("rivver", "fuzzy", filters={"id": [2]}) == [2]
    assert hits("red", filters={"absent": [1]}) == []
    with pytest.raises(InvalidRequest):
        hits("x", "fuzzy", distance=3)
    with pytest.raises(BudgetExceeded):
        hits("river", max_candidates=1)
    results = spark.createDataFrame([("q1", 1, 1), ("q2", 2, 2)], "query string, doc long, rank int")
    relevant = spark.createDataFrame([("q1", 1), ("q2", 2), ("q3", 3)], "query string, doc long")
    assert se.reciprocal_rank(results, relevant).first()["mrr"] == pytest.approx(0.5)
    chunks = spark.createDataFrame([(1, 0, "nothing"), (1, 1, "before the River after")], "doc long, ordinal int, text string")
    assert se.snippets(chunks, "river").first()["snippet"] == "before the <mark>River</mark> after"
    with pytest.raises(InvalidRequest):
        se.objective_terms("what is the")
    degree = spark.createDataFrame([(1, 5), (2, 1)], "id long, degree long")
    got = se.seeds(docs, ["name", "body"], degree, "red river", k=1).collect()
    assert [r["doc"] for r in got] == [1] and not got[0]["ambiguous"]


def test_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first()["v"]
    ids = {
        "doi": ("https://doi.org/10.1000/ABC", "10.1000/abc", "11.1/x"), "arxiv": ("arXiv:2101.00001v2", "2101.00001v2", "21.1"), "pubmed": ("PMID: 123", "123", "0x"),
        "orcid": ("https://orcid.org/0000-0002-1825-0097", "0000-0002-1825-0097", "0000-0002-1825-0098"), "issn": ("0378-5955", "0378-5955", "0378-5954"), "ror": ("https://ror.org/05GQ3A412", "05gq3a412", "15gq3a412"),
    }
    for system, (text, good, bad) in ids.items():
        assert value(fn.identifier(system, F.lit(text))) == good, system
        assert value(fn.identifier(system, F.lit(bad))) is None, system
    assert value(fn.is_instant(F.lit("2024-02-03T04:05:06Z"))) and not value(fn.is_instant(F.lit("2024-02-03 04:05:06")))
    assert value(fn.traversal_cost(F.lit((1 << 63) - 1), F.lit(1), F.lit(1))) == (1 << 63) - 1
    assert value(fn.status(F.lit(" Validated "))) == "validated" and value(fn.status(F.lit("tombstoned"))) is None
    assert value(fn.sanitized_type(F.lit("located-at"))) == "LOCATED_AT" and value(fn.normalised_confidence(F.lit(50.0))) == 0.5
    outcomes = F.array(F.struct(F.lit(0.5).alias("probability"), F.lit(1.0).alias("posterior")), F.struct(F.lit(0.5).alias("probability"), F.lit(0.0).alias("posterior")))
    assert value(fn.information_gain(F.lit(0.5), outcomes)) == pytest.approx(1.0)
    r = fn.standard()
    with pytest.raises(InvalidRequest):
        r.call("confidence.clamp", [F.lit(1)], ["integer"])
    with pytest.raises(InvalidRequest):
        r.call("cti.observable_kind", [F.lit("x")], ["string"])
    assert value(r.call("cti.observable_kind", [F.lit("x")], ["string"], adapter=lambda c: F.length(c))) == 1
    with pytest.raises(NotFound):
        r.call("a.b", [], [])
    with pytest.raises(Conflict):
        r.register(fn.Spec("confidence.clamp", (), "float", lambda: None))


def test_bundles(spark, tmp_path):
    import json

    objects = [
        {"type": "threat-actor", "id": "threat-actor--1", "name": "A", "confidence": 80}, {"type": "malware", "id": "malware--1", "name": "M"},
        {"type": "relationship", "id": "relationship--1", "relationship_type": "uses", "source_ref": "threat-actor--1", "target_ref": "malware--1"},
    ]
    (tmp_path / "b.json").write_text(json.dumps({"type": "bundle", "id": "bundle--x", "objects": objects}))
    rows = bundle.read(spark, str(tmp_path / "b.json"))
    nodes, rels = bundle.nodes(rows, "t"), bundle.rels(rows, "t")
    assert {(r["id"], r["labels"][0], r["confidence"]) for r in nodes.collect()} == {("threat-actor--1", "ThreatActor", 0.8), ("malware--1", "Malware", None)}
    assert [(r["src"], r["rel_type"], r["dst"]) for r in rels.collect()] == [("threat-actor--1", "USES", "malware--1")]
    none = spark.createDataFrame([], "id string")
    out, edges = bundle.plan_export(nodes, rels, none, ["ThreatActor", "Malware"])
    first = bundle.write(out, edges, str(tmp_path / "o1"))
    assert first == bundle.write(out.repartition(3), edges, str(tmp_path / "o2"))
    assert spark.read.json(str(tmp_path / "o1")).count() == 3
    bad = spark.createDataFrame([("malware--1",)], "id string")
    with pytest.raises(Conflict):
        bundle.plan_export(nodes, rels, bad, ["Malware"])
    assert bundle.plan_export(nodes, rels, bad, ["ThreatActor", "Malware"], strict=False)[1].count() == 0
    (tmp_path / "c.json").write_text(json.dumps({"type": "bundle", "objects": [objects[0], objects[0] | {"name": "B"}]}))
    with pytest.raises(Conflict):
        bundle.read(spark, str(tmp_path / "c.json"))
    (tmp_path / "d.json").write_text("{}")
    with pytest.raises(InvalidRequest):
        bundle.read(spark, str(tmp_path / "d.json"))


def test_extraction(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.html").write_text("<p>A &amp; B</p><script>x<y</script> c")
    (tmp_path / "f/b.csv").write_text('1,"two, three"\n4,5\n')
    (tmp_path / "f/c.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "f/d.pdf").write_text("x")
    got = {r["path"][-5:]: (r["text"], r["failure"]) for r in extract.files(spark, str(tmp_path / "f")).collect()}
    assert got == {"a.htm"[:0] + "/a.html"[-5:]: ("A & B c", None), "b.csv": ("1 two, three\n4 5", None), "c.txt": (None, "not_utf8"), "d.pdf": (None, "unsupported")}
    docs = spark.createDataFrame([(1, "ab  cd\nef"), (2, ""), (3, None)], "id long, text string")
    assert [tuple(r) for r in extract.chunks(docs, "text", "id", 4).orderBy("ordinal").collect()] == [(1, 0, "ab c"), (1, 1, "d ef")]


def test_validators_and_branches(spark):
    schema = (
        "id string, kind string, status string, asserting_work string, credited_actor string, result_refs array<string>, source_refs array<string>, "
        "attempts array<struct<target_work:string,reporting_work:string>>, evidence_refs array<string>, supporting array<struct<retracted:boolean,override_reason:string>>"
    )
    rows = [
        ("a", "claim", None, "w", " ", None, None, None, None, None), ("b", "finding", "validated", None, None, ["r"], None, None, [], [(True, None), (False, None)]),
        ("c", "odd", None, None, None, None, None, None, None, None), ("d", "replication_attempt", None, None, None, None, None, [("t", "r")], None, None),
        ("e", "replication_attempt", None, None, None, None, None, [("t", "")], None, None), ("f", "result", None, None, None, None, [], None, None, None),
        ("g", "claim", "validated", "w", "x", None, None, None, ["e"], [(True, "known")]),
    ]
    assert {tuple(r) for r in ep.findings(spark.createDataFrame(rows, schema), ep.research_rules()).collect()} == {
        ("a", "RESEARCH_CLAIM_ATTRIBUTION_REQUIRED"), ("b", "EVIDENCE_REQUIRED"), ("b", "RESEARCH_RETRACTED_SUPPORT_REQUIRES_OVERRIDE"),
        ("c", "RESEARCH_NODE_TYPE_REQUIRED"), ("e", "RESEARCH_REPLICATION_ATTRIBUTION_REQUIRED"), ("f", "RESEARCH_RESULT_SOURCE_REQUIRED"),
    }
    moves = spark.createDataFrame([("candidate", "asserted"), ("candidate", "supported"), ("rejected", "asserted"), ("validated", "validated"), ("odd", "odd")], "a string, b string")
    assert [r["ok"] for r in moves.select(ep.move_allowed(F.col("a"), F.col("b")).alias("ok")).collect()] == [True, False, False, True, False]
    votes = spark.createDataFrame([("c1", "link", "supports"), ("c1", "trust", "0.7"), ("c1", "stance", "refutes"), ("c2", "trust", "0.1"), ("c3", "stance", "withholds_judgment")], "claim string, kind string, value string")
    got = {r["claim"]: (r["resolution"], r["confidence"] and round(r["confidence"], 3)) for r in ep.resolve(votes).collect()}
    assert got == {"c1": ("supported", 0.667), "c2": ("disputed", 1.0), "c3": ("unresolved", None)}
    steps = spark.createDataFrame([("p", 1, "a", "b", "tactical", 1.0), ("p", 2, "b", "c", "operational", 2.0), ("q", 1, "a", "b", "tactical", 1.0), ("q", 2, "b", "c", "strategic", 1.0)], "path string, seq int, src string, dst string, level string, score double")
    assert {r["path"]: (r["valid"], r["score"]) for r in ep.mixed_path(steps).collect()} == {"p": (True, 3.0), "q": (False, 2.0)}
    both = ["strategic_objective_assessment", "tactical_evidence_detail"]
    assert ep.resolution_level(both) == ("tactical", "ambiguous_most_detailed") and ep.resolution_level(both, "tactical")[1] == "explicit_match"
    for intents, level in ((both, "strategic"), ([], None), (["locate"], None)):
        with pytest.raises(InvalidRequest):
            ep.resolution_level(intents, level)
    hot = spark.createDataFrame([("a", False, False), ("b", True, False), ("c", False, True), ("d", False, False)], "id string, pinned boolean, dirty boolean")
    assert [r["id"] for r in ep.evictions(hot, 3).collect()] == ["d"]
    moves = spark.createDataFrame([("r", 1, "shadow", False), ("r", 2, "canonical", False), ("s", 1, "canonical", True)], "record string, seq int, tier string, audited boolean")
    assert {tuple(r) for r in ep.tiers(moves).collect()} == {("r", "shadow"), ("s", "canonical")}
    events = spark.createDataFrame([("s", 1, "n", "e1", "admit"), ("s", 2, "n", "e2", "admit"), ("s", 3, "n", None, "dead_end")], "scope string, seq int, node string, edge string, decision string")
    assert [tuple(r) for r in nv.dead_ends(events).collect()] == [("s", "e1", 1)]
    seeds = spark.createDataFrame([("a",), ("b",)], "id string")
    edges = spark.createDataFrame([("1", "a", "x"), ("2", "a", "y"), ("3", "b", "z"), ("4", "b", "x")], "id string, src string, dst string")
    assert [r["id"] for r in nv.expand(seeds, edges, max_nodes=2, max_edges=4).orderBy("id").collect()] == ["1", "2"]


def test_the_core_stands_alone():
    """Nothing outside the corpus subpackage imports it."""
    from pathlib import Path

    root = Path(rc.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b", path.read_text()), path
