"""Investigations and decision logs."""

import pytest

from evigraph.errors import Conflict, InvalidRequest, ParseError, Unsupported
from evigraph.operators import branch_log as bl
from evigraph.plans import investigate as iv

FULL = """
INVESTIGATE attribution OF Campaign("C-42")
AT TIME 2026-06-01
REQUIRE independent_sources >= 2, source_reliability >= 0.5, evidence_completeness >= 0.8
ALLOW hypotheses = false
BUDGET memory = 2 KB, latency = 3 s
RETURN assessment, proof_graph, unknowns
"""


def test_parse_and_canonical_form():
    q = iv.parse(FULL)
    assert (q.sources, q.reliability, q.allow, q.budget) == (2, 0.5, {"hypotheses": False}, {"memory": 2048, "latency": 3000})
    assert iv.parse(q.canonical()) == q
    assert [s["kind"] for s in iv.plan(q)] == ["seed_selection", "working_set", "temporal_filter", "independent_sources", "source_reliability", "evidence_completeness", "allowance", "budget", "budget", "projection"]
    with pytest.raises(Unsupported):
        iv.plan(q, {"seed_selection"})


@pytest.mark.parametrize("text", ['INVESTIGATE attribution OF Campaign("C")', 'INVESTIGATE prediction OF Campaign("C") RETURN assessment', 'INVESTIGATE attribution OF Sheet("C") RETURN assessment',
                                  'INVESTIGATE attribution OF Actor("C") MATCH (a) RETURN assessment', 'INVESTIGATE attribution OF Actor("C") RETURN x', 'INVESTIGATE attribution OF Actor("C") REQUIRE x >= 1 RETURN unknowns',
                                  'INVESTIGATE attribution OF Actor("C") BUDGET memory = 2 ms RETURN unknowns', 'INVESTIGATE attribution OF Actor("C") AT TIME today RETURN unknowns', "x"])
def test_refusals(text):
    with pytest.raises(ParseError):
        iv.parse(text)


def test_contracts_stop_an_investigation(spark):
    nodes = spark.createDataFrame(
        [("C-42", "Campaign", None, None, None), ("s1", "Source", None, None, 0.9), ("s2", "Source", None, None, 0.6), ("s3", "Source", None, None, 0.1), ("h", "Hypothesis", None, None, None)],
        "id string, kind string, valid_from string, valid_until string, reliability double",
    )
    edges = spark.createDataFrame([(str(i), "C-42", x, "ABOUT") for i, x in enumerate(["s1", "s2", "s3", "h"])], "id string, src string, dst string, rel_type string")
    got = iv.investigate(nodes, edges, FULL)
    assert got["stopped"] is None and got["response"]["assessment"]["value"]["sources"] == 2
    assert {r["id"] for r in got["response"]["proof_graph"]["value"].collect()} == {"C-42", "s1", "s2"}
    strict = iv.investigate(nodes, edges, FULL.replace(">= 2", ">= 3"))
    assert strict["stopped"] == "independent_sources" and not strict["response"]["assessment"]["available"] and strict["response"]["unknowns"]["value"] == ["independent_sources"]


def test_logs(spark):
    findings = spark.createDataFrame([("c1", "unsupported_claim"), ("c2", "unsupported_claim"), ("c1", "other")], "id string, rule string")
    log = spark.createDataFrame([("find_support", "c1", 1, "open"), ("find_support", "c2", 1, "open"), ("find_support", "c2", 2, "answered")], "kind string, target string, seq int, state string")
    assert [tuple(r) for r in bl.probes(findings, log).collect()] == [("find_support", "c2")]
    assert bl.respond(findings, "quarantine", "ann", "t").count() == 3
    with pytest.raises(InvalidRequest):
        bl.respond(findings, "ignore", "ann", "t")
    ends = spark.createDataFrame([("b0", "merge")], "branch string, decision string")
    assert bl.decide(ends, "b1", "merge", True, ["base:1", "obs:2"], 0).count() == 1
    for bad in (("b0", "discard", True, [], 0), ("b1", "merge", False, ["o"], 0), ("b1", "merge", True, ["base:1"], 0), ("b1", "merge", True, ["o"], 1)):
        with pytest.raises(Conflict):
            bl.decide(ends, *bad)
    spans = spark.createDataFrame([("a", None, 0, 9), ("b", "a", 1, 5), ("c", "b", 2, 3)], "id string, parent string, start int, end int")
    assert {r["id"]: r["depth"] for r in bl.timeline(spans).collect()} == {"a": 0, "b": 1, "c": 2}
    with pytest.raises(InvalidRequest):
        bl.timeline(spans.unionByName(spark.createDataFrame([("d", "c", 0, 3)], spans.schema)))
    nodes = spark.createDataFrame([(x,) for x in "abc"], "id string")
    edges = spark.createDataFrame([("1", "a", "b"), ("2", "b", "c")], "id string, src string, dst string")
    shown, drawn, left = bl.drawing(nodes, edges, 2, 5)
    assert shown.count() == 2 and drawn.count() == 1 and left == {"nodes": 1, "edges": 0}
    records = spark.createDataFrame([("t", True, {"a": "1"}), ("s", False, {"a": "2", "b": "3"})], "id string, target boolean, props map<string,string>")
    assert {tuple(r) for r in bl.merged_properties(records).collect()} == {("a", "1", True), ("b", "3", False)}
