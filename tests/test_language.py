"""The query language: what it reads, what it refuses, and its semantics on a small graph."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evigraph.errors import BudgetExceeded, ParseError, Unsupported
from evigraph.plans import cypher as C
from evigraph.plans.compile import rendered, run
from evigraph.sources.tables import PropertyGraph


@pytest.fixture(scope="module")
def graph(spark):
    actors = spark.createDataFrame(
        [("a1", "alpha", 3, True, ["x", "y"], None), ("a2", "beta", None, False, [], 1.0), ("a3", "gamma", 7, None, None, 2.5)],
        "id string, name string, score long, active boolean, tags array<string>, weight double",
    )
    stories = spark.createDataFrame([("n1", "one", 3.0), ("n2", "two", 4.5)], "id string, name string, score double")
    edges = spark.createDataFrame([("r1", "a1", "n1", True), ("r2", "a1", "n2", False), ("r3", "a3", "n2", True), ("r4", "a2", "gone", True)], "id string, src string, dst string, enabled boolean")
    return PropertyGraph(spark, {"Actor": lambda: actors, "Story": lambda: stories}, {"AMPLIFIES": lambda: edges})


def rows(graph, text, params=None, **more):
    return [tuple(r) for r in run(graph, text, params, **more).collect()]


def test_one_hop_drops_dangling_edges(graph):
    got = rows(graph, "MATCH (a:Actor)-[r:AMPLIFIES]->(n:Story) RETURN a, r, n ORDER BY r")
    assert got == [("a1", "r1", "n1"), ("a1", "r2", "n2"), ("a3", "r3", "n2")]


@pytest.mark.parametrize(
    "where, ids",
    [
        ("a.score = 3", ["a1"]), ("a.score = 3.0", ["a1"]), ("a.score <> 3", ["a3"]), ("a.score > 2.5", ["a1", "a3"]),
        ("a.name = 3", []), ("a.name <> 3", []), ("a.active = true", ["a1"]), ("a.active > true", []),
        ("a.score IS NULL", ["a2"]), ("a.missing IS NULL", ["a1", "a2", "a3"]), ("a.score IS NOT NULL", ["a1", "a3"]),
        ("a.score NOT IN [3]", ["a2", "a3"]), ("a.score IN [3, 7]", ["a1", "a3"]), ("a.tags IN ['x']", ["a1"]), ("a.tags NOT IN ['x']", ["a2", "a3"]),
        ("a.score = 3 OR a.name = 'beta' AND a.active = true", ["a1"]), ("(a.score = 3 OR a.name = 'beta') AND a.active = false", ["a2"]),
        ("a.score = null", []), ("a.score <> null", []), ("a.id = 'a2'", ["a2"]), ("a.weight < 2", ["a2"]),
    ],
)
def test_two_valued_predicates(graph, where, ids):
    assert [r[0] for r in rows(graph, f"MATCH (a:Actor) WHERE {where} RETURN a ORDER BY a.id")] == ids


def test_inline_properties_and_parameters(graph):
    assert rows(graph, "MATCH (a:Actor {name: 'alpha', score: 3}) RETURN a") == [("a1",)]
    assert rows(graph, "MATCH (a:Actor {nothing: 1}) RETURN a") == []
    assert rows(graph, "MATCH (a:Actor) WHERE a.name = $n RETURN a", {"n": "it's"}) == []
    with pytest.raises(ParseError):
        rows(graph, "MATCH (a:Actor) WHERE a.name = $n RETURN a")


def test_order_skip_limit_distinct(graph):
    assert [r[0] for r in rows(graph, "MATCH (a:Actor) RETURN a ORDER BY a.score")] == ["a2", "a1", "a3"]
    assert [r[0] for r in rows(graph, "MATCH (a:Actor) RETURN a ORDER BY a.score DESC")] == ["a3", "a1", "a2"]
    assert [r[0] for r in rows(graph, "MATCH (a:Actor) RETURN a ORDER BY a.score SKIP 1 LIMIT 1")] == ["a1"]
    got = rows(graph, "MATCH (a:Actor)-[r:AMPLIFIES]->(n:Story) RETURN DISTINCT n ORDER BY r LIMIT 3")
    assert sorted(got) == [("n1",), ("n2",)]


def test_aggregates(graph):
    assert rows(graph, "MATCH (a:Actor) RETURN COUNT(*), SUM(a.score), AVG(a.score), MIN(a.score), MAX(a.score)") == [(3, 10.0, 5.0, 3.0, 7.0)]
    assert rows(graph, "MATCH (a:Actor) WHERE a.name = 'none' RETURN COUNT(a), SUM(a.score)") == [(0, None)]
    assert rows(graph, "MATCH (a:Actor) RETURN SUM(a.name)") == [(None,)]


def test_products_and_rendering(graph):
    assert len(rows(graph, "MATCH (a:Actor), (n:Story) RETURN a, n")) == 6
    got = [tuple(r) for r in rendered(run(graph, "MATCH (n:Story) RETURN n.score ORDER BY n.score")).collect()]
    assert got == [("3",), ("4.5",)]
    assert rendered(run(graph, "MATCH (a:Actor {name: 'alpha'}) RETURN a.tags, a.weight")).first()[0] == "x,y"


def test_optional_match_is_match_unless_asked(graph):
    text = "OPTIONAL MATCH (a:Actor)-[r:AMPLIFIES]->(n:Story) RETURN a"
    assert len(rows(graph, text)) == 3
    assert len(rows(graph, text, outer=True)) == 4


def test_budgets_fail_as_a_whole(graph):
    with pytest.raises(BudgetExceeded):
        rows(graph, "MATCH (a:Actor) WHERE a.name = 'alpha' RETURN a", max_loaded=2)
    with pytest.raises(BudgetExceeded):
        rows(graph, "MATCH (a:Actor) RETURN a", max_returned=2)


@pytest.mark.parametrize(
    "text",
    [
        "MATCH (a) WITH a RETURN a", "MATCH (a)<-[r:X]-(b) RETURN a", "MATCH (a)-[r:X*1..2]->(b) RETURN a", "MATCH () RETURN 1", "MATCH (a:B:C) RETURN a",
        "MATCH (a) RETURN a AS b", "MATCH (a) RETURN COUNT(DISTINCT a)", "MATCH (a) RETURN COUNT(a), COUNT(*)", "MATCH (a) WHERE NOT a.x = 1 RETURN a",
        "MATCH (a)-[r:X {y: 1}]->(b) RETURN a", "MATCH (a) MATCH (b) RETURN a", "CREATE (a)-[:R]->(b)", "MATCH (a) SET a.x = 1 RETURN DISTINCT a", "UNWIND [1] RETURN a",
        "MATCH (a)-[:X]->(b)-[:Y]->(c) RETURN a",
    ],
)
def test_refused_by_name(text):
    with pytest.raises(Unsupported if "()" not in text else ParseError):
        C.parse(text)


@pytest.mark.parametrize("text", ["", "MATCH (a)", "RETURN b", "MATCH (a RETURN a", "MATCH (a) WHERE a.x ~ 1 RETURN a", "MATCH (a) RETURN a, COUNT(*)", "MATCH (a) RETURN a LIMIT -1", "MATCH (a) WHERE a.x IN [1, 'a'] RETURN a", "MATCH (a) WHERE a.x = 'a\\n' RETURN a"])
def test_parse_errors(text):
    with pytest.raises(ParseError):
        C.parse(text)


def test_strings_protect_their_marks():
    q = C.parse("MATCH (a {k: 'it\\'s \\\\ (set) }'}) RETURN a")
    assert q.patterns[0].node.props == {"k": "it's \\ (set) }"}


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_no_text_breaks_the_parser(text):
    try:
        C.parse(text)
    except ParseError:
        pass


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t "]), min_size=4, max_size=4))
def test_white_space_changes_nothing(gaps):
    a = C.parse("MATCH (a:B) WHERE a.x = 1 RETURN a")
    assert C.parse(f"MATCH{gaps[0]}(a:B){gaps[1]}WHERE a.x = 1{gaps[2]}RETURN{gaps[3]}a") == a
