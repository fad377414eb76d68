"""The query catalogue: every operator family on the Parquet tables, with equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import core as fn
from .operators import access as ac
from .operators import epistemic as ep
from .operators import mutate as mu
from .operators import navigation as nv
from .operators import records as rc
from .operators import search as se
from .operators import traverse as tr
from .operators.textindex import of_table
from .operators.memory import lexical_matches
from .operators.predicate import Filter, Group
from .plans.compile import run
from .sources import extract as ex
from .sources.tables import load, node_id

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(make):
        QUERIES[make.__name__] = make
        if sql:
            ORACLES[make.__name__] = sql
        return make

    return add


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cypher(name: str, text: str, sql: str, columns: dict[str, str], params: dict | None = None):
    """Register a query of the language; ``columns`` renames its dotted columns for SQL."""

    def make(spark, sf_dir):
        out = run(load(spark, sf_dir), text, params)
        return out.select(*[F.col(f"`{a}`").alias(b) for a, b in columns.items()])

    make.__name__ = name
    make.__doc__ = text
    query(sql)(make)


# ---------------------------------------------------------------- query language

FLAGSHIP = (
    "MATCH (c:Customer)-[r:PLACED]->(o:Order) WHERE o.totalprice >= 200000 AND c.mktsegment IN ['BUILDING','MACHINERY'] "
    "RETURN c.name, o.totalprice ORDER BY o.totalprice DESC, c.name ASC LIMIT 20"
)
cypher(
    "cy_one_hop_join", FLAGSHIP,
    "SELECT c_name AS name, o_totalprice AS totalprice FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice >= 200000 "
    "AND c_mktsegment IN ('BUILDING','MACHINERY') ORDER BY o_totalprice DESC, c_name, 'customer--' || c_custkey, 'order--' || o_orderkey LIMIT 20",
    {"c.name": "name", "o.totalprice": "totalprice"},
)
cypher(
    "cy_node_scan_filter", "MATCH (c:Customer {mktsegment: 'BUILDING'}) WHERE c.acctbal > 1000.5 RETURN c, c.name, c.acctbal",
    "SELECT 'customer--' || c_custkey AS c, c_name AS name, c_acctbal AS acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 1000.5",
    {"c": "c", "c.name": "name", "c.acctbal": "acctbal"},
)
cypher(
    "cy_in_notin_exists", "MATCH (p:Part) WHERE p.size IN [1, 5, 9] AND p.brand NOT IN ['Brand#11', 'Brand#22'] AND p.name IS NOT NULL AND p.missing IS NULL AND p.missing NOT IN [1] RETURN p, p.size, p.brand",
    "SELECT 'part--' || p_partkey AS p, p_size AS size, p_brand AS brand FROM part WHERE p_size IN (1, 5, 9) AND coalesce(p_brand NOT IN ('Brand#11', 'Brand#22'), true) AND p_name IS NOT NULL",
    {"p": "p", "p.size": "size", "p.brand": "brand"},
)
cypher(
    "cy_bool_tree", "MATCH (o:Order)-[l:CONTAINS]->(p:Part) WHERE (l.quantity > 45 AND l.returnflag = 'R') OR (l.discount = 0 AND l.linestatus <> 'O') RETURN l, l.quantity, l.discount",
    "SELECT 'contains--' || l_orderkey || '--' || l_partkey || '--' || l_linenumber AS l, l_quantity AS quantity, l_discount AS discount FROM lineitem "
    "JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE (l_quantity > 45 AND l_returnflag = 'R') OR (l_discount = 0 AND l_linestatus <> 'O')",
    {"l": "l", "l.quantity": "quantity", "l.discount": "discount"},
)
cypher(
    "cy_agg_global", "MATCH (o:Order)-[l:CONTAINS]->(p:Part) WHERE l.returnflag = 'A' RETURN COUNT(*), MIN(l.extendedprice), MAX(l.extendedprice), SUM(l.linenumber), AVG(l.linenumber)",
    "SELECT count(*) AS n, min(l_extendedprice) AS least, max(l_extendedprice) AS most, sum(l_linenumber)::DOUBLE AS total, sum(l_linenumber)::DOUBLE / count(*) AS mean FROM lineitem "
    "JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A'",
    {"count": "n", "min(l.extendedprice)": "least", "max(l.extendedprice)": "most", "sum(l.linenumber)": "total", "avg(l.linenumber)": "mean"},
)
cypher(
    "cy_type_mismatch", "MATCH (s:Supplier) WHERE s.name = 5 OR s.acctbal = 'x' OR s.suppkey >= 3.5 RETURN s.suppkey",
    "SELECT s_suppkey AS suppkey FROM supplier WHERE s_suppkey >= 3.5", {"s.suppkey": "suppkey"},
)
cypher(
    "cy_distinct_after_limit", "MATCH (o:Order) RETURN DISTINCT o.orderstatus ORDER BY o.orderdate ASC, o.orderkey ASC LIMIT 40",
    "SELECT DISTINCT o_orderstatus AS orderstatus FROM (SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 40)",
    {"o.orderstatus": "orderstatus"},
)
cypher(
    "cy_skip_limit", "MATCH (s:Supplier) RETURN s.name, s.acctbal ORDER BY s.acctbal DESC SKIP 3 LIMIT 5",
    "SELECT s_name AS name, s_acctbal AS acctbal FROM supplier ORDER BY s_acctbal DESC, 'supplier--' || s_suppkey LIMIT 5 OFFSET 3",
    {"s.name": "name", "s.acctbal": "acctbal"},
)
cypher(
    "cy_cross_match", "MATCH (r:Region), (n:Nation) WHERE n.regionkey >= 2 AND r.regionkey < 2 RETURN r.name, n.name",
    "SELECT r_name AS region, n_name AS nation FROM region, nation WHERE n_regionkey >= 2 AND r_regionkey < 2",
    {"r.name": "region", "n.name": "nation"},
)
cypher(
    "cy_params", "MATCH (o:Order) WHERE o.totalprice < $most AND o.orderstatus IN $states RETURN o, o.totalprice",
    "SELECT 'order--' || o_orderkey AS o, o_totalprice AS totalprice FROM orders WHERE o_totalprice < 20000 AND o_orderstatus IN ('O', 'P')",
    {"o": "o", "o.totalprice": "totalprice"}, {"most": 20000, "states": ["O", "P"]},
)
cypher(
    "cy_time_compare", "MATCH (o:Order) WHERE o.orderdate >= '1997-01-01T00:00:00Z' AND o.orderdate < '1997-02-01T00:00:00Z' RETURN o.orderkey",
    "SELECT o_orderkey AS orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-02-01'", {"o.orderkey": "orderkey"},
)
cypher(
    "cy_native_id", "MATCH (n:Nation)-[r:IN_REGION]->(g:Region) WHERE g.id = 'region--1' RETURN n, r, g",
    "SELECT 'nation--' || n_nationkey AS n, 'in_region--' || n_nationkey || '--' || n_regionkey AS r, 'region--1' AS g FROM nation WHERE n_regionkey = 1",
    {"n": "n", "r": "r", "g": "g"},
)


@query("SELECT CAST(CASE WHEN s_acctbal = floor(s_acctbal) THEN CAST(CAST(s_acctbal AS BIGINT) AS VARCHAR) ELSE CAST(s_acctbal AS VARCHAR) END AS VARCHAR) AS acctbal, s_name AS name FROM supplier")
def cy_rendered(spark, sf_dir):
    out = run(load(spark, sf_dir), "MATCH (s:Supplier) RETURN s.acctbal, s.name").toDF("acctbal", "name")
    from .plans.compile import rendered

    return rendered(out)


# ---------------------------------------------------------------- scans and indexes

@query("SELECT 'customer--' || c_custkey AS id, c_name AS name FROM customer WHERE c_custkey = 7")
def sc_point_read(spark, sf_dir):
    return load(spark, sf_dir).node("customer--7").select("id", "name")


@query("SELECT 'order--' || l_orderkey AS src, 'part--' || l_partkey AS dst FROM lineitem WHERE l_orderkey = 1")
def sc_outgoing(spark, sf_dir):
    return load(spark, sf_dir).incident("CONTAINS", source="order--1").select("src", "dst")


@query("SELECT 'nation--' || n_nationkey AS src, 'region--' || n_regionkey AS dst FROM nation WHERE n_regionkey = 2")
def sc_incoming(spark, sf_dir):
    return load(spark, sf_dir).incident("IN_REGION", target="region--2").select("src", "dst")


@query("SELECT 'lives_in--' || c_custkey || '--' || c_nationkey AS id FROM customer WHERE c_custkey = 7 AND c_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 7)")
def sc_between(spark, sf_dir):
    g = load(spark, sf_dir)
    home = g.incident("LIVES_IN", source="customer--7").first()["dst"]
    return g.incident("LIVES_IN", source="customer--7", target=home).select("id")


@query("SELECT 'in_region' AS kind, count(*) AS n FROM nation UNION ALL SELECT 'placed', count(*) FROM orders UNION ALL SELECT 'contains', count(*) FROM lineitem "
       "UNION ALL SELECT 'lives_in', count(*) FROM customer UNION ALL SELECT 'based_in', count(*) FROM supplier UNION ALL SELECT 'performed', count(*) FROM events "
       "UNION ALL SELECT 'supplied_by', count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)")
def sc_type_index(spark, sf_dir):
    return load(spark, sf_dir).rels().groupBy(F.lower("rel_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- records

def parts(spark, sf_dir):
    return rc.to_records(load(spark, sf_dir).nodes("Part"), "Part")


def events(spark, sf_dir):
    return rc.to_records(load(spark, sf_dir).nodes("Event"), "Event")


def orders(spark, sf_dir):
    return rc.to_records(load(spark, sf_dir).nodes("Order"), "Order")


def lines(spark, sf_dir):
    """Orders with their lines as a list of structs: one shuffle by order."""
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(F.struct(F.col("l_linenumber").alias("number"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("price"))).alias("lines")
    )
    return rc.to_records(rows.select(node_id("Order", "l_orderkey").alias("id"), F.col("l_orderkey").alias("orderkey"), "lines"), "Order")


@query("SELECT 'part--' || p_partkey AS id, p_brand AS brand, p_retailprice AS price FROM part WHERE p_size >= 10 ORDER BY p_retailprice DESC, id LIMIT 50")
def kd_list_order(spark, sf_dir):
    read_ = rc.Read(kinds=["part"], predicate=Filter("size", "gte", 10), order=[("retailprice", True)], limit=50)
    return rc.listed(parts(spark, sf_dir), read_).select("id", F.col("body.brand").alias("brand"), F.col("body.retailprice").alias("price"))


@query("SELECT 'part--' || p_partkey AS id, p_type AS type FROM part WHERE regexp_full_match(p_type, '.*(E|A).*', 's') AND regexp_full_match(p_brand, 'Brand#.*1.', 's')")
def kd_wildcard(spark, sf_dir):
    rule = Group("all", [Group("any", [Filter("type", "wildcard", "*E*"), Filter("type", "wildcard", "*A*")]), Filter("brand", "wildcard", "Brand#*1?")])
    return rc.selected(parts(spark, sf_dir), rc.Read(predicate=rule)).select("id", F.col("body.type").alias("type"))


@query("SELECT 'part--' || p_partkey AS id FROM part WHERE p_brand <> 'Brand#11' AND p_size NOT IN (1, 2, 3) AND p_brand IN ('Brand#12', 'Brand#13', 'Brand#21', 'Brand#33')")
def kd_filters(spark, sf_dir):
    rule = Group("all", [
        Filter("brand", "not_equal", "Brand#11"), Filter("size", "not_in", [1, 2, 3]), Filter("brand", "in", ["Brand#12", "Brand#13", "Brand#21", "Brand#33"]),
        Filter("absent", "not_exists"), Filter("name", "exists"), Group("any", [Filter("size", "equal", 1.0), Filter("size", "gt", 0)]),
    ])
    return rc.selected(parts(spark, sf_dir), rc.Read(predicate=rule)).select("id")


@query("SELECT 'order--' || l_orderkey AS id FROM lineitem WHERE l_quantity > 48 AND l_returnflag = 'R' GROUP BY l_orderkey")
def kd_nested_predicate(spark, sf_dir):
    rule = Filter("lines", "nested", Group("all", [Filter("quantity", "gt", 48.0), Filter("flag", "equal", "R")]))
    return rc.selected(lines(spark, sf_dir), rc.Read(predicate=rule)).select("id")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def kd_json_path(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.struct(F.from_json("props", "k bigint").alias("props")).alias("doc"))
    found = rc.selected(rc.to_records(rows, "Event"), rc.Read(predicate=Filter("doc.props.k", "gte", 50)))
    return found.select(F.col("id").alias("event_id"), F.col("body.doc.props.k").alias("k"))


@query("SELECT 'order--' || o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_totalprice < 150000 OR (o_totalprice = 150000 AND 'order--' || o_orderkey > 'order--5') ORDER BY o_totalprice DESC, id LIMIT 25")
def kd_keyset_page2(spark, sf_dir):
    rows = orders(spark, sf_dir)
    order = [("totalprice", True)]
    later = rows.where(rc.after(rows, order, (150000.0, "order--5")))
    return later.orderBy(*rc.order_keys(rows, order)).limit(25).select("id", F.col("body.totalprice").alias("price"))


@query("SELECT count(*) AS count FROM events WHERE event_type = 'purchase' AND value > 10")
def kd_count(spark, sf_dir):
    rule = Group("all", [Filter("event_type", "equal", "purchase"), Filter("value", "gt", 10.0)])
    return rc.counted(events(spark, sf_dir), rc.Read(predicate=rule))


def aggregated(records, plan, predicate=None):
    return rc.aggregate_records(records, rc.Read(predicate=predicate), plan)


@query("SELECT count(DISTINCT user_id) AS value FROM events")
def kd_cardinality(spark, sf_dir):
    return aggregated(events(spark, sf_dir), rc.Aggregation("cardinality", "user_id"))


@query("""SELECT event_type AS key, count(*) AS count FROM events GROUP BY event_type ORDER BY count DESC, key LIMIT 3""")
def kd_terms(spark, sf_dir):
    return aggregated(events(spark, sf_dir), rc.Aggregation("terms", "event_type", limit=3))


@query("SELECT p_size AS key, count(*) AS count FROM part GROUP BY p_size ORDER BY count DESC, '{\"key\":' || p_size || '}' LIMIT 10")
def kd_terms_number(spark, sf_dir):
    return aggregated(parts(spark, sf_dir), rc.Aggregation("terms", "size", limit=10))


@query("SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS key, count(*) AS count FROM events GROUP BY key")
def kd_hist_hour(spark, sf_dir):
    return aggregated(events(spark, sf_dir), rc.Aggregation("date_histogram", "ts", step="hour"))


@query("SELECT CAST(floor((epoch(ts) + 5400) / 86400) * 86400 - 5400 AS BIGINT) AS key, count(*) AS count FROM events GROUP BY key")
def kd_hist_day_offset(spark, sf_dir):
    return aggregated(events(spark, sf_dir), rc.Aggregation("date_histogram", "ts", step="day", offset_minutes=90))


@query("WITH h AS (SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS key, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY key), "
       "e AS (SELECT unnest(generate_series((SELECT min(key) FROM h), (SELECT max(key) FROM h), 3600::BIGINT)) AS key) "
       "SELECT e.key, coalesce(n, 0) AS count FROM e LEFT JOIN h ON h.key = e.key")
def kd_hist_gap_fill(spark, sf_dir):
    return aggregated(events(spark, sf_dir), rc.Aggregation("date_histogram", "ts", step="hour", fill=True), Filter("event_type", "equal", "error"))


@query("SELECT 'maximum' AS kind, max(o_totalprice) AS value FROM orders UNION ALL SELECT 'minimum', min(o_totalprice) FROM orders "
       "UNION ALL SELECT 'sum', sum(o_custkey)::DOUBLE FROM orders UNION ALL SELECT 'average', sum(o_custkey)::DOUBLE / count(*) FROM orders")
def kd_metrics(spark, sf_dir):
    out = None
    for kind, field in (("maximum", "totalprice"), ("minimum", "totalprice"), ("sum", "custkey"), ("average", "custkey")):
        one = aggregated(orders(spark, sf_dir), rc.Aggregation(kind, field)).select(F.lit(kind).alias("kind"), "value")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT o_orderstatus AS key, count(*) AS count FROM orders WHERE o_totalprice > 100000 GROUP BY key ORDER BY count DESC, key LIMIT 10")
def kd_filter_agg(spark, sf_dir):
    return aggregated(orders(spark, sf_dir), rc.Aggregation("filter", predicate=Filter("totalprice", "gt", 100000), inner=rc.Aggregation("terms", "orderstatus")))


@query("SELECT l_returnflag AS key, count(*) AS count FROM lineitem WHERE l_quantity >= 25 GROUP BY key ORDER BY count DESC, key LIMIT 10")
def kd_nested(spark, sf_dir):
    inner = rc.Aggregation("filter", predicate=Filter("quantity", "gte", 25), inner=rc.Aggregation("terms", "flag"))
    return aggregated(lines(spark, sf_dir), rc.Aggregation("nested", "lines", inner=inner))


@query("SELECT count(DISTINCT l_orderkey) AS value FROM lineitem WHERE l_quantity = 50")
def kd_reverse_nested(spark, sf_dir):
    inner = rc.Aggregation("filter", predicate=Filter("quantity", "equal", 50.0), inner=rc.Aggregation("reverse_nested", inner=rc.Aggregation("count")))
    return aggregated(lines(spark, sf_dir), rc.Aggregation("nested", "lines", inner=inner))


ACCESS_SQL = (
    "CASE WHEN c_custkey % 11 = 0 THEN false WHEN c_custkey % 7 = 0 THEN true WHEN c_nationkey IN (3, 4) THEN true WHEN c_custkey % 2 = 0 THEN false ELSE true END"
)


def guarded(spark, sf_dir):
    """Customers with access metadata from their keys: some marked, some owned by the caller, some of an organisation."""
    rows = load(spark, sf_dir).nodes("Customer")
    none = F.array().cast("array<string>")
    even = F.col("custkey") % 2 == 0
    meta = F.struct(
        F.when(F.col("custkey") % 11 == 0, F.array(F.lit("secret"))).otherwise(none).alias("markings"), none.alias("tenants"), none.alias("denied"),
        F.when(F.col("custkey") % 7 == 0, F.lit("ann")).when(even, F.lit("bob")).alias("owner"), none.alias("creators"), none.alias("members"),
        none.alias("authorities"), F.lit(False).alias("public"), none.alias("shared"),
        F.when(even & F.col("nationkey").isin(3, 4), F.array(F.lit("org"))).otherwise(none).alias("organisations"), F.lit(False).alias("malformed"),
    )
    return rc.to_records(rows, "Customer").withColumn("access", F.lit(None)).drop("access"), rows.withColumn("access", meta)


@query(f"SELECT c_mktsegment AS key, count(*) AS count FROM customer WHERE {ACCESS_SQL} GROUP BY key ORDER BY count DESC, key LIMIT 10")
def kd_access_filtered_terms(spark, sf_dir):
    policy = ac.compile_policy(ac.Context(user="ann", organisations=["org"]))
    rows = guarded(spark, sf_dir)[1].where(ac.allowed(policy, F.col("access"))).drop("access")
    return aggregated(rc.to_records(rows, "Customer"), rc.Aggregation("terms", "mktsegment"))


def digest_sql(columns: str, source: str) -> str:
    """SQL of :func:`records.fingerprint` over text columns: a count and a digest."""
    sums = ", ".join(f"coalesce(sum(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT), 0)::VARCHAR" for i in range(4))
    return f"SELECT count(*) AS rows, sha256(concat_ws(',', count(*)::VARCHAR, {sums})) AS digest FROM (SELECT sha256(concat_ws(chr(31), {columns})) AS h FROM {source})"


@query(digest_sql("'order--' || o_orderkey, '1'", "orders"))
def dg_digest(spark, sf_dir):
    return rc.fingerprint(orders(spark, sf_dir), "id", "revision")


@query("SELECT min(CASE WHEN c * 100 >= n * 50 THEN b END) AS p50, min(CASE WHEN c * 100 >= n * 95 THEN b END) AS p95, min(CASE WHEN c * 100 >= n * 99 THEN b END) AS p99 FROM ("
       "SELECT b, sum(count(*)) OVER (ORDER BY b) AS c, sum(count(*)) OVER () AS n FROM (SELECT CASE WHEN value <= 5 THEN 5.0::DOUBLE WHEN value <= 20 THEN 20.0 WHEN value <= 50 THEN 50.0 WHEN value <= 100 THEN 100.0 ELSE 500.0 END AS b FROM events) GROUP BY b)")
def kd_percentiles(spark, sf_dir):
    return rc.percentiles(read(spark, sf_dir, "events"), "value", [5, 20, 50, 100, 500])


# ---------------------------------------------------------------- graph

@query("SELECT 'nation--' || n_nationkey AS id FROM nation WHERE n_regionkey = 1 ")
def gr_neighbors(spark, sf_dir):
    g = load(spark, sf_dir)
    return tr.neighbours(g.edges(["IN_REGION"]), g.nodes("Nation").unionByName(g.nodes("Region"), allowMissingColumns=True), ["region--1"]).select("id")


@query("WITH n AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) "
       "SELECT 'region--1' AS id, 0 AS depth UNION ALL SELECT 'nation--' || n_nationkey, 1 FROM n UNION ALL SELECT 'customer--' || c_custkey, 2 FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n) "
       "UNION ALL SELECT 'order--' || o_orderkey, 3 FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN (SELECT n_nationkey FROM n)")
def gr_bfs_depth3(spark, sf_dir):
    g = load(spark, sf_dir)
    nodes = None
    for label in ("Region", "Nation", "Customer", "Order"):
        part = g.nodes(label).select("id")
        nodes = part if nodes is None else nodes.unionByName(part)
    edges = g.edges(["IN_REGION", "LIVES_IN", "PLACED"])
    policy = tr.Policy(max_depth=3, max_results=None, max_expansions=None, supernode=None)
    return tr.walk(edges, nodes, ["region--1"], policy).select("id", "depth")


@query("SELECT 'in_region--' || n_nationkey || '--' || n_regionkey AS id FROM nation WHERE n_regionkey = 0 UNION ALL "
       "SELECT 'based_in--' || s_suppkey || '--' || s_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 0")
def gr_subgraph(spark, sf_dir):
    g = load(spark, sf_dir)
    nodes = g.nodes("Region").select("id").unionByName(g.nodes("Nation").select("id")).unionByName(g.nodes("Supplier").select("id"))
    edges = g.edges(["IN_REGION", "BASED_IN"])
    reached = tr.walk(edges, nodes, ["region--0"], tr.Policy(max_depth=2, max_results=None, max_expansions=None, supernode=None))
    return tr.subgraph(edges, reached).select("id")


@query("SELECT id, count(*) AS degree FROM (SELECT 'order--' || l_orderkey AS id FROM lineitem UNION ALL SELECT 'part--' || l_partkey FROM lineitem) GROUP BY id")
def gr_degree(spark, sf_dir):
    return tr.degrees(load(spark, sf_dir).edges(["CONTAINS"]))


@query("SELECT 'part--' || l_partkey AS id, count(*) AS degree FROM lineitem GROUP BY l_partkey HAVING count(*) > 40")
def gr_supernode(spark, sf_dir):
    return tr.crowded(tr.directed(load(spark, sf_dir).edges(["CONTAINS"]), tr.IN), 40)


@query("SELECT 'placed--' || o_custkey || '--' || o_orderkey AS rel, 'source' AS side, 'customer--' || o_custkey AS missing FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0)")
def gr_dangling(spark, sf_dir):
    g = load(spark, sf_dir)
    nodes = g.nodes("Customer").where("acctbal >= 0").select("id").unionByName(g.nodes("Order").select("id"))
    return tr.dangling(g.edges(["PLACED"]), nodes)


@query("SELECT 'based_in--' || s_suppkey || '--' || s_nationkey AS rel, 'BASED_IN' AS rel_type, 'Supplier' AS source_kind, 'Nation' AS target_kind FROM supplier")
def gr_schema_check(spark, sf_dir):
    g = load(spark, sf_dir)
    kinds = None
    for label in ("Customer", "Supplier", "Nation", "Region"):
        part = g.nodes(label).select("id", F.lit(label).alias("kind"))
        kinds = part if kinds is None else kinds.unionByName(part)
    rules = {"LIVES_IN": (("Customer",), ("Nation",)), "IN_REGION": (("Nation",), ("Region",)), "BASED_IN": (("Supplier",), ("Region",))}
    return tr.bad_ends(g.edges(list(rules)), kinds, rules)


@query("SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0")
def gr_authorised_edges(spark, sf_dir):
    g = load(spark, sf_dir)
    nodes = g.nodes("Customer").where("acctbal > 0").select("id").unionByName(g.nodes("Order").select("id"))
    return ac.visible_edges(g.edges(["PLACED"]), nodes).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT e_src AS src, e_dst AS dst FROM (SELECT (user_id + 1) % 5 AS e_dst, user_id % 5 AS e_src FROM events) GROUP BY ALL")
def gr_cycle(spark, sf_dir):
    ring = read(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("a"), ((F.col("user_id") + 1) % 5).alias("b")).distinct()
    tail = spark.createDataFrame([(100, 0), (1, 101), (101, 102)], "a long, b long")
    edges = ring.unionByName(tail).select(F.concat_ws("-", "a", "b").alias("id"), F.col("a").alias("src"), F.col("b").alias("dst"))
    return tr.cyclic_edges(edges).select("src", "dst")


# ---------------------------------------------------------------- search

def text_index(spark, sf_dir):
    """The index of the documents' texts, built once for the files as they are."""
    return of_table(spark, tr.shared_folder(spark), f"{sf_dir}/documents.parquet", ["text"], "doc_id")


TERMS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: strlen(x) >= 2)"


@query(f"""WITH d AS (SELECT doc_id AS doc, {TERMS} AS w FROM documents),
c AS (SELECT doc, len(w)::DOUBLE AS n, len(list_filter(w, lambda x: x = 'the'))::DOUBLE AS a, len(list_filter(w, lambda x: x = 'with'))::DOUBLE AS b FROM d),
s AS (SELECT count(*)::DOUBLE AS docs, avg(n) AS mean, sum((a > 0)::INT)::DOUBLE AS da, sum((b > 0)::INT)::DOUBLE AS db FROM c)
SELECT doc, round(ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score
FROM c, s WHERE a > 0 AND b > 0""")
def ft_bm25(spark, sf_dir):
    return text_index(spark, sf_dir).bm25(["the", "with"]).select("doc", F.round("score", 6).alias("score"))


@query(f"WITH d AS (SELECT doc_id AS doc, {TERMS} AS w FROM documents) SELECT doc, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the'))::BIGINT AS hits FROM d WHERE len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) > 0")
def ft_phrase(spark, sf_dir):
    return text_index(spark, sf_dir).phrase("text", "Of the")


@query(f"SELECT doc_id AS doc, len(list_filter(list_distinct({TERMS}), lambda x: starts_with(x, 'then')))::BIGINT AS hits FROM documents WHERE len(list_filter({TERMS}, lambda x: starts_with(x, 'then'))) > 0")
def ft_prefix(spark, sf_dir):
    return text_index(spark, sf_dir).prefix("text", "then")


@query(f"SELECT doc_id AS doc, len(list_filter(list_distinct({TERMS}), lambda x: abs(len(x) - 4) <= 1 AND levenshtein(x, 'that') <= 1))::BIGINT AS hits FROM documents WHERE len(list_filter({TERMS}, lambda x: abs(len(x) - 4) <= 1 AND levenshtein(x, 'that') <= 1)) > 0")
def ft_fuzzy(spark, sf_dir):
    return text_index(spark, sf_dir).fuzzy("text", "that", 1)


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TERMS}) AS term FROM documents) GROUP BY term")
def ft_index_rebuild(spark, sf_dir):
    return text_index(spark, sf_dir).table("terms")


@query("SELECT doc_id AS id, ((contains(lower(text), 'token'))::INT + (contains(lower(text), 'phone'))::INT + (contains(lower(text), 'with'))::INT)::BIGINT AS matches FROM documents WHERE contains(lower(text), 'token') OR contains(lower(text), 'phone') OR contains(lower(text), 'with')")
def mem_recall_terms(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("text"))
    return lexical_matches(rows, se.objective_terms("token for the phone") + ["with"])


@query("SELECT conv_id || '-' || turn AS id, (contains(lower(text), 'the')::INT + contains(lower(text), 'que')::INT)::BIGINT AS matches FROM conversations WHERE contains(lower(text), 'the') OR contains(lower(text), 'que')")
def mem_recall(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.lower("text").alias("text"))
    return lexical_matches(rows, ["the", "que"])


SEED_STATUS = "CASE doc_id % 6 WHEN 0 THEN 'validated' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'needs_evidence' WHEN 3 THEN 'rejected' WHEN 4 THEN 'candidate' END"


@query(f"""WITH d AS (SELECT doc_id AS doc, {TERMS} AS w, doc_id % 5 AS degree, {SEED_STATUS} AS status, CASE WHEN doc_id % 4 > 0 THEN doc_id % 4 / 4.0::DOUBLE END AS confidence FROM documents WHERE doc_id % 6 <> 3),
c AS (SELECT *, len(w)::DOUBLE AS n, len(list_filter(w, lambda x: x = 'the'))::DOUBLE AS a, len(list_filter(w, lambda x: x = 'que'))::DOUBLE AS b FROM d),
s AS (SELECT count(*)::DOUBLE AS docs, avg(n) AS mean, sum((a > 0)::INT)::DOUBLE AS da, sum((b > 0)::INT)::DOUBLE AS db, max(degree) AS most FROM c),
l AS (SELECT *, ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)) AS s FROM c, s WHERE b > 0),
r AS (SELECT doc, 0.70::DOUBLE * (s / (s + 2.0::DOUBLE)) + 0.15::DOUBLE * (ln(1 + degree) / ln(1 + most)) + 0.10::DOUBLE * coalesce(confidence, 0.5)
  + 0.05::DOUBLE * CASE status WHEN 'validated' THEN 1.0::DOUBLE WHEN 'needs_review' THEN 0.7 WHEN 'needs_evidence' THEN 0.6 ELSE 0.5 END AS score FROM l),
o AS (SELECT doc, score, row_number() OVER (ORDER BY score DESC, doc) AS rank, lead(score) OVER (ORDER BY score DESC, doc) AS following FROM r)
SELECT doc, round(score, 6) AS score, rank, rank = 10 AND coalesce(abs(score - following) < 1e-9, false) AS ambiguous FROM o WHERE rank <= 10""")
def sd_hybrid_seed(spark, sf_dir):
    n = F.col("doc_id")
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", "text", F.when(n % 4 > 0, n % 4 / 4.0).alias("confidence"),
        F.when(n % 6 == 0, "validated").when(n % 6 == 1, "needs_review").when(n % 6 == 2, "needs_evidence").when(n % 6 == 3, "rejected").when(n % 6 == 4, "candidate").alias("status"),
    )
    degree = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (n % 5).alias("degree")).where("id % 6 <> 3")
    return se.seeds(docs, ["text"], degree, "find the que", "doc_id", 10).select("doc", F.round("score", 6).alias("score"), "rank", "ambiguous")


@query("SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<(script)\\b.*?</script\\s*>|<(style)\\b.*?</style\\s*>', ' ', 'gis'), '<[^>]*>', ' ', 'gs'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM pages")
def fx_html_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", ex.html_text(F.col("html")).alias("text"))


@query("WITH t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents), n AS (SELECT doc_id, t, unnest(range(0, CAST(ceil(length(t) / 1000.0) AS BIGINT))) AS i FROM t WHERE length(t) > 0) "
       "SELECT doc_id, i::INT AS ordinal, substr(t, i * 1000 + 1, 1000) AS chunk FROM n")
def fx_chunks(spark, sf_dir):
    return ex.chunks(read(spark, sf_dir, "documents"), "text", "doc_id", 1000)


# ---------------------------------------------------------------- functions

@query("SELECT o_orderkey AS id, strlen(o_orderpriority)::BIGINT AS support, least(greatest(o_totalprice / 200000, 0), 1) AS clamped, (CASE WHEN o_orderpriority = o_orderstatus THEN 1 ELSE 0 END)::BIGINT AS overlap, least(greatest(o_custkey - 50, 0), 100)::BIGINT AS score FROM orders")
def fn_core(spark, sf_dir):
    r = fn.standard()
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), r.call("evidence.supporting_count", [F.col("o_orderpriority")], ["string"]).alias("support"),
        r.call("confidence.clamp", [F.col("o_totalprice") / 200000], ["float"]).alias("clamped"),
        r.call("temporal.window_overlap_days", [F.col("o_orderpriority"), F.col("o_orderstatus")], ["string", "string"]).alias("overlap"),
        r.call("coordination.window_score", [F.col("o_custkey") - 50], ["integer"]).cast("long").alias("score"),
    )


@query("SELECT l_orderkey AS o, l_linenumber AS n, CASE WHEN l_discount < 0.02 THEN 'below' WHEN l_discount < 0.07 THEN 'validated' ELSE 'exportable' END AS band, "
       "CASE l_returnflag WHEN 'A' THEN '2' WHEN 'R' THEN '3' ELSE 'unrated' END AS level, l_discount <= 1 AND 1 <= l_quantity AS holds FROM lineitem")
def fn_domain(spark, sf_dir):
    design = F.when(F.col("l_returnflag") == "A", "randomized_controlled_trial").when(F.col("l_returnflag") == "R", "case_control_study")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), fn.confidence_band(F.col("l_discount"), 0.02, 0.07).alias("band"),
        fn.evidence_level(design).alias("level"), fn.interval_contains_null(F.lit("ratio"), F.col("l_discount"), F.col("l_quantity")).alias("holds"),
    )


@query("SELECT l_orderkey AS o, l_linenumber AS n, round(CASE WHEN l_discount <= 0 THEN 0.0 ELSE -l_discount * log2(l_discount) - (1 - l_discount) * log2(1 - l_discount) END, 9) AS h FROM lineitem")
def fn_entropy(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.round(fn.entropy(F.col("l_discount")), 9).alias("h"))


@query("SELECT event_id AS id, (('0x' || substr(sha256('route|' || user_id), 1, 15))::BIGINT % 10000)::INT AS bucket FROM events")
def fn_routing(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), nv.bucket(F.lit("route"), F.col("user_id").cast("string")).alias("bucket"))


# ---------------------------------------------------------------- time, claims, branches

def facts(spark, sf_dir):
    """Orders as facts: valid from the order's date until 90 days later, open for status O."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("fact_id"), F.col("o_custkey").alias("seq"), F.col("o_orderdate").alias("valid_from"),
        F.when(F.col("o_orderstatus") != "O", F.expr("o_orderdate + interval 90 days")).alias("valid_to"),
        F.expr("o_orderdate + interval 2 days").alias("transaction_time"),
    )


@query("SELECT o_orderkey AS fact_id FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-01' AND (o_orderstatus = 'O' OR o_orderdate + INTERVAL 90 DAY > TIMESTAMP '1996-06-01') AND o_orderdate + INTERVAL 2 DAY <= TIMESTAMP '1996-05-20'")
def bt_as_of(spark, sf_dir):
    at = lambda x: F.to_timestamp_ntz(F.lit(x))
    return ep.as_of(facts(spark, sf_dir), at("1996-06-01 00:00:00"), at("1996-05-20 00:00:00")).select("fact_id")


@query("SELECT fact, seq FROM (SELECT o_custkey AS fact, o_orderkey AS seq, o_orderdate AS t, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) WHERE t <= p")
def bt_history(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("fact_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").alias("transaction_time"))
    return ep.bad_assertions(rows).select(F.col("fact_id").alias("fact"), "seq")


def supports(spark, sf_dir):
    """Documents support the claim of their source; labelled ones are evidence."""
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("src"), F.concat(F.col("source"), F.lit("-"), F.col("lang")).alias("dst"), F.lit("SUPPORTS").alias("rel_type"))


@query("SELECT id, 'unsupported_claim' AS rule FROM (SELECT DISTINCT source || '-' || lang AS id FROM documents) c WHERE NOT EXISTS (SELECT 1 FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1 AND d.source || '-' || d.lang = c.id)")
def ep_unsupported(spark, sf_dir):
    s = supports(spark, sf_dir)
    kinds = read(spark, sf_dir, "labels").where("toxic = 1").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), F.lit("Evidence").alias("kind"))
    return ep.unsupported_claims(s.select(F.col("dst").alias("id")).distinct(), s, kinds)


@query("SELECT lang AS id, 'circular_source' AS rule FROM (SELECT lang, count(DISTINCT doc_id) AS n, count(DISTINCT CASE WHEN lang = 'es' THEN 'one' ELSE source END) AS s FROM documents GROUP BY lang) WHERE n >= 2 AND s = 1")
def ep_circular(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    doc = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    s = docs.select(doc.alias("src"), F.col("lang").alias("dst"), F.lit("SUPPORTS").alias("rel_type"))
    r = docs.select(F.when(F.col("lang") == "es", "one").otherwise(F.col("source")).alias("src"), doc.alias("dst"), F.lit("REPORTS").alias("rel_type"))
    return ep.circular_sources(s, r)


@query("SELECT claim, supports, refutes, CASE WHEN supports > refutes THEN 'supported' WHEN refutes > supports THEN 'disputed' ELSE 'unresolved' END AS resolution, "
       "CASE WHEN supports + refutes > 0 THEN greatest(supports, refutes) / (supports + refutes)::DOUBLE END AS confidence FROM ("
       "SELECT event_id // 3 AS claim, count(*) FILTER (event_type = 'view' OR (event_type = 'click' AND event_id % 2 = 0) OR (event_type = 'purchase' AND value >= 60)) AS supports, "
       "count(*) FILTER ((event_type = 'error' AND event_id % 3 < 2) OR (event_type = 'purchase' AND value < 60)) AS refutes FROM events GROUP BY claim)")
def ep_resolve(spark, sf_dir):
    kind, n = F.col("event_type"), F.col("event_id")
    return ep.resolve(read(spark, sf_dir, "events").select(
        F.floor(n / 3).alias("claim"),
        F.when(kind == "purchase", "trust").when(kind == "view", "link").otherwise("stance").alias("kind"),
        F.when(kind == "purchase", (F.col("value") / 100).cast("string")).when(kind == "view", "supports")
        .when(kind == "click", F.when(n % 2 == 0, "accepts").otherwise("withholds_judgment"))
        .when(kind == "error", F.when(n % 3 == 0, "rejects").when(n % 3 == 1, "disputes").otherwise("withholds_judgment"))
        .otherwise("withholds_judgment").alias("value"),
    ))


@query("SELECT l_partkey AS finding, CASE WHEN g = n THEN 'replicated' WHEN b = n THEN 'failed_to_replicate' WHEN g > 0 AND b > 0 THEN 'mixed' ELSE 'inconclusive' END AS status FROM (SELECT l_partkey, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS g, count(*) FILTER (l_returnflag = 'R') AS b FROM lineitem GROUP BY l_partkey)")
def ep_replication(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("finding"), F.when(F.col("l_returnflag") == "A", "successful").when(F.col("l_returnflag") == "R", "failed").otherwise("inconclusive").alias("outcome"))
    return ep.replication(rows)


def observations(spark, sf_dir):
    """Events as assessments: an hour is an observation, a type a branch."""
    return read(spark, sf_dir, "events").where("event_type in ('click', 'view', 'error')").select(
        (F.col("event_id") % 97).alias("observation"), F.col("event_type").alias("branch"), F.when(F.col("value") > 50, "supports").otherwise("contradicts").alias("effect"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"),
    )


@query("WITH o AS (SELECT event_id % 97 AS o, event_type AS b, CASE WHEN value > 50 THEN 'supports' ELSE 'contradicts' END AS e FROM events WHERE event_type IN ('click', 'view', 'error')), "
       "f AS (SELECT a.o, b.b, coalesce(o.e, 'neutral') AS e FROM (SELECT DISTINCT o FROM o) a CROSS JOIN (SELECT DISTINCT b FROM o) b LEFT JOIN o ON o.o = a.o AND o.b = b.b) "
       "SELECT o AS observation, count(DISTINCT e) AS effects FROM f GROUP BY o HAVING count(DISTINCT e) > 1")
def br_discriminating(spark, sf_dir):
    o = observations(spark, sf_dir)
    return ep.discriminating(o.select("branch").distinct(), o)


@query("SELECT event_type AS branch, count(*) FILTER (user_id = 3) AS lost, count(*) FILTER (user_id <> 3) AS left FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY event_type")
def br_source_impact(spark, sf_dir):
    return ep.source_impact(observations(spark, sf_dir), "u3")


@query("SELECT event_type AS branch, min(event_id % 97) AS observation FROM events WHERE event_type IN ('click', 'view', 'error') AND NOT coalesce(value > 50, false) GROUP BY event_type")
def br_smallest_disproof(spark, sf_dir):
    return ep.smallest_disproof(observations(spark, sf_dir))


@query("SELECT n_regionkey::VARCHAR AS world, n_name AS branch, (n_nationkey * 2 - n_regionkey)::BIGINT AS total, row_number() OVER (ORDER BY n_nationkey * 2 - n_regionkey DESC, n_regionkey::VARCHAR, n_name)::INT AS rank FROM nation")
def br_rank(spark, sf_dir):
    rows = read(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("world"), F.col("n_name").alias("branch"), F.col("n_nationkey").cast("long").alias("support"), F.col("n_nationkey").cast("long").alias("prediction"), F.col("n_regionkey").cast("long").alias("contradiction"))
    return ep.rank_branches(rows)


# ---------------------------------------------------------------- navigation

@query("SELECT l_orderkey AS o, l_linenumber AS n, round(l_discount + l_tax + (l_linenumber / 8.0 + l_quantity / 50.0) - (l_partkey % 7 / 7.0 + l_suppkey % 5 / 5.0) + l_orderkey % 3 / 3.0 - l_orderkey % 11 / 11.0 - l_partkey % 13 / 13.0 - l_linenumber % 2, 9) AS utility FROM lineitem")
def nv_edge_utility(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    rest = lambda c, m: F.col(c) % m / F.lit(float(m))
    score = fn.edge_utility({
        "semantic_relevance": F.col("l_discount"), "downstream_success": F.col("l_tax"), "evidence_gain": F.col("l_linenumber") / 8, "novelty_gain": F.col("l_quantity") / 50,
        "contradiction_rate": rest("l_partkey", 7), "staleness": rest("l_suppkey", 5), "temporal_relevance": rest("l_orderkey", 3),
        "traversal_cost": rest("l_orderkey", 11), "dead_end_rate": rest("l_partkey", 13), "poisoning_risk": F.col("l_linenumber") % 2,
    })
    return rows.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.round(score, 9).alias("utility"))


@query("WITH e AS (SELECT user_id AS s, event_type AS e, date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) AS t FROM events), m AS (SELECT s, e, max(t) AS t FROM e GROUP BY s, e) "
       "SELECT e.s AS scope, e.e AS edge, max(m.t)::BIGINT AS tick, round(sum(pow(0.9, m.t - e.t)), 6) AS value FROM e JOIN m ON e.s = m.s AND e.e = m.e GROUP BY e.s, e.e")
def nv_decay(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("scope"), F.col("event_type").alias("edge"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("tick"), F.lit(1.0).alias("delta"))
    return nv.traces(rows, 0.9).select("scope", "edge", "tick", F.round("value", 6).alias("value"))


DECISION = {"click": "expanded", "view": "warm", "error": "skipped", "signup": "deferred", "purchase": "stopped"}


@query("SELECT user_id AS retrieval, round((c + 0.5 * v) / (c + 0.5 * v + r + 0.5 * v), 9) AS completeness FROM (SELECT user_id, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type IN ('error', 'signup', 'purchase')) AS r FROM events GROUP BY user_id)")
def nv_completeness(spark, sf_dir):
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in DECISION.items() for x in kv]), F.col("event_type"))
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("retrieval"), kind.alias("decision"))
    return nv.completeness(rows).select("retrieval", F.round("completeness", 9).alias("completeness"))


@query("SELECT count(*) FILTER (event_type = 'click') AS hit, count(*) FILTER (event_type = 'view') AS miss, count(*) FILTER (event_type = 'error') AS waste FROM events")
def nv_prefetch(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "hit").when(F.col("event_type") == "view", "miss").when(F.col("event_type") == "error", "waste")
    return nv.prefetch(read(spark, sf_dir, "events").select(kind.alias("kind")))


# ---------------------------------------------------------------- versions, merges, differences

@query("SELECT o_custkey AS id, max(o_orderkey) AS version, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey")
def wr_versions_latest(spark, sf_dir):
    from .model import latest

    return latest(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status")))


@query("WITH r AS (SELECT l_orderkey || '-' || l_linenumber AS id, l_orderkey AS src, CASE WHEN l_partkey % 10 = 3 THEN l_partkey - 3 ELSE l_partkey END AS dst, l_partkey % 10 = 3 AS moved FROM lineitem), "
       "g AS (SELECT src, dst, min(id) AS keep, bool_or(moved) AS any_moved FROM r GROUP BY src, dst) "
       "SELECT r.id, CASE WHEN any_moved AND r.id <> keep THEN 'duplicate' WHEN moved THEN 'redirected' ELSE 'kept' END AS outcome FROM r JOIN g ON r.src = g.src AND r.dst = g.dst")
def mg_redirect_dedup(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    rels = rows.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.lit("CONTAINS").alias("rel_type"))
    moved = rows.where("l_partkey % 10 = 3").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("from_id"), F.concat(F.lit("p"), (F.col("l_partkey") - 3).cast("string")).alias("to_id")).distinct()
    return mu.redirect(rels, moved).select("id", "outcome")


@query("SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'missing' WHEN a.id IS NULL THEN 'unexpected' ELSE 'different' END AS finding FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS q FROM lineitem WHERE l_linenumber <> 1) a "
       "FULL OUTER JOIN (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber = 2 THEN 0 ELSE l_quantity END AS q FROM lineitem WHERE l_linenumber <> 3) b ON a.id = b.id WHERE a.q IS DISTINCT FROM b.q")
def rc_full_outer_diff(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"))
    a = rows.where("n <> 1").select("id", "q")
    b = rows.where("n <> 3").select("id", F.when(F.col("n") == 2, 0.0).otherwise(F.col("q")).alias("q"))
    return mu.diff(a, b)


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'created' WHEN o_orderkey % 3 = 1 THEN 'unchanged' ELSE 'replaced' END AS outcome, (CASE WHEN o_orderkey % 3 = 2 THEN 2 ELSE 1 END)::BIGINT AS version FROM orders")
def wr_upsert(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("digest"))
    current = rows.where("id % 3 <> 0").select("id", F.when(F.col("id") % 3 == 1, F.col("digest")).otherwise("old").alias("digest"), F.lit(1).cast("long").alias("version"))
    return mu.upsert(current, rows)


@query("SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s) GROUP BY user_id")
def st_sessions(spark, sf_dir):
    from .streaming.sync import sessions

    got = sessions(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "2 hours", "user_id")
    return got.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("count").alias("events"))


@query("SELECT epoch(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'))::BIGINT AS start, event_type, count(*) AS count FROM events GROUP BY ALL")
def st_windows(spark, sf_dir):
    from .streaming.sync import windows

    rows = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows(rows, "ts", "6 hours", "1 hour", "event_type").select(F.unix_seconds("start").alias("start"), "event_type", "count")


@query("SELECT c_custkey AS id, unnest(list_filter([CASE WHEN c_acctbal < 0 THEN 'negative' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'segment' END], lambda x: x IS NOT NULL)) AS rule FROM customer")
def ep_rules(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id")
    return ep.findings(rows, {"negative": F.col("c_acctbal") < 0, "segment": F.col("c_mktsegment") == "BUILDING"})


@query("SELECT user_id AS k, event_id AS v FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r, avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m, stddev_samp(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM events) WHERE r = 1 AND abs(value - m) > 0.5 * s")
def ep_drift(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    got = ep.drift(rows, "user_id", "event_id", "value", 0.5)
    last = rows.groupBy("user_id").agg(F.max("event_id").alias("v"))
    return got.join(last, "user_id").select(F.col("user_id").alias("k"), "v")


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def wr_topk(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    w = Window.orderBy(F.desc("price"), "id")
    top = rows.orderBy(F.desc("price"), "id").limit(15)  # the limit comes first, so that 15 rows are ranked
    return top.withColumn("rank", F.row_number().over(w)).where("rank <= 15").select("id", "price")


from . import catalog_state  # noqa: E402, F401  (registers its queries)
