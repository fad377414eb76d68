"""Queries over stores, rules, scalar functions and logs, with equivalent DuckDB SQL; imported by the catalogue."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .catalog import TERMS, digest_sql, query, read, text_index
from .functions import core as fn
from .model import CLAIM_MOVES, NODE_KINDS, RELATION_ENDS, node_kind
from .operators import access as ac
from .operators import branch_log as bl
from .operators import epistemic as ep
from .operators import mutate as mu
from .operators import navigation as nv
from .operators import order as od
from .operators import records as rc
from .operators import search as se
from .operators import traverse as tr
from .operators.memory import Memory
from .operators.predicate import Filter
from .plans.compile import run
from .sources import store as st
from .sources.tables import load
from .streaming.sync import Sync, jobs


def pick(values: list, at: F.Column) -> F.Column:
    """The value of a list at a position (from 0); null stays null."""
    out = None
    for i, v in enumerate(values):
        out = F.when(at == i, F.lit(v)) if out is None else out.when(at == i, F.lit(v))
    return out


def pick_sql(values: list, at: str) -> str:
    return f"CASE {at} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None) + " END"


def text(column) -> F.Column:
    return F.col(column).cast("string")


# ---------------------------------------------------------------- scalar functions

DESIGNS = [None, "systematic_review", "randomized_controlled_trial", "cohort_study", "case_control_study", "case_series", "case_report", "expert_opinion"]


@query("SELECT l_orderkey AS o, l_linenumber AS n, CASE WHEN l_returnflag = 'N' THEN 'unknown_scale' ELSE CASE (l_orderkey + l_linenumber) % 8 WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '3' WHEN 4 THEN '3' WHEN 5 THEN '4' WHEN 6 THEN '4' WHEN 7 THEN '5' ELSE 'unrated' END END AS level FROM lineitem")
def fn_evidence_level(spark, sf_dir):
    design = pick(DESIGNS, (F.col("l_orderkey") + F.col("l_linenumber")) % 8)
    scale = F.when(F.col("l_returnflag") == "N", "house-scale").otherwise("oxford-cebm-2011")
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), fn.evidence_level(design, scale).alias("level"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'not_participant_level' WHEN c_custkey % 4 >= 2 THEN 'attested' ELSE 'missing' END AS state FROM customer")
def fn_deidentification(spark, sf_dir):
    k = F.col("c_custkey")
    by = F.when(k % 4 == 1, F.lit("  ")).when(k % 4 >= 2, F.col("c_name"))
    return read(spark, sf_dir, "customer").select(k.alias("id"), fn.deidentification(k % 3 != 0, by).alias("state"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 28 > o_custkey % 28 THEN 'first_seen' WHEN o_orderkey % 5 > 0 AND o_custkey % 9 > o_orderkey % 9 THEN 'valid_from' END AS broken FROM orders")
def fn_temporal_order(spark, sf_dir):
    day = lambda n, m: F.concat(F.lit("2024-01-"), F.lpad(((F.col(n) % m) + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z"))
    start = F.when(F.col("o_orderkey") % 5 > 0, day("o_custkey", 9))
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), fn.temporal_order(day("o_orderkey", 28), day("o_custkey", 28), start, day("o_orderkey", 9)).alias("broken")
    )


@query("""WITH p AS (SELECT p_partkey AS id, lpad(p_partkey::VARCHAR, 7, '0') AS d FROM part)
SELECT id, CASE WHEN id % 4 <> 3 THEN '10.' || (1000 + id) || '/ab' END AS doi, CASE WHEN id % 2 = 0 AND id > 0 THEN id::VARCHAR END AS pubmed,
'2401.' || lpad((id % 100000)::VARCHAR, 5, '0') || 'v2' AS arxiv,
CASE WHEN (list_sum(list_transform(range(1, 8), lambda i: substr(d, i, 1)::INT * (9 - i))) + id % 10) % 11 = 0 THEN substr(d, 1, 4) || '-' || substr(d, 5, 3) || id % 10 END AS issn FROM p""")
def fn_identifiers(spark, sf_dir):
    k, t = F.col("p_partkey"), text("p_partkey")
    doi = F.when(k % 4 == 3, F.concat(F.lit("doi:11."), t)).otherwise(F.concat(F.lit("https://doi.org/10."), (k + 1000).cast("string"), F.lit("/AB")))
    return read(spark, sf_dir, "part").select(
        k.alias("id"), fn.identifier("doi", doi).alias("doi"), fn.identifier("pubmed", F.concat(F.when(k % 2 == 0, "PMID: ").otherwise("PMID: 0"), t)).alias("pubmed"),
        fn.identifier("arxiv", F.concat(F.lit("arXiv:2401."), F.lpad((k % 100000).cast("string"), 5, "0"), F.lit("V2"))).alias("arxiv"),
        fn.identifier("issn", F.concat(F.lpad(t, 7, "0"), (k % 10).cast("string"))).alias("issn"),
    )


STATES = [" Validated", "EXPORTED ", "tombstoned", "odd", "candidate", None]


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 130 <= 100 THEN c_custkey % 130 / 100.0::DOUBLE END AS confidence, CASE c_custkey % 6 WHEN 0 THEN 'validated' WHEN 1 THEN 'exported' WHEN 4 THEN 'candidate' END AS status, "
       "c_custkey % 3 < 2 AS instant, regexp_replace(upper(c_mktsegment), '[^A-Z0-9]', '_', 'g') || '_X' AS kind FROM customer")
def fn_parsed(spark, sf_dir):
    k = F.col("c_custkey")
    at = pick(["2024-02-03T04:05:06Z", "2024-02-03T04:05:06+02:00", "2024-02-03 04:05:06Z"], k % 3)
    return read(spark, sf_dir, "customer").select(
        k.alias("id"), fn.normalised_confidence(k % 130).alias("confidence"), fn.status(pick(STATES, k % 6)).alias("status"),
        fn.is_instant(at).alias("instant"), fn.sanitized_type(F.concat(F.col("c_mktsegment"), F.lit("-x "))).alias("kind"),
    )


@query("SELECT l_orderkey AS o, l_linenumber AS n, round(l_quantity - CASE WHEN l_linenumber % 2 = 0 THEN l_tax ELSE 0 END, 9) AS field, round(l_quantity * 0.5 + l_discount * 2 - l_tax, 9) AS reward, "
       "CASE WHEN l_linenumber = 7 THEN 9223372036854775806 + least(l_partkey + l_suppkey, 1) ELSE l_partkey + l_suppkey + 5 END AS cost, "
       "CASE WHEN l_discount >= 0.08 AND l_quantity >= 40 THEN 'sufficient' WHEN l_quantity >= 45 THEN 'budget' WHEN l_returnflag = 'R' THEN 'external' WHEN l_tax < 0.02 THEN 'marginal' ELSE 'continue' END AS stop FROM lineitem")
def fn_navigation(spark, sf_dir):
    q, d, t, n = (F.col(f"l_{c}") for c in ("quantity", "discount", "tax", "linenumber"))
    huge = F.when(n == 7, F.lit((1 << 63) - 2)).otherwise(F.lit(5).cast("long"))
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o"), n.alias("n"), F.round(fn.field_score(q, F.when(n % 2 == 0, t)), 9).alias("field"),
        F.round(fn.reward({"gain": q, "trust": d, "cost": t}, {"gain": 0.5, "trust": 2, "cost": -1}), 9).alias("reward"),
        fn.traversal_cost(F.col("l_partkey").cast("long"), F.col("l_suppkey").cast("long"), huge).alias("cost"),
        fn.stop_condition(d, 0.08, q, 40, q, 45, F.col("l_returnflag") == "R", t, 0.02).alias("stop"),
    )


H = "(CASE WHEN {0} > 0 AND {0} < 1 THEN -{0} * log2({0}) - (1 - {0}) * log2(1 - {0}) ELSE 0.0 END)"


@query("SELECT l_orderkey AS o, l_linenumber AS n, round(greatest(0, " + H.format("l_discount") + " - (0.25 * " + H.format("l_tax") + " + 0.75 * " + H.format("(l_linenumber / 8.0)") + ")), 9) AS gain FROM lineitem")
def fn_information_gain(spark, sf_dir):
    pair = lambda p, q: F.struct(F.lit(p).alias("probability"), q.cast("double").alias("posterior"))
    gain = fn.information_gain(F.col("l_discount"), F.array(pair(0.25, F.col("l_tax")), pair(0.75, F.col("l_linenumber") / 8)))
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.round(gain, 9).alias("gain"))


# ---------------------------------------------------------------- claims, kinds, rules

CLAIM_STATES = ["candidate", "asserted", "supported", "disputed", "contradicted", "superseded", "retracted", "rejected", "validated", "unresolved"]
MOVES_SQL = """(VALUES ('candidate', ['asserted', 'rejected', 'retracted', 'unresolved']),
('asserted', ['supported', 'disputed', 'contradicted', 'superseded', 'retracted', 'rejected', 'validated', 'unresolved']),
('supported', ['disputed', 'contradicted', 'superseded', 'retracted', 'rejected', 'validated', 'unresolved']),
('disputed', ['supported', 'contradicted', 'superseded', 'retracted', 'rejected', 'validated', 'unresolved']),
('contradicted', ['disputed', 'superseded', 'retracted', 'rejected', 'unresolved']),
('unresolved', ['supported', 'disputed', 'contradicted', 'superseded', 'retracted', 'rejected', 'validated']), ('validated', ['superseded', 'retracted']))"""


@query(f"WITH p AS (SELECT event_id AS id, {pick_sql(CLAIM_STATES, 'event_id % 10')} AS a, {pick_sql(CLAIM_STATES, '(event_id // 10) % 10')} AS b FROM events) "
       f"SELECT id, a = b OR coalesce(list_contains(m.after, b), false) AS ok FROM p LEFT JOIN {MOVES_SQL} m(before, after) ON m.before = a")
def ep_claim_moves(spark, sf_dir):
    n = F.col("event_id")
    a, b = pick(CLAIM_STATES, n % 10), pick(CLAIM_STATES, F.floor(n / 10) % 10)
    assert set(CLAIM_STATES) == set(CLAIM_MOVES)
    return read(spark, sf_dir, "events").select(n.alias("id"), ep.move_allowed(a, b).alias("ok"))


KINDS_SQL = "['Entity', 'Event', 'Observation', 'Claim', 'Hypothesis', 'Evidence', 'Source', 'Assessment', 'Contradiction', 'Inference', 'Decision']"
SOME_LABELS = ["Decision", "Claim", "Odd", "Entity", "Source", "Assessment", "Inference", "Event", "Other", "Evidence", "Hypothesis", "Contradiction", "Observation"]


@query(f"WITH l AS (SELECT event_id AS id, [{pick_sql(SOME_LABELS, 'event_id % 13')}, {pick_sql(SOME_LABELS, 'user_id % 13')}] AS labels FROM events) "
       f"SELECT id, list_filter({KINDS_SQL}, lambda k: list_contains(labels, k))[1] AS kind FROM l")
def ep_kinds(spark, sf_dir):
    labels = F.array(pick(SOME_LABELS, F.col("event_id") % 13), pick(SOME_LABELS, F.col("user_id") % 13))
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), node_kind(labels).alias("kind"))


ENDS_SQL = """(VALUES ('REPORTS', ['Source'], ['Observation']), ('SUPPORTS', ['Observation', 'Evidence', 'Claim'], ['Claim', 'Hypothesis']),
('REFUTES', ['Observation', 'Evidence', 'Claim'], ['Claim', 'Hypothesis']), ('CONTRADICTS', ['Observation', 'Evidence', 'Claim'], ['Claim', 'Hypothesis']),
('SUPERSEDES', ['Claim'], ['Claim']), ('ASSESSES', ['Assessment'], ['Claim', 'Hypothesis']), ('INFERS', ['Inference'], ['Claim', 'Hypothesis']),
('DECIDES', ['Decision'], ['Assessment', 'Claim', 'Hypothesis']))"""
REL_KINDS = [*RELATION_ENDS, "KNOWS"]
END_KINDS = [*NODE_KINDS, None]


@query(f"WITH e AS (SELECT event_id::VARCHAR AS rel, {pick_sql(REL_KINDS, 'event_id % 9')} AS rel_type, {pick_sql(END_KINDS, '(event_id // 9) % 12')} AS source_kind, {pick_sql(END_KINDS, 'user_id % 12')} AS target_kind FROM events) "
       f"SELECT e.* FROM e JOIN {ENDS_SQL} r(t, s, d) ON rel_type = t WHERE NOT coalesce(list_contains(s, source_kind), false) OR NOT coalesce(list_contains(d, target_kind), false)")
def ep_endpoint_schema(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    edges = rows.select(
        text("event_id").alias("id"), pick(REL_KINDS, F.col("event_id") % 9).alias("rel_type"),
        F.concat(F.lit("s"), text("event_id")).alias("src"), F.concat(F.lit("u"), text("user_id")).alias("dst"),
    )
    kinds = rows.select(F.concat(F.lit("s"), text("event_id")).alias("id"), pick(END_KINDS, F.floor(F.col("event_id") / 9) % 12).alias("kind")).unionByName(
        rows.select(F.concat(F.lit("u"), text("user_id")).alias("id"), pick(END_KINDS, F.col("user_id") % 12).alias("kind")).distinct()
    )
    return tr.bad_ends(edges, kinds, RELATION_ENDS)


RESEARCH = ["claim", "finding", "result", "replication_attempt", "odd"]


def rules_sql(source: str, rules: dict[str, str]) -> str:
    cases = ", ".join(f"CASE WHEN {c} THEN '{code}' END" for code, c in rules.items())
    return f"SELECT id, unnest(list_filter([{cases}], lambda x: x IS NOT NULL)) AS rule FROM ({source})"


@query(rules_sql(f"SELECT o_orderkey AS id, o_custkey AS c, {pick_sql(RESEARCH, 'o_orderkey % 5')} AS kind, o_orderstatus = 'F' AS valid FROM orders", {
    "RESEARCH_CLAIM_ATTRIBUTION_REQUIRED": "kind = 'claim' AND (c % 2 = 0 OR c % 3 = 0)", "RESEARCH_FINDING_RESULT_REQUIRED": "kind = 'finding' AND c % 2 = 0",
    "RESEARCH_RESULT_SOURCE_REQUIRED": "kind = 'result' AND c % 3 = 0", "RESEARCH_REPLICATION_ATTRIBUTION_REQUIRED": "kind = 'replication_attempt' AND c % 4 <> 1",
    "RESEARCH_NODE_TYPE_REQUIRED": "kind = 'odd'", "EVIDENCE_REQUIRED": "valid AND kind IN ('claim', 'finding') AND c % 5 = 0",
    "RESEARCH_RETRACTED_SUPPORT_REQUIRES_OVERRIDE": "valid AND c % 3 = 1"}))
def ep_research_rules(spark, sf_dir):
    c = F.col("o_custkey")
    one = F.array(F.lit("x"))
    none = F.array().cast("array<string>")
    attempt = lambda b: F.struct(F.lit("t").alias("target_work"), F.lit(b).alias("reporting_work"))
    work = lambda gone, why: F.struct(F.lit(gone).alias("retracted"), F.lit(why).cast("string").alias("override_reason"))
    rows = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), pick(RESEARCH, F.col("o_orderkey") % 5).alias("kind"), F.when(F.col("o_orderstatus") == "F", "validated").alias("status"),
        F.when(c % 2 != 0, "w").alias("asserting_work"), F.when(c % 3 == 0, " ").otherwise("a").alias("credited_actor"),
        F.when(c % 2 != 0, one).otherwise(none).alias("result_refs"), F.when(c % 3 != 0, one).alias("source_refs"),
        F.when(c % 4 == 1, F.array(attempt("r"))).when(c % 4 == 2, F.array(attempt(" "))).when(c % 4 == 3, F.array(attempt("r"), attempt("r"))).alias("attempts"),
        F.when(c % 5 != 0, one).alias("evidence_refs"),
        F.when(c % 3 == 1, F.array(work(False, None), work(True, " "))).when(c % 3 == 2, F.array(work(True, "known"))).alias("supporting"),
    )
    return ep.findings(rows, ep.research_rules())


@query(rules_sql("SELECT l_orderkey * 10 + l_linenumber AS id, l_linenumber AS n, l_partkey AS p, l_returnflag <> 'N' AND l_linestatus = 'F' AS held FROM lineitem", {
    "RESEARCH_CITATION_ENDPOINTS_REQUIRED": "p % 11 = 0", "RESEARCH_CITATION_LOCATOR_REQUIRED": "held AND n % 2 = 0", "EVIDENCE_REQUIRED": "held AND p % 3 = 0"}))
def ep_citation_rules(spark, sf_dir):
    p = F.col("l_partkey")
    rows = read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.lit("a").alias("citing_work"), F.when(p % 11 == 0, " ").otherwise("b").alias("cited_work"),
        F.when(F.col("l_returnflag") == "N", "cites").otherwise("supports").alias("stance"), F.when(F.col("l_linenumber") % 2 != 0, "p. 1").alias("locator"),
        F.when(F.col("l_linestatus") == "F", "validated").otherwise("candidate").alias("status"), F.when(p % 3 != 0, F.array(F.lit("e"))).alias("evidence_refs"),
    )
    return ep.findings(rows, ep.citation_rules())


MEDICAL = ["finding", "effect_estimate", "adverse_event", "population"]


@query(rules_sql(f"SELECT c_custkey AS id, c_custkey AS c, c_nationkey AS k, {pick_sql(MEDICAL, 'c_custkey % 4')} AS kind FROM customer", {
    "MEDICAL_DEIDENTIFICATION_REQUIRED": "c % 3 = 0 AND k % 2 = 0", "EVIDENCE_REQUIRED": "c % 5 = 0 AND kind IN ('finding', 'effect_estimate') AND k % 3 = 0",
    "MEDICAL_EFFECT_ESTIMATE_STUDY_REF": "kind = 'effect_estimate' AND k % 3 <> 1", "MEDICAL_ADVERSE_EVENT_WINDOW_REQUIRED": "kind = 'adverse_event' AND k % 4 <> 0"}))
def ep_medical_rules(spark, sf_dir):
    c, k = F.col("c_custkey"), F.col("c_nationkey")
    rows = read(spark, sf_dir, "customer").select(
        c.alias("id"), pick(MEDICAL, c % 4).alias("kind"), F.when(c % 5 == 0, "validated").alias("status"), (c % 3 == 0).alias("participant_level"),
        F.when(k % 2 != 0, "steward").alias("attested_by"), F.when(k % 3 == 1, F.array(F.lit("s"))).when(k % 3 == 2, F.array(F.lit("s"), F.lit("t"))).alias("study_refs"),
        F.when(k % 3 != 0, F.array(F.lit("e"))).alias("evidence_refs"), F.lit("2024-01-01").alias("window_start"), F.when(k % 4 == 0, "2024-02-01").alias("window_end"),
    )
    return ep.findings(rows, ep.medical_rules())


@query("SELECT a.c_custkey AS id, 'open_contradiction' AS rule FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 WHERE a.c_custkey % 2 = 0 AND a.c_custkey % 5 > 0 AND b.c_custkey % 5 > 0")
def ep_contradictions(spark, sf_dir):
    rows = read(spark, sf_dir, "customer")
    nodes = rows.select(text("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 == 0, "rejected").otherwise("candidate").alias("status"))
    edges = rows.select(F.col("c_custkey").alias("id"), text("c_custkey").alias("src"), (F.col("c_custkey") + 1).cast("string").alias("dst"), F.when(F.col("c_custkey") % 2 == 0, "CONTRADICTS").otherwise("SUPPORTS").alias("rel_type"))
    return ep.open_contradictions(edges, nodes)


@query("SELECT o_orderkey AS id, 'stale_evidence' AS rule FROM orders WHERE o_orderstatus <> 'O' AND o_orderdate < TIMESTAMP '1996-01-01'")
def ep_stale(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("valid_until"))
    return ep.stale_evidence(rows, F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00")))


@query("SELECT p_partkey AS id, row_number() OVER (ORDER BY p_size > 10 DESC, p_retailprice DESC, p_partkey)::INT AS rank FROM part")
def ep_next_evidence(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") > 10).alias("eligible"), F.col("p_retailprice").alias("expected_value"))
    return ep.next_evidence(rows).select("id", "rank")


@query("SELECT effect, string_agg(o::VARCHAR, ',' ORDER BY o) AS observations FROM (SELECT DISTINCT CASE WHEN value > 50 THEN 'supports' ELSE 'contradicts' END AS effect, event_id % 97 AS o FROM events WHERE event_type = 'click') GROUP BY effect")
def ep_expected_facts(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(
        F.col("event_type").alias("branch"), (F.col("event_id") % 97).alias("observation"), F.when(F.col("value") > 50, "supports").otherwise("contradicts").alias("effect")
    )
    return ep.effects(rows, "click").select("effect", F.array_join("observations", ",").alias("observations"))


@query("SELECT user_id AS record, arg_max(t, event_id) AS tier FROM (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'shadow' WHEN 'view' THEN 'staging' ELSE 'canonical' END AS t, value > 50 AS a FROM events) WHERE t <> 'canonical' OR coalesce(a, false) GROUP BY user_id")
def ep_tiers(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("record"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", "shadow").when(F.col("event_type") == "view", "staging").otherwise("canonical").alias("tier"),
        (F.col("value") > 50).alias("audited"),
    )
    return ep.tiers(rows)


@query("SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0 ORDER BY s_suppkey DESC LIMIT (SELECT greatest(count(*) - 5, 0) FROM supplier)")
def ep_evictions(spark, sf_dir):
    k = F.col("s_suppkey")
    return ep.evictions(read(spark, sf_dir, "supplier").select(k.alias("id"), (k % 3 == 0).alias("pinned"), (k % 5 == 0).alias("dirty")), 5)


@query("WITH s AS (SELECT l_orderkey AS path, l_linenumber AS n, CASE WHEN l_quantity < 20 THEN 0 WHEN l_quantity < 35 THEN 1 ELSE 2 END AS level, lag(l_linenumber) OVER w AS pn, lag(CASE WHEN l_quantity < 20 THEN 0 WHEN l_quantity < 35 THEN 1 ELSE 2 END) OVER w AS pl "
       "FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)) SELECT path, bool_and(pn IS NULL OR (pn + 1 = n AND abs(level - pl) <= 1)) AS valid, sum(n)::DOUBLE AS score FROM s GROUP BY path")
def ep_mixed_path(spark, sf_dir):
    n = F.col("l_linenumber")
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("path"), n.alias("seq"), n.cast("string").alias("src"), (n + 1).cast("string").alias("dst"), n.cast("double").alias("score"),
        F.when(F.col("l_quantity") < 20, "tactical").when(F.col("l_quantity") < 35, "operational").otherwise("strategic").alias("level"),
    )
    return ep.mixed_path(rows)


def hyper(spark, sf_dir):
    role = lambda n, r: F.struct(n.alias("node"), F.lit(r).alias("role"))
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.array(role(F.concat(F.lit("p"), text("l_partkey")), "item"), role(F.concat(F.lit("s"), text("l_suppkey")), "seller"), role(F.concat(F.lit("o"), text("l_orderkey")), "order")).alias("participants"),
    )


@query("SELECT l_orderkey * 10 + l_linenumber AS src, unnest(['p' || l_partkey, 's' || l_suppkey, 'o' || l_orderkey]) AS dst, unnest(['item', 'seller', 'order']) AS role FROM lineitem")
def ep_hyper_edges(spark, sf_dir):
    return ep.hyper_edges(hyper(spark, sf_dir))


@query("SELECT l_orderkey * 10 + l_linenumber AS src, 'p' || l_partkey AS dst, 'item' AS role FROM lineitem WHERE l_suppkey = 3")
def ep_co_participants(spark, sf_dir):
    return ep.co_participants(hyper(spark, sf_dir), "s3", "item")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND (o_orderkey % 3 = 0 OR (o_orderkey % 3 = 1 AND o_custkey % 28 + 1 > 15)) AND (o_orderkey % 5 > 0 OR o_custkey % 10 + 1 <= 15)")
def mem_visible(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    day = lambda n: F.concat(F.lit("2024-01-"), F.lpad((n + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z"))
    rows = read(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("deleted").alias("lifecycle"),
        F.when(k % 3 == 1, day(c % 28)).when(k % 3 == 2, "soon").alias("expires_at"), F.when(k % 5 == 0, day(c % 10)).alias("valid_from"), F.lit(None).cast("string").alias("valid_until"),
    )
    return rows.where(ep.memory_visible("2024-01-15T00:00:00Z")).select("id")


# ---------------------------------------------------------------- logs of decisions, navigation

@query("WITH f AS (SELECT c_custkey AS target, CASE c_custkey % 4 WHEN 0 THEN 'find_support' WHEN 1 THEN 'find_independent_source' WHEN 2 THEN 'refresh_evidence' END AS kind FROM customer) "
       "SELECT kind, target FROM f WHERE kind IS NOT NULL AND NOT (target % 3 = 0 AND target % 2 = 0 AND kind = 'find_support')")
def br_probes(spark, sf_dir):
    k = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer")
    findings = rows.select(k.alias("id"), pick(["unsupported_claim", "circular_source", "stale_evidence", "odd"], k % 4).alias("rule"))
    log = rows.where("c_custkey % 3 = 0").select(F.lit("find_support").alias("kind"), k.alias("target"), F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"))
    return bl.probes(findings, log.withColumn("state", F.when((F.col("target") % 2 == 0) | (F.col("seq") == 1), "open").otherwise("closed")))


@query("SELECT c_custkey AS record, 'odd' AS rule, 'quarantine' AS response, 'ann' AS actor, '2024-01-01' AS at FROM customer WHERE c_acctbal < 0")
def br_responses(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"), F.lit("odd").alias("rule"))
    return bl.respond(rows, "quarantine", "ann", "2024-01-01")


@query("SELECT 'r' || r_regionkey AS id, 0 AS depth FROM region UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation UNION ALL SELECT 's' || s_suppkey, 2 FROM supplier")
def br_timeline(spark, sf_dir):
    span = lambda t, i, p, a, b: read(spark, sf_dir, t).select(i.alias("id"), p.cast("string").alias("parent"), a.alias("start"), b.alias("end"))
    name = lambda x, c: F.concat(F.lit(x), text(c))
    k = F.col("n_nationkey").cast("long")
    spans = span("region", name("r", "r_regionkey"), F.lit(None), F.lit(0).cast("long"), F.lit(100).cast("long")).unionByName(
        span("nation", name("n", "n_nationkey"), name("r", "n_regionkey"), k, k + 1)
    ).unionByName(span("supplier", name("s", "s_suppkey"), name("n", "s_nationkey"), F.col("s_nationkey").cast("long"), F.col("s_nationkey").cast("long")))
    return bl.timeline(spans).select("id", "depth")


@query("WITH s AS (SELECT 'nation--' || n_nationkey AS id FROM nation UNION ALL SELECT 'region--' || r_regionkey FROM region ORDER BY id LIMIT 28) "
       "SELECT 'in_region--' || n_nationkey || '--' || n_regionkey AS id FROM nation WHERE 'region--' || n_regionkey IN (SELECT id FROM s) ORDER BY id LIMIT 10")
def br_drawing(spark, sf_dir):
    g = load(spark, sf_dir)
    nodes = g.nodes("Nation").select("id").unionByName(g.nodes("Region").select("id"))
    return bl.drawing(nodes, g.edges(["IN_REGION"]), 28, 10)[1].select("id")


@query("WITH r AS (SELECT s_suppkey AS id, s_suppkey = 4 AS target, unnest(['nation', 'name', 'kind']) AS key, unnest([s_nationkey::VARCHAR, s_name, 'Supplier']) AS value FROM supplier) "
       "SELECT key, arg_max(value, (target::INT, -id)) AS value, count(DISTINCT value) > 1 AS conflict FROM r GROUP BY key")
def mg_properties(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), (F.col("s_suppkey") == 4).alias("target"),
        F.create_map(F.lit("nation"), text("s_nationkey"), F.lit("name"), F.col("s_name"), F.lit("kind"), F.lit("Supplier")).alias("props"),
    )
    return bl.merged_properties(rows)


@query("WITH d AS (SELECT user_id AS s, event_id % 7 AS node, event_id AS seq, CASE event_type WHEN 'click' THEN 'admit' WHEN 'error' THEN 'bad' WHEN 'view' THEN 'bad' END AS k FROM events), "
       "a AS (SELECT s, node, min(seq) AS seq FROM d WHERE k = 'admit' GROUP BY s, node) SELECT d.s AS scope, 'e' || a.seq AS edge, count(*) AS count FROM d JOIN a ON d.s = a.s AND d.node = a.node WHERE k = 'bad' AND d.seq > a.seq GROUP BY ALL")
def nv_dead_ends(spark, sf_dir):
    kind = F.col("event_type")
    rows = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("scope"), F.col("event_id").alias("seq"), (F.col("event_id") % 7).alias("node"), F.concat(F.lit("e"), text("event_id")).alias("edge"),
        F.when(kind == "click", "admit").when(kind == "error", "dead_end").when(kind == "view", "irrelevant").otherwise("later").alias("decision"),
    )
    return nv.dead_ends(rows)


def homes(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.concat(F.lit("n"), text("c_nationkey")).alias("src"), F.col("c_custkey").alias("id"), F.concat(F.lit("c"), text("c_custkey")).alias("dst"))


@query("WITH e AS (SELECT 'n' || c_nationkey AS src, c_custkey AS id FROM customer WHERE c_nationkey < 8), k AS (SELECT src FROM e GROUP BY src HAVING count(*) < 62) "
       "SELECT src, id FROM (SELECT src, id FROM e WHERE src IN (SELECT src FROM k) ORDER BY src, id LIMIT 40) ORDER BY src, id LIMIT 25")
def nv_expand(spark, sf_dir):
    seeds = read(spark, sf_dir, "nation").where("n_nationkey < 8").select(F.concat(F.lit("n"), text("n_nationkey")).alias("id"))
    return nv.expand(seeds, homes(spark, sf_dir), max_nodes=25, max_edges=40, supernode=62).select("src", "id")


@query("SELECT c_custkey AS id FROM customer WHERE c_nationkey < 3 AND c_custkey % 4 <> 0")
def nv_frontier(spark, sf_dir):
    held = read(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.concat(F.lit("c"), text("c_custkey")).alias("id"))
    seeds = read(spark, sf_dir, "nation").where("n_nationkey < 3").select(F.concat(F.lit("n"), text("n_nationkey")).alias("id"))
    return nv.frontier(seeds.unionByName(held), homes(spark, sf_dir)).select("id")


# ---------------------------------------------------------------- reads: optional matches, pages, access

@query("SELECT 'nation--' || n_nationkey AS n, 'region--' || r_regionkey AS r FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 2 WHERE n_nationkey >= 0 AND (r_regionkey IS NOT NULL)")
def cy_optional(spark, sf_dir):
    return run(load(spark, sf_dir), "OPTIONAL MATCH (n:Nation)-[e:IN_REGION]->(r:Region) WHERE r.regionkey < 2 RETURN n, r").toDF("n", "r")


def priced(spark, sf_dir):
    return rc.to_records(load(spark, sf_dir).nodes("Order").select("id", "totalprice", "orderstatus"), "Order")


@query("SELECT 'order--' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, id LIMIT 20 OFFSET 20")
def kd_pages(spark, sf_dir):
    """The second of two pages, asked for with the first one's token."""
    codec = od.TokenCodec(b"k" * 32)
    wanted = rc.Read(predicate=Filter("orderstatus", "equal", "O"), order=[("totalprice", True)], limit=20)
    _, token = od.page(priced(spark, sf_dir), wanted, codec)
    rows, _ = od.page(priced(spark, sf_dir), wanted, codec, token)
    return spark.createDataFrame([(r["id"],) for r in rows], "id string")


@query("SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'O'")
def kd_list_total(spark, sf_dir):
    return rc.listed_with_total(priced(spark, sf_dir), rc.Read(predicate=Filter("orderstatus", "equal", "O"), limit=5))[1]


@query("SELECT c_custkey AS id FROM (SELECT *, c_custkey AS k FROM customer) WHERE CASE WHEN k % 43 = 0 THEN true WHEN k % 41 = 0 THEN false WHEN k % 11 = 0 THEN false WHEN k % 13 = 0 THEN false WHEN k % 19 = 0 THEN false "
       "WHEN k % 7 = 0 THEN true WHEN k % 23 = 0 THEN true WHEN k % 29 = 0 THEN true WHEN k % 31 = 0 THEN true WHEN k % 37 = 0 THEN true WHEN k % 10 = 4 THEN true WHEN k % 10 = 6 THEN true WHEN k % 2 = 0 THEN false ELSE true END")
def ac_ladder(spark, sf_dir):
    """Every rung of the access ladder over the customers."""
    k = F.col("c_custkey")
    some = lambda test, *v: F.when(test, F.array(*[F.lit(x) for x in v])).otherwise(F.array().cast("array<string>"))
    meta = F.when(k % 43 != 0, F.struct(
        some(k % 11 == 0, "secret").alias("markings"), F.when(k % 13 == 0, F.array(F.lit("t2"))).otherwise(some(k % 17 == 0, "t1", "t2")).alias("tenants"), some(k % 19 == 0, "g1").alias("denied"),
        F.when(k % 7 == 0, "ann").when(k % 2 == 0, "bob").alias("owner"), some(k % 23 == 0, "zoe", "ann").alias("creators"), some(k % 29 == 0, "g1").alias("members"),
        some(k % 31 == 0, "au").alias("authorities"), (k % 37 == 0).alias("public"), some(k % 10 == 4, "org").alias("shared"), some(k % 10 == 6, "org").alias("organisations"), (k % 41 == 0).alias("malformed"),
    ))
    policy = ac.compile_policy(ac.Context(user="ann", tenant="t1", organisations=["org"], groups=["g1"], authorities=["au"]))
    return read(spark, sf_dir, "customer").where(ac.allowed(policy, meta)).select(k.alias("id"))


@query(f"WITH d AS (SELECT doc_id AS doc, {TERMS} AS w FROM documents WHERE lang = 'en') SELECT count(*) AS total FROM d WHERE list_contains(w, 'the') AND list_contains(w, 'with')")
def ft_search_total(spark, sf_dir):
    """Total of a search within what exact filters leave."""
    within = read(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("doc"))
    return text_index(spark, sf_dir).search("the with", within=within)[1]


@query("SELECT avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END) AS mrr FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank, event_id, max(event_id) OVER (PARTITION BY user_id) AS last FROM events) WHERE event_id = last")
def ft_mrr(spark, sf_dir):
    """Mean reciprocal rank of each user's last event among their events by value."""
    from pyspark.sql import Window

    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("query"), F.col("event_id").alias("doc"), "value")
    results = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("value").desc_nulls_last(), "doc"))).select("query", "doc", "rank")
    return se.reciprocal_rank(results, rows.groupBy("query").agg(F.max("doc").alias("doc")))


# ---------------------------------------------------------------- stores

def new_folder(spark, name: str) -> str:
    return f"{tr.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def graph_store(spark, sf_dir) -> st.GraphStore:
    """A store of the customers as nodes, ids ``node--key``."""
    store = st.GraphStore(spark, new_folder(spark, "store"))
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    store.commit(nodes=read(spark, sf_dir, "customer").select(
        F.concat(F.lit("node--"), text("c_custkey")).alias("id"), F.lit(1).cast("long").alias("version"), F.array(F.lit("Customer")).alias("labels"),
        F.create_map(F.lit("name"), quoted("c_name"), F.lit("segment"), quoted("c_mktsegment"), F.lit("nation"), text("c_nationkey")).alias("props"),
        F.lit("candidate").alias("status"), F.lit(None).cast("double").alias("confidence"), F.array().cast("array<string>").alias("evidence_refs"), F.lit("2024-01-01T00:00:00Z").alias("recorded_at"),
    ))
    return store


@query("SELECT 'node--' || c_custkey AS src, 'HAS' AS rel_type, '\"seen\"' AS text, 1::BIGINT AS version FROM customer WHERE c_nationkey = 3")
def dm_create(spark, sf_dir):
    store = graph_store(spark, sf_dir)
    mu.run(store, "MATCH (c:Customer) WHERE c.nation = 3 CREATE (c)-[:HAS]->(n:Note {text: 'seen'})", bounded=False)
    notes = store.nodes().where(F.array_contains("labels", "Note")).select(F.col("id").alias("dst"), F.col("props")["text"].alias("text"), F.col("version"))
    return store.rels().select("src", "dst", "rel_type").join(notes, "dst").select("src", "rel_type", "text", "version")


@query("SELECT 'node--' || c_custkey AS src, 'LIKES' AS rel_type, 1::BIGINT AS n FROM customer WHERE c_nationkey = 4")
def dm_merge(spark, sf_dir):
    """The same MERGE twice makes one topic and one relationship a customer."""
    store = graph_store(spark, sf_dir)
    for _ in range(2):
        mu.run(store, "MATCH (c:Customer) WHERE c.nation = 4 MERGE (c)-[:LIKES]->(t:Topic {name: 'x'})", bounded=False)
    return store.rels().groupBy("src", "rel_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'node--' || c_custkey AS id, CASE WHEN c_nationkey = 5 THEN 3 ELSE 1 END::BIGINT AS version, CASE WHEN c_nationkey = 5 THEN 'null' ELSE '\"' || c_mktsegment || '\"' END AS segment, "
       "CASE WHEN c_nationkey = 5 THEN 'validated' ELSE 'candidate' END AS status, CASE WHEN c_nationkey = 5 THEN 0.75::DOUBLE END AS confidence FROM customer")
def dm_set_remove(spark, sf_dir):
    store = graph_store(spark, sf_dir)
    mu.run(store, "MATCH (c:Customer) WHERE c.nation = 5 SET c.confidence = 0.75, c.status = 'Validated'", bounded=False)
    mu.run(store, "MATCH (c:Customer) WHERE c.nation = 5 REMOVE c.segment", bounded=False)
    return store.nodes().select("id", "version", F.col("props")["segment"].alias("segment"), "status", "confidence")


@query("SELECT 'node--' || c_custkey AS id, c_nationkey = 6 AS gone, CASE WHEN c_nationkey = 6 THEN 2 ELSE 1 END::BIGINT AS versions FROM customer")
def dm_delete(spark, sf_dir):
    """Deleted nodes leave reads and stay in the history."""
    store = graph_store(spark, sf_dir)
    mu.run(store, "MATCH (c:Customer) WHERE c.nation = 6 DELETE c", bounded=False)
    history = store.versions("nodes").groupBy("id").agg(F.count(F.lit(1)).alias("versions"))
    shown = store.nodes().select("id", F.lit(True).alias("shown"))
    return history.join(shown, "id", "left").select("id", F.col("shown").isNull().alias("gone"), "versions")


@query("SELECT 'x' || c_custkey AS id, 3::BIGINT AS version, '\"again\"' AS note FROM customer")
def dm_recreate(spark, sf_dir):
    """Created, deleted and created again by typed batches."""
    store = graph_store(spark, sf_dir)
    rows = read(spark, sf_dir, "customer").select(F.concat(F.lit("x"), text("c_custkey")).alias("id"))
    for action, note in (("create", '"first"'), ("delete", None), ("create", '"again"')):
        props = F.create_map(F.lit("note"), F.lit(note)) if note else F.lit(None).cast("map<string,string>")
        mu.write_batch(store, rows.select("id", F.lit(action).alias("action"), F.lit(None).cast("long").alias("expected"), F.array(F.lit("Note")).alias("labels"), props.alias("props")))
    return store.nodes().where("id like 'x%'").select("id", "version", F.col("props")["note"].alias("note"))


@query("SELECT 'node--' || c_custkey AS id, CASE WHEN c_custkey % 3 = 1 THEN 2 ELSE 1 END::BIGINT AS version FROM customer UNION ALL SELECT 'new--' || c_custkey, 1 FROM customer WHERE c_custkey % 3 = 2")
def dm_import(spark, sf_dir):
    """A typed import, asked for twice: new records, changed ones and equal ones."""
    store = graph_store(spark, sf_dir)
    current = store.nodes().withColumn("k", F.substring_index("id", "--", -1).cast("long"))
    changed = F.map_concat("props", F.create_map(F.lit("seen"), F.lit("true")))
    incoming = current.select(
        F.when(F.col("k") % 3 == 2, F.concat(F.lit("new--"), text("k"))).otherwise(F.col("id")).alias("id"), "labels", F.when(F.col("k") % 3 == 1, changed).otherwise(F.col("props")).alias("props"),
    )
    for _ in range(2):
        mu.import_records(store, incoming, "w", "k1")
    return store.nodes().select("id", "version")


@query("SELECT 'node--' || c_custkey AS id, 1::BIGINT AS version FROM customer UNION ALL SELECT 'node--' || c_custkey, 2 FROM customer WHERE c_nationkey = 7")
def st_versions(spark, sf_dir):
    store = graph_store(spark, sf_dir)
    mu.run(store, "MATCH (c:Customer) WHERE c.nation = 7 SET c.seen = true", bounded=False)
    return store.versions("nodes").select("id", "version")


@query("SELECT 'node--5' AS id, v::BIGINT AS version, CASE WHEN v > 1 THEN (v - 1)::VARCHAR END AS round FROM range(1, 4) t(v)")
def st_history(spark, sf_dir):
    store = graph_store(spark, sf_dir)
    for i in (1, 2):
        mu.run(store, f"MATCH (c:Customer) WHERE c.id = 'node--5' SET c.round = {i}")
    return store.history("nodes", "node--5").select("id", "version", F.col("props")["round"].alias("round"))


PARTS = {
    "nodes": ("id, '1'", "(SELECT 'node--' || c_custkey AS id FROM customer)"),
    "relationships": ("id", "(SELECT '' AS id FROM customer WHERE false)"),
    "properties": ("id, key, value", "(SELECT 'node--' || c_custkey AS id, unnest(['name', 'segment', 'nation']) AS key, unnest(['\"' || c_name || '\"', '\"' || c_mktsegment || '\"', c_nationkey::VARCHAR]) AS value FROM customer)"),
    "labels": ("id, 'Customer'", "(SELECT 'node--' || c_custkey AS id FROM customer)"),
    "statuses": ("id, 'candidate'", "(SELECT 'node--' || c_custkey AS id FROM customer)"),
}


@query(" UNION ALL ".join(f"SELECT '{name}' AS part, rows, digest FROM ({digest_sql(*of)})" for name, of in PARTS.items()))
def dg_graph(spark, sf_dir):
    store = graph_store(spark, sf_dir)
    return rc.graph_digests(store.nodes(), store.rels())


@query("SELECT 'memory--' || substr(sha256('w|' || n_nationkey), 1, 32) AS id, 3::BIGINT AS version, '\"' || n_name || '\"' AS content FROM nation WHERE n_nationkey < 2")
def mem_lifecycle(spark, sf_dir):
    """Remembered, forgotten and remembered again."""
    store = st.GraphStore(spark, new_folder(spark, "memory"))
    m = Memory(store, "w")
    for r in read(spark, sf_dir, "nation").where("n_nationkey < 2").collect():
        key = str(r["n_nationkey"])
        made = m.remember(f"a{key}", key, "note", "first")
        m.forget(f"b{key}", made["id"])
        m.remember(f"c{key}", key, "note", r["n_name"])
    return store.nodes().select("id", "version", F.col("props")["content"].alias("content"))


@query("WITH b AS (SELECT user_id, event_id, event_type, event_id < 500 AS early FROM events WHERE event_id < 900) SELECT 'u' || user_id AS id, count(DISTINCT early) AS version, max(event_id)::VARCHAR AS n FROM b GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def st_sync(spark, sf_dir):
    """Two ordered batches of changes; the last operation of a record decides."""
    store = st.GraphStore(spark, new_folder(spark, "sync"))
    sync = Sync(store)
    ops = read(spark, sf_dir, "events").where("event_id < 900").select(
        F.concat(F.lit("op"), text("event_id")).alias("operation"), F.col("event_id").cast("long").alias("seq"), F.concat(F.lit("u"), text("user_id")).alias("id"),
        F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("action"), F.array(F.lit("User")).alias("labels"), F.create_map(F.lit("n"), text("event_id")).alias("props"),
    )
    sync.apply(ops.where("seq < 500"), "snapshot")
    sync.apply(ops, "catch_up")
    return store.nodes().select("id", "version", F.col("props")["n"].alias("n"))


@query("SELECT user_id AS job, CASE WHEN arg_max(event_type, event_id) = 'purchase' THEN 'done' WHEN count(*) FILTER (event_type = 'error') >= 3 THEN 'quarantined' WHEN arg_max(event_type, event_id) = 'click' AND max(event_id) + 100 > 950 THEN 'leased' ELSE 'queued' END AS state, "
       "count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY user_id")
def st_jobs(spark, sf_dir):
    kind = F.col("event_type")
    rows = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.when(kind == "purchase", "done").when(kind == "error", "failed").when(kind == "click", "leased").otherwise("queued").alias("event"),
        (F.col("event_id") + 100).alias("until"),
    )
    return jobs(rows, 950)
