"""Claims, evidence and time: validators, as-of reads, branch queries, resolutions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidRequest
from ..model import CLAIM_MOVES
from .traverse import bad_ends, cyclic_edges, dangling


# ---------------------------------------------------------------- time

def as_of(facts: DataFrame, valid_at, known_at=None) -> DataFrame:
    """States valid at a time, as they were known at another: valid_from <= t < valid_to (open if null)."""
    rule = (F.col("valid_from") <= valid_at) & (F.col("valid_to").isNull() | (F.col("valid_to") > valid_at))
    return facts.where(rule if known_at is None else rule & (F.col("transaction_time") <= known_at))


def bad_assertions(facts: DataFrame) -> DataFrame:
    """Facts whose transaction time isn't later than the one before (by sequence) of the same fact."""
    w = Window.partitionBy("fact_id").orderBy("seq")
    return facts.withColumn("before", F.lag("transaction_time").over(w)).where(F.col("transaction_time") <= F.col("before")).select("fact_id", "seq")


def memory_visible(now) -> F.Column:
    """Active, not expired, and valid now; a time that can't be read hides the row."""

    def holds(column, rule):
        at = F.try_to_timestamp(F.col(column))
        return F.col(column).isNull() | F.coalesce(rule(at), F.lit(False))

    t = F.to_timestamp(F.lit(now))
    return (
        (F.col("lifecycle") == "active") & holds("expires_at", lambda x: x > t)
        & holds("valid_from", lambda x: x <= t) & holds("valid_until", lambda x: x >= t)
    )


# ---------------------------------------------------------------- validators

def unsupported_claims(claims: DataFrame, supports: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims that nothing of kind Observation or Evidence supports."""
    good = sources.where(F.col("kind").isin("Observation", "Evidence")).select(F.col("id").alias("src"))
    held = supports.where(F.col("rel_type") == "SUPPORTS").join(good, "src", "left_semi").select(F.col("dst").alias("id"))
    return claims.join(held, "id", "left_anti").select("id", F.lit("unsupported_claim").alias("rule"))


def circular_sources(supports: DataFrame, reports: DataFrame) -> DataFrame:
    """Claims with two or more supporters that all come from one source."""
    by_source = supports.where(F.col("rel_type") == "SUPPORTS").select(F.col("dst").alias("claim"), F.col("src").alias("observation")).join(
        reports.where(F.col("rel_type") == "REPORTS").select(F.col("dst").alias("observation"), F.col("src").alias("source")), "observation"
    )
    counts = by_source.groupBy("claim").agg(F.count_distinct("observation").alias("observations"), F.count_distinct("source").alias("sources"))
    return counts.where("observations >= 2 and sources = 1").select(F.col("claim").alias("id"), F.lit("circular_source").alias("rule"))


def open_contradictions(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    live = nodes.where(~F.col("status").isin("rejected", "tombstoned")).select("id")
    both = edges.where(F.col("rel_type") == "CONTRADICTS").join(live.withColumnRenamed("id", "src"), "src", "left_semi").join(live.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return both.select("id", F.lit("open_contradiction").alias("rule"))


def stale_evidence(evidence: DataFrame, now) -> DataFrame:
    return evidence.where(F.col("valid_until").isNotNull() & (F.col("valid_until") < now)).select("id", F.lit("stale_evidence").alias("rule"))


def structure(edges: DataFrame, nodes: DataFrame, kinds: DataFrame, rules: dict, acyclic: list[str]) -> DataFrame:
    """(id, rule): dangling ends, ends of kinds that don't fit, and edges that lie on or between cycles of acyclic types."""
    out = dangling(edges, nodes).select(F.col("rel").alias("id"), F.lit("dangling_link").alias("rule"))
    out = out.unionByName(bad_ends(edges, kinds, rules).select(F.col("rel").alias("id"), F.lit("schema_violation").alias("rule")))
    for kind in acyclic:
        out = out.unionByName(cyclic_edges(edges.where(F.col("rel_type") == kind)).select("id", F.lit("impossible_cycle").alias("rule")))
    return out.distinct()


def _blank(name: str) -> F.Column:
    return F.coalesce(F.trim(F.col(name)) == "", F.lit(True))


def _none(name: str) -> F.Column:
    return F.coalesce(F.size(name), F.lit(0)) <= 0


RESEARCH_KINDS = ("claim", "finding", "result", "replication_attempt")


def research_rules(known_kinds: tuple = RESEARCH_KINDS) -> dict[str, F.Column]:
    """Code of a rule to the condition that breaks it, over (kind, status, asserting_work, credited_actor, result_refs,
    source_refs, attempts array<struct<target_work, reporting_work>>, evidence_refs, supporting array<struct<retracted, override_reason>>)."""
    kind, validated = F.col("kind"), F.coalesce(F.col("status") == "validated", F.lit(False))
    is_ = lambda *k: F.coalesce(kind.isin(*k), F.lit(False))
    named = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    one = F.coalesce(F.size("attempts") == 1, F.lit(False)) & F.coalesce(
        F.exists("attempts", lambda a: named(a["target_work"]) & named(a["reporting_work"])), F.lit(False)
    )
    unmended = F.exists("supporting", lambda w: F.coalesce(w["retracted"], F.lit(False)) & ~named(w["override_reason"]))
    return {
        "RESEARCH_CLAIM_ATTRIBUTION_REQUIRED": is_("claim") & (_blank("asserting_work") | _blank("credited_actor")),
        "RESEARCH_FINDING_RESULT_REQUIRED": is_("finding") & _none("result_refs"),
        "RESEARCH_RESULT_SOURCE_REQUIRED": is_("result") & _none("source_refs"),
        "RESEARCH_REPLICATION_ATTRIBUTION_REQUIRED": is_("replication_attempt") & ~one,
        "RESEARCH_NODE_TYPE_REQUIRED": ~is_(*known_kinds),
        "EVIDENCE_REQUIRED": validated & is_("claim", "finding") & _none("evidence_refs"),
        "RESEARCH_RETRACTED_SUPPORT_REQUIRES_OVERRIDE": validated & F.coalesce(unmended, F.lit(False)),
    }


def citation_rules() -> dict[str, F.Column]:
    """The same for citations (citing_work, cited_work, stance, locator, status, evidence_refs): a stance needs a locator and evidence."""
    held = F.coalesce((F.col("stance") != "cites") & (F.col("status") == "validated"), F.lit(False))
    return {
        "RESEARCH_CITATION_ENDPOINTS_REQUIRED": _blank("citing_work") | _blank("cited_work"),
        "RESEARCH_CITATION_LOCATOR_REQUIRED": held & _blank("locator"),
        "EVIDENCE_REQUIRED": held & _none("evidence_refs"),
    }


def medical_rules() -> dict[str, F.Column]:
    """The same over (kind, status, participant_level, attested_by, study_refs, evidence_refs, window_start, window_end)."""
    kind, validated = F.col("kind"), F.coalesce(F.col("status") == "validated", F.lit(False))
    is_ = lambda *k: F.coalesce(kind.isin(*k), F.lit(False))
    return {
        "MEDICAL_DEIDENTIFICATION_REQUIRED": F.coalesce(F.col("participant_level"), F.lit(False)) & _blank("attested_by"),
        "EVIDENCE_REQUIRED": validated & is_("finding", "effect_estimate") & _none("evidence_refs"),
        "MEDICAL_EFFECT_ESTIMATE_STUDY_REF": is_("effect_estimate") & (F.coalesce(F.size("study_refs"), F.lit(0)) != 1),
        "MEDICAL_ADVERSE_EVENT_WINDOW_REQUIRED": is_("adverse_event") & (_blank("window_start") | _blank("window_end")),
    }


def findings(rows: DataFrame, rules: dict[str, F.Column], key: str = "id") -> DataFrame:
    """(id, rule) of every broken rule, in one pass."""
    broken = F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in sorted(rules.items())]))
    return rows.select(key, F.explode(broken).alias("rule"))


def drift(rows: DataFrame, key: str, order: str, value: str, factor: float = 3.0) -> DataFrame:
    """Latest values far from the mean of those before (more than ``factor`` standard deviations)."""
    past = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(key)
    return (
        rows.withColumn("mean", F.avg(value).over(past)).withColumn("sd", F.stddev_samp(value).over(past))
        .withColumn("last", F.max(order).over(whole)).where(F.col(order) == F.col("last"))
        .where(F.abs(F.col(value) - F.col("mean")) > factor * F.col("sd")).select(key, F.col(value).alias("value"), "mean")
    )


# ---------------------------------------------------------------- claims

def move_allowed(before, after) -> F.Column:
    rule = (before == after) & before.isin(*CLAIM_MOVES)
    for a, bs in CLAIM_MOVES.items():
        if bs:
            rule = rule | ((before == a) & after.isin(*bs))
    return F.coalesce(rule, F.lit(False))


def resolve(votes: DataFrame) -> DataFrame:
    """Resolution of claims from votes ``(claim, kind, value)``: links and stances by side, trust by 0.6.

    Links that supersede and stances that withhold judgment take no side; without a vote that does there is no confidence.
    """
    value = F.col("value")
    side = (
        F.when(F.col("kind") == "trust", F.when(value.try_cast("double") >= 0.6, 1).when(value.isNotNull(), -1))
        .when(F.col("kind") == "link", F.when(value == "supports", 1).when(value.isin("refutes", "contradicts"), -1))
        .when(F.col("kind") == "stance", F.when(value.isin("supports", "accepts"), 1).when(value.isin("refutes", "rejects", "disputes"), -1))
    )
    t = votes.select("claim", side.alias("side")).groupBy("claim").agg(
        F.count_if(F.col("side") == 1).alias("supports"), F.count_if(F.col("side") == -1).alias("refutes")
    )
    total = F.col("supports") + F.col("refutes")
    state = F.when(F.col("supports") > F.col("refutes"), "supported").when(F.col("refutes") > F.col("supports"), "disputed").otherwise("unresolved")
    return t.select("claim", "supports", "refutes", state.alias("resolution"), F.when(total > 0, F.greatest("supports", "refutes") / total).alias("confidence"))


def replication(rows: DataFrame, key: str = "finding") -> DataFrame:
    """Status of findings from replication outcomes: replicated or failed where all attempts agree, mixed where both occur."""
    c = rows.groupBy(key).agg(
        F.count_if(F.col("outcome") == "successful").alias("good"), F.count_if(F.col("outcome") == "failed").alias("bad"), F.count("outcome").alias("n")
    )
    state = (
        F.when(F.col("n") == 0, "not_attempted").when(F.col("good") == F.col("n"), "replicated").when(F.col("bad") == F.col("n"), "failed_to_replicate")
        .when((F.col("good") > 0) & (F.col("bad") > 0), "mixed").otherwise("inconclusive")
    )
    return c.select(key, state.alias("status"))


# ---------------------------------------------------------------- branches

def discriminating(branches: DataFrame, observations: DataFrame) -> DataFrame:
    """Observations whose effect differs between branches; none stated is neutral.  Branches are a handful."""
    full = observations.select("observation").distinct().crossJoin(F.broadcast(branches.select("branch")))
    told = full.join(observations, ["observation", "branch"], "left").withColumn("effect", F.coalesce("effect", F.lit("neutral")))
    return told.groupBy("observation").agg(F.count_distinct("effect").alias("effects")).where("effects > 1")


def smallest_disproof(observations: DataFrame) -> DataFrame:
    return observations.where(F.col("effect") == "contradicts").groupBy("branch").agg(F.min("observation").alias("observation"))


def source_impact(observations: DataFrame, source) -> DataFrame:
    """Evidence each branch loses without a source, and what stays."""
    return observations.groupBy("branch").agg(F.count_if(F.col("source") == source).alias("lost"), F.count_if(F.col("source") != source).alias("left"))


def rank_branches(scores: DataFrame) -> DataFrame:
    total = F.col("support") + F.col("prediction") - F.col("contradiction")
    w = Window.orderBy(F.desc("total"), "world", "branch")  # one row a branch
    return scores.select("world", "branch", total.alias("total")).withColumn("rank", F.row_number().over(w))


def next_evidence(candidates: DataFrame) -> DataFrame:
    w = Window.orderBy(F.desc("eligible"), F.desc("expected_value"), "id")
    return candidates.withColumn("rank", F.row_number().over(w))


def effects(observations: DataFrame, branch: str) -> DataFrame:
    return observations.where(F.col("branch") == branch).groupBy("effect").agg(F.array_sort(F.collect_set("observation")).alias("observations"))


# ---------------------------------------------------------------- questions

LEVELS = ("tactical", "operational", "strategic")
INTENTS = {"tactical_evidence_detail": "tactical", "operational_campaign_analysis": "operational", "strategic_objective_assessment": "strategic"}


def resolution_level(intents: list[str], explicit: str | None = None) -> tuple[str, str]:
    """(level, reason): the most detailed level of a question's intents; an explicit one must be the same.

    Reasons: direct, ambiguous_most_detailed (intents of several levels) or explicit_match.
    """
    if unknown := [i for i in intents if i not in INTENTS]:
        raise InvalidRequest(f"unsupported intents {unknown}")
    found = sorted({INTENTS[i] for i in intents}, key=LEVELS.index)
    if not found:
        raise InvalidRequest("at least one intent is needed")
    if explicit is not None and explicit != found[0]:
        raise InvalidRequest(f"level {explicit} disagrees with the question's {found[0]}")
    return found[0], "explicit_match" if explicit else "ambiguous_most_detailed" if len(found) > 1 else "direct"


def tiers(moves: DataFrame) -> DataFrame:
    """Current tier of each record from ``moves(record, seq, tier, audited)``: canonical needs an audited move."""
    good = moves.where((F.col("tier") != "canonical") | F.coalesce("audited", F.lit(False)))
    return good.groupBy("record").agg(F.max_by("tier", "seq").alias("tier"))


def evictions(hot: DataFrame, budget: int) -> DataFrame:
    """Records to evict from a working set: unpinned and clean ones, highest id first, down to the budget."""
    over = hot.count() - budget
    if over <= 0:
        return hot.limit(0).select("id")
    return hot.where("not pinned and not dirty").orderBy(F.desc("id")).limit(over).select("id")


def mixed_path(steps: DataFrame) -> DataFrame:
    """(path, valid, score): steps join up, and levels are equal or next to one another."""
    w = Window.partitionBy("path").orderBy("seq")
    level = F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(LEVELS) for x in (n, i)]), F.col("level"))
    linked = steps.withColumn("n", level).withColumn("from", F.lag("dst").over(w)).withColumn("was", F.lag("n").over(w))
    ok = F.col("from").isNull() | ((F.col("from") == F.col("src")) & (F.abs(F.col("n") - F.col("was")) <= 1))
    return linked.groupBy("path").agg(F.min(ok.cast("int")).cast("boolean").alias("valid"), F.sum("score").alias("score"))


def hyper_edges(events: DataFrame) -> DataFrame:
    """Binary edges of n-ary events: ``events(id, participants array<struct<node, role>>)``."""
    return events.select("id", F.explode("participants").alias("p")).select(F.col("id").alias("src"), F.col("p.node").alias("dst"), F.col("p.role").alias("role"))


def co_participants(events: DataFrame, node: str, role: str | None = None) -> DataFrame:
    rows = hyper_edges(events.where(F.exists("participants", lambda p: p["node"] == node)))
    rows = rows.where(F.col("dst") != node)
    return rows.where(F.col("role") == role) if role else rows
