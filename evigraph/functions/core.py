"""Scalar functions as columns, and the registry that names them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import functions as F

from ..errors import Conflict, InvalidRequest, NotFound


def clamp(x, low, high) -> F.Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def supporting_count(x) -> F.Column:
    return F.octet_length(x).cast("long")


def window_overlap_days(a, b) -> F.Column:
    return F.when(a == b, 1).otherwise(0).cast("long")


def normalised_confidence(x) -> F.Column:
    """0 to 100 onto 0 to 1; null outside."""
    return F.when((x >= 0) & (x <= 100), x / 100.0)


def confidence_band(x, validated: float = 0.6, exportable: float = 0.8) -> F.Column:
    return (
        F.when(x.isNull(), "unknown").when(x < validated, "below").when(x < exportable, "validated").otherwise("exportable")
    )


def status(x) -> F.Column:
    """A writable status, or null."""
    from ..model import WRITABLE

    clean = F.lower(F.trim(x))
    return F.when(clean.isin(*WRITABLE), clean)


INSTANT = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?Z$"


def is_instant(x) -> F.Column:
    """A date and a time of day in digits, then Z or an offset; the numbers aren't held against the calendar."""
    return F.coalesce(x.rlike(r"(?s)^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}[Z+-].*$"), F.lit(False))


def entropy(p) -> F.Column:
    """Binary entropy in bits; 0 at the ends."""
    inside = (p > 0) & (p < 1)
    return F.when(inside, -p * F.log2(F.when(inside, p)) - (1 - p) * F.log2(F.when(inside, 1 - p))).otherwise(0.0)


def information_gain(now, outcomes) -> F.Column:
    """Entropy now less the expected entropy after; ``outcomes``: array of (probability, posterior).  Never negative."""
    after = F.aggregate(outcomes, F.lit(0.0), lambda s, o: s + o["probability"] * entropy(o["posterior"]))
    return F.greatest(entropy(now) - after, F.lit(0.0))


def sanitized_type(x) -> F.Column:
    return F.regexp_replace(F.upper(F.trim(x)), "[^A-Z0-9]", "_")


# ---------------------------------------------------------------- domains


LEVELS_OF_EVIDENCE = {
    "oxford-cebm-2011": {
        "systematic_review": "1", "randomized_controlled_trial": "2", "cohort_study": "3", "case_control_study": "3",
        "case_series": "4", "case_report": "4", "expert_opinion": "5",
    }
}


def evidence_level(design, scale="oxford-cebm-2011") -> F.Column:
    """Level of a study design on a named scale; ``unrated`` without a design, ``unknown_scale`` for other scales."""
    scale = F.lit(scale) if isinstance(scale, str) else scale
    out = F.lit("unknown_scale")
    for name, levels in LEVELS_OF_EVIDENCE.items():
        level = F.element_at(F.create_map(*[F.lit(x) for kv in levels.items() for x in kv]), design)
        out = F.when(scale == name, F.coalesce(F.when(design.isNotNull(), level), F.lit("unrated"))).otherwise(out)
    return out


def interval_contains_null(measure, low, high) -> F.Column:
    """Does the interval hold the value of no effect: 1 for ratios, 0 for differences?"""
    none = F.when(measure.isin("ratio", "odds_ratio", "risk_ratio", "hazard_ratio"), 1.0).when(measure.isin("difference", "mean_difference", "risk_difference"), 0.0)
    return (low <= none) & (none <= high)


def deidentification(participant_level, attested_by) -> F.Column:
    """State of a record: without participant-level content, attested by someone named, or missing the attestation."""
    return (
        F.when(~F.coalesce(participant_level, F.lit(False)), "not_participant_level")
        .when(F.coalesce(F.trim(attested_by) != "", F.lit(False)), "attested").otherwise("missing")
    )


def temporal_order(first_seen, last_seen, valid_from, valid_until) -> F.Column:
    """The first pair of times that is out of order, or null; times compare as text, equal ones are in order."""
    return F.when(first_seen > last_seen, "first_seen").when(valid_from > valid_until, "valid_from")


def _digits_sum(text, weights) -> F.Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        c = F.substring(text, i + 1, 1)
        total = total + F.when(c == "X", 10).otherwise(F.try_to_number(c, F.lit("9"))).cast("int") * w
    return total


def identifier(system: str, value) -> F.Column:
    """A normal form of an identifier, null where invalid: doi, arxiv, orcid, issn, pubmed, ror."""
    text = F.trim(value)
    if system == "doi":
        bare = F.lower(F.regexp_replace(text, r"^(?i)(https?://(dx\.)?doi\.org/|doi:)\s*", ""))
        return F.when(bare.rlike(r"^10\.\d{4,9}/\S+$"), bare)
    if system == "arxiv":
        bare = F.lower(F.regexp_replace(text, r"^(?i)(https?://arxiv\.org/abs/|arxiv:)\s*", ""))
        return F.when(bare.rlike(r"^(\d{4}\.\d{4,5}|[a-z-]+(\.[a-z]{2})?/\d{7})(v\d+)?$"), bare)
    if system == "pubmed":
        bare = F.regexp_replace(text, r"^(?i)pmid:\s*", "")
        return F.when(bare.rlike(r"^[1-9]\d{0,8}$"), bare)
    if system == "ror":
        bare = F.lower(F.regexp_replace(text, r"^(?i)https?://ror\.org/", ""))
        return F.when(bare.rlike(r"^0[a-hj-km-np-tv-z0-9]{6}\d{2}$"), bare)
    if system == "issn":
        bare = F.upper(F.regexp_replace(text, r"[\s-]|^(?i)issn:?", ""))
        sums = _digits_sum(bare, [8, 7, 6, 5, 4, 3, 2, 1])
        return F.when(bare.rlike(r"^\d{7}[\dX]$"), F.when(sums % 11 == 0, F.concat(F.substring(bare, 1, 4), F.lit("-"), F.substring(bare, 5, 4))))
    if system == "orcid":
        bare = F.upper(F.regexp_replace(F.regexp_replace(text, r"^(?i)https?://orcid\.org/", ""), "-", ""))
        total = F.lit(0)
        for i in range(15):
            total = (total + F.substring(bare, i + 1, 1).try_cast("int")) * 2
        check = (12 - total % 11) % 11
        last = F.when(F.substring(bare, 16, 1) == "X", 10).otherwise(F.substring(bare, 16, 1).try_cast("int"))
        shown = F.concat_ws("-", *[F.substring(bare, i, 4) for i in (1, 5, 9, 13)])
        return F.when(bare.rlike(r"^\d{15}[\dX]$"), F.when(check == last, shown))
    raise InvalidRequest(f"unknown identifier system {system}")


# ---------------------------------------------------------------- navigation arithmetic

#: Terms of an edge's utility; each counts once, for or against.
UTILITY = (
    ("semantic_relevance", 1), ("downstream_success", 1), ("evidence_gain", 1), ("novelty_gain", 1), ("temporal_relevance", 1),
    ("contradiction_rate", -1), ("staleness", -1), ("traversal_cost", -1), ("dead_end_rate", -1), ("poisoning_risk", -1),
)


def edge_utility(columns: dict) -> F.Column:
    """The sum of ten terms, five of them taken off; missing terms count 0, unknown ones are refused."""
    if unknown := set(columns) - {name for name, _ in UTILITY}:
        raise InvalidRequest(f"no terms of utility: {sorted(unknown)}")
    total = F.lit(0.0)
    for name, w in UTILITY:
        if name in columns:
            total = total + F.coalesce(columns[name].cast("double"), F.lit(0.0)) * w
    return total


def field_score(utility, against) -> F.Column:
    return utility - F.coalesce(against, F.lit(0.0))


def reward(columns: dict, weights: dict) -> F.Column:
    total = F.lit(0.0)
    for name in sorted(weights):
        total = total + F.coalesce(columns[name].cast("double"), F.lit(0.0)) * float(weights[name])
    return total


def traversal_cost(degree, payload, page_in) -> F.Column:
    """A sum that stays at the greatest long instead of overflowing."""
    most = F.lit((1 << 63) - 1)
    return F.coalesce(F.try_add(F.coalesce(F.try_add(degree, payload), most), page_in), most)


def stop_condition(confidence, wanted, completeness, complete, spent, budget, external, gain, least_gain) -> F.Column:
    """sufficient, budget, external, marginal or continue; first hit wins."""
    return (
        F.when((confidence >= wanted) & (completeness >= complete), "sufficient").when(spent >= budget, "budget")
        .when(external, "external").when(gain < least_gain, "marginal").otherwise("continue")
    )


# ---------------------------------------------------------------- registry


@dataclass(frozen=True)
class Spec:
    """A named function: argument and result type names, and how it behaves."""

    name: str
    arguments: tuple
    result: str
    make: Callable
    deterministic: bool = True
    cost: str = "low"
    cache: bool = True
    permissions: tuple = ()


class Registry:
    """Functions by ``namespace.symbol``; those that need a model are given an adapter at call time."""

    def __init__(self):
        self.specs: dict[str, Spec] = {}

    def register(self, spec: Spec) -> None:
        if not re.fullmatch(r"[a-z_]+\.[a-z_]+", spec.name):
            raise InvalidRequest("names are namespace.symbol")
        if spec.name in self.specs:
            raise Conflict(f"{spec.name} is registered")
        self.specs[spec.name] = spec

    def call(self, name: str, columns: list, types: list[str], adapter: Callable | None = None) -> F.Column:
        """A column for a call; arity and types must match exactly."""
        if name not in self.specs:
            raise NotFound(name)
        spec = self.specs[name]
        if tuple(types) != spec.arguments:
            raise InvalidRequest(f"{name} takes {spec.arguments}, not {tuple(types)}")
        if not spec.deterministic:
            if adapter is None:
                raise InvalidRequest(f"{name} needs a model adapter")
            return adapter(*columns)
        return spec.make(*columns)


def standard() -> Registry:
    r = Registry()
    r.register(Spec("evidence.supporting_count", ("string",), "integer", supporting_count))
    r.register(Spec("confidence.clamp", ("float",), "float", lambda x: clamp(x, 0.0, 1.0)))
    r.register(Spec("temporal.window_overlap_days", ("string", "string"), "integer", window_overlap_days))
    r.register(Spec("coordination.window_score", ("integer",), "integer", lambda x: clamp(x, 0, 100)))
    for name in ("cti.observable_kind", "fimi.claim_similarity", "crisis.classification_score"):
        arguments = ("string", "string") if name.endswith("similarity") else ("string",)
        r.register(Spec(name, arguments, "float", lambda *_: None, deterministic=False, cost="high", cache=False))
    return r
