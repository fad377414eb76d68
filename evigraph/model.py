"""Vocabularies and schemas of versioned property graphs.

Properties of stored records are maps from key to canonical JSON text, so each value carries its
type ('"1"' is a string, '1' an integer, '1.0' a float, 'null' an explicit null) and equality of
text is typed equality.  Hot properties of analytic tables are plain typed columns instead.
"""

from __future__ import annotations

from pyspark.sql import functions as F

STATUSES = ("candidate", "needs_evidence", "needs_review", "validated", "rejected", "exportable", "exported", "tombstoned")
WRITABLE = STATUSES[:-1]

NODE = (
    "id string, version long, labels array<string>, props map<string,string>, status string, confidence double, "
    "evidence_refs array<string>, recorded_at string"
)
REL = (
    "id string, version long, src string, dst string, rel_type string, props map<string,string>, status string, "
    "confidence double, evidence_refs array<string>, recorded_at string"
)

#: Node kinds of the epistemic layer, in the order in which a node of several labels is classified.
NODE_KINDS = (
    "Entity", "Event", "Observation", "Claim", "Hypothesis", "Evidence", "Source", "Assessment", "Contradiction", "Inference", "Decision",
)
_SUPPORTERS, _CLAIMS = ("Observation", "Evidence", "Claim"), ("Claim", "Hypothesis")
#: Relation kinds and the node kinds that may stand at their ends.
RELATION_ENDS = {
    "REPORTS": (("Source",), ("Observation",)),
    "SUPPORTS": (_SUPPORTERS, _CLAIMS),
    "REFUTES": (_SUPPORTERS, _CLAIMS),
    "CONTRADICTS": (_SUPPORTERS, _CLAIMS),
    "SUPERSEDES": (("Claim",), ("Claim",)),
    "ASSESSES": (("Assessment",), _CLAIMS),
    "INFERS": (("Inference",), _CLAIMS),
    "DECIDES": (("Decision",), ("Assessment", "Claim", "Hypothesis")),
}

_ENDED = ("superseded", "retracted", "rejected")
#: Lifecycle of claims: what may follow each state; staying in a state is always allowed.
CLAIM_MOVES = {
    "candidate": ("asserted", "rejected", "retracted", "unresolved"),
    "asserted": ("supported", "disputed", "contradicted", "validated", "unresolved", *_ENDED),
    "supported": ("disputed", "contradicted", "validated", "unresolved", *_ENDED),
    "disputed": ("supported", "contradicted", "validated", "unresolved", *_ENDED),
    "contradicted": ("disputed", "unresolved", *_ENDED),
    "unresolved": ("supported", "disputed", "contradicted", "validated", *_ENDED),
    "validated": ("superseded", "retracted"),
    "superseded": (),
    "retracted": (),
    "rejected": (),
}


def node_kind(labels) -> F.Column:
    """The first kind, in the order of ``NODE_KINDS``, that a node's labels name; null outside the vocabulary."""
    return F.coalesce(*[F.when(F.array_contains(labels, k), k) for k in NODE_KINDS])


def visible(df):
    """Rows that reads may see."""
    return df.where(F.col("status").isNull() | (F.col("status") != "tombstoned"))


def latest(versions, key: str = "id", order: str = "version"):
    """The row of the highest version of each key: one aggregation with partial results, no sort of histories."""
    rest = [c for c in versions.columns if c != key]
    top = versions.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("top"))
    return top.select(key, *[F.col("top")[c].alias(c) for c in rest]).select(*versions.columns)
