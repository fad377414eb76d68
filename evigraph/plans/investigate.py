"""Declarative investigations: ``INVESTIGATE attribution OF Campaign("C-1") ... RETURN ...``.

A contract states what evidence must hold, what may be used, what may be spent and what comes back.  It is
compiled to a list of stages, run as DataFrame steps over a graph, and checked against what was observed:
the first broken contract stops the investigation and every outcome is reported.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ParseError, Unsupported
from ..functions.core import INSTANT
from ..operators.traverse import BOTH, Policy, walk

INTENTS = ("attribution",)
TARGETS = ("Campaign", "Actor", "Narrative", "Indicator")
RETURNS = ("assessment", "proof_graph", "counter_evidence", "unknowns", "next_best_evidence")
ALLOWANCES = ("hypotheses", "contradictory_evidence")
DAY = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$"
UNITS = {"memory": {"b": 1, "kb": 1 << 10, "mb": 1 << 20, "gb": 1 << 30}, "latency": {"ms": 1, "s": 1000}}
CLAUSES = ("AT TIME", "REQUIRE", "ALLOW", "BUDGET", "RETURN")


@dataclass
class Investigation:
    intent: str
    kind: str
    target: str
    at: str | None = None
    sources: int | None = None
    reliability: float | None = None
    completeness: float | None = None
    allow: dict = field(default_factory=dict)
    budget: dict = field(default_factory=dict)
    returns: list = field(default_factory=list)

    def canonical(self) -> str:
        """The contract in one line, clauses in order; parsing it gives the same contract."""
        out = [f'INVESTIGATE {self.intent} OF {self.kind}("{self.target}")']
        if self.at:
            out.append(f"AT TIME {self.at}")
        need = [f"independent_sources >= {self.sources}"] if self.sources is not None else []
        need += [f"source_reliability >= {self.reliability:g}"] if self.reliability is not None else []
        need += [f"evidence_completeness >= {self.completeness:g}"] if self.completeness is not None else []
        if need:
            out.append("REQUIRE " + ", ".join(need))
        if self.allow:
            out.append("ALLOW " + ", ".join(f"{k} = {str(v).lower()}" for k, v in sorted(self.allow.items())))
        if self.budget:
            unit = {"memory": " b", "latency": " ms"}
            out.append("BUDGET " + ", ".join(f"{k} = {v}{unit.get(k, '')}" for k, v in sorted(self.budget.items())))
        return " ".join([*out, "RETURN " + ", ".join(self.returns)])


def parse(text: str) -> Investigation:
    flat = " ".join(text.split())
    head = re.match(r'INVESTIGATE (\w+) OF (\w+)\("([^"]+)"\)(?: (.*))?$', flat, re.I)
    if not head:
        raise ParseError('an investigation starts with INVESTIGATE intent OF Kind("id")')
    intent, kind, target, rest = head[1].lower(), head[2], head[3], head[4] or ""
    if intent not in INTENTS:
        raise Unsupported(f"intent {intent}")
    if kind not in TARGETS:
        raise Unsupported(f"target {kind}")
    if re.search(r"\b(MATCH|CREATE|MERGE|SET|DELETE|REMOVE)\b", rest):
        raise Unsupported("clauses of the query language")
    parts = re.split(r"\b(AT TIME|REQUIRE|ALLOW|BUDGET|RETURN)\b", rest)
    if parts[0].strip():
        raise ParseError(f"unexpected {parts[0].strip()}")
    seen: dict[str, str] = {}
    for name, body in zip(parts[1::2], parts[2::2]):
        if name in seen:
            raise ParseError(f"a second {name}")
        seen[name] = body.strip()
    if not seen.get("RETURN"):
        raise ParseError("RETURN is missing")
    out = Investigation(intent, kind, target)
    if "AT TIME" in seen:
        out.at = seen["AT TIME"].strip('"')
        if not re.match(INSTANT, out.at) and not re.match(DAY, out.at):
            raise ParseError("AT TIME takes a day or an instant in UTC")
    for item in filter(None, re.split(r"\s*,\s*", seen.get("REQUIRE", ""))):
        m = re.fullmatch(r"(independent_sources|source_reliability|evidence_completeness) >= ([\d.]+)", item)
        if not m:
            raise ParseError(f"unknown requirement {item}")
        if m[1] == "independent_sources":
            out.sources = int(m[2])
        elif not 0 <= float(m[2]) <= 1:
            raise ParseError(f"{m[1]} is between 0 and 1")
        elif m[1] == "source_reliability":
            out.reliability = float(m[2])
        else:
            out.completeness = float(m[2])
    for item in filter(None, re.split(r"\s*,\s*", seen.get("ALLOW", ""))):
        m = re.fullmatch(r"(\w+) = (true|false)", item)
        if not m or m[1] not in ALLOWANCES:
            raise ParseError(f"unknown allowance {item}")
        out.allow[m[1]] = m[2] == "true"
    for item in filter(None, re.split(r"\s*,\s*", seen.get("BUDGET", ""))):
        m = re.fullmatch(r"(memory|latency|external_retrievals) <?= ?(\d+) ?(\w*)", item)
        if not m or (m[1] in UNITS) != (m[3].lower() in UNITS.get(m[1], {})):
            raise ParseError(f"unknown budget {item}")
        out.budget[m[1]] = int(m[2]) * UNITS.get(m[1], {}).get(m[3].lower(), 1)
    out.returns = [r.strip() for r in seen["RETURN"].split(",")]
    for r in out.returns:
        if r not in RETURNS:
            raise Unsupported(f"RETURN {r}")
    return out


def plan(q: Investigation, capabilities: set | None = None) -> list[dict]:
    """Stages in order, each with the clause that asks for it; a stage the engine lacks is an error."""
    stages = [("seed_selection", "OF", {"target_kind": q.kind, "target": q.target}), ("working_set", "implicit", {"max_depth": 3})]
    if q.at:
        stages.append(("temporal_filter", "AT TIME", {"at": q.at}))
    if q.sources is not None:
        stages.append(("independent_sources", "REQUIRE", {"minimum": q.sources}))
    if q.reliability is not None:
        stages.append(("source_reliability", "REQUIRE", {"minimum": q.reliability}))
    if q.completeness is not None:
        stages.append(("evidence_completeness", "REQUIRE", {"minimum": q.completeness}))
    stages += [("allowance", "ALLOW", {"name": k, "allowed": v}) for k, v in sorted(q.allow.items())]
    stages += [("budget", "BUDGET", {"name": k, "most": v}) for k, v in sorted(q.budget.items())]
    stages.append(("projection", "RETURN", {"fields": q.returns}))
    for name, _, _ in stages:
        if capabilities is not None and name not in capabilities:
            raise Unsupported(f"the engine has no {name}")
    return [{"stage": i, "kind": k, "clause": c, **d} for i, (k, c, d) in enumerate(stages)]


def enforce(q: Investigation, observed: dict) -> list[dict]:
    """(contract, satisfied, expected, observed) of every contract, in order."""
    out = []

    def add(name, ok, want, got):
        out.append({"contract": name, "satisfied": bool(ok), "expected": str(want), "observed": str(got)})

    if q.at:
        add("temporal_snapshot", observed.get("snapshot") == q.at, q.at, observed.get("snapshot"))
    if q.sources is not None:
        add("independent_sources", observed.get("sources", 0) >= q.sources, q.sources, observed.get("sources", 0))
    if q.reliability is not None:
        got = observed.get("reliability")
        add("source_reliability", got is not None and got >= q.reliability, q.reliability, got)
    if q.completeness is not None:
        add("evidence_completeness", observed.get("completeness", 0.0) >= q.completeness, q.completeness, observed.get("completeness", 0.0))
    for k, v in sorted(q.allow.items()):
        add(f"allow_{k}", v or not observed.get(k, 0), v, observed.get(k, 0))
    for k, v in sorted(q.budget.items()):
        add(f"budget_{k}", observed.get(k, 0) <= v, v, observed.get(k, 0))
    return out


def respond(q: Investigation, found: dict) -> dict:
    """Exactly the fields asked for; what isn't available says so and why."""
    return {r: {"available": True, "value": found[r]} if r in found else {"available": False, "reason": "not produced by this investigation"} for r in q.returns}


def investigate(nodes: DataFrame, edges: DataFrame, text: str, max_depth: int = 3) -> dict:
    """Run a contract over ``nodes(id, kind, valid_from, valid_until, reliability)`` and ``edges(id, src, dst, rel_type)``.

    The working set is a bounded walk from the target; its Source nodes are the independent sources.
    """
    q = parse(text)
    stages = plan(q)
    rows = nodes
    if q.at:
        rows = rows.where((F.col("valid_from").isNull() | (F.col("valid_from") <= q.at)) & (F.col("valid_until").isNull() | (F.col("valid_until") > q.at)))
    if q.allow.get("hypotheses") is False:
        rows = rows.where(F.col("kind") != "Hypothesis")
    if q.reliability is not None:
        rows = rows.where((F.col("kind") != "Source") | (F.col("reliability") >= q.reliability))
    reached = walk(edges, rows, [q.target], Policy(max_depth=max_depth, direction=BOTH))
    ids = reached.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    against = inside.where(F.col("rel_type").isin("CONTRADICTS", "REFUTES"))
    kinds = reached.join(rows, "id").groupBy().agg(
        F.count_if(F.col("kind") == "Source").alias("sources"), F.min(F.when(F.col("kind") == "Source", F.col("reliability"))).alias("reliability"),
        F.count_if(F.col("kind") == "Hypothesis").alias("hypotheses"), F.count_if(F.col("kind") == "Claim").alias("claims"),
    ).first()
    held = inside.where(F.col("rel_type") == "SUPPORTS").select(F.col("dst").alias("id")).distinct()
    claims = reached.join(rows.where(F.col("kind") == "Claim").select("id"), "id", "left_semi").select("id")
    open_claims = claims.join(held, "id", "left_anti")
    # the share of claims in the working set that something supports; a set without claims is complete
    complete = 1.0 if not kinds["claims"] else 1 - open_claims.count() / kinds["claims"]
    observed = {
        "snapshot": q.at, "sources": kinds["sources"], "reliability": kinds["reliability"], "hypotheses": kinds["hypotheses"], "completeness": complete,
        "contradictory_evidence": against.count() if "contradictory_evidence" in q.allow else 0,
    }
    outcomes = enforce(q, observed)
    broken = [o["contract"] for o in outcomes if not o["satisfied"]]
    found: dict = {"unknowns": broken}
    if not broken:
        found |= {
            "assessment": {"target": q.target, "sources": kinds["sources"], "completeness": complete},
            "proof_graph": reached, "counter_evidence": against, "next_best_evidence": open_claims,
        }
    return {"stages": stages, "outcomes": outcomes, "stopped": broken[0] if broken else None, "response": respond(q, found)}
