"""Access rules as one column, put before every other operator of a read."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from ..errors import InvalidRequest


@dataclass
class Context:
    """Who asks: identities and what they hold."""

    user: str = ""
    system: bool = False
    tenant: str | None = None
    markings: list[str] = field(default_factory=list)
    organisations: list[str] = field(default_factory=list)
    groups: list[str] = field(default_factory=list)
    authorities: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Policy:
    """A compiled context: sorted sets, the identities that grants may name, and a fingerprint for caches and tokens."""

    system: bool
    user: str
    tenant: str | None
    markings: tuple
    organisations: tuple
    identities: tuple
    authorities: tuple

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(self.__dict__, sort_keys=True).encode()).hexdigest()


def _clean(values) -> tuple:
    return tuple(sorted({v.strip() for v in values if v and v.strip()}))


def compile_policy(context: Context) -> Policy:
    user = context.user.strip()
    if not user and not context.system:
        raise InvalidRequest("a context names a user or is the system's")
    return Policy(
        context.system, user, context.tenant, _clean(context.markings), _clean(context.organisations),
        _clean([user, *context.groups, *context.organisations]), _clean(context.authorities),
    )


#: Metadata columns, all optional; absent ones restrict nothing.
ACCESS = (
    "struct<markings:array<string>,tenants:array<string>,denied:array<string>,owner:string,creators:array<string>,"
    "members:array<string>,authorities:array<string>,public:boolean,shared:array<string>,organisations:array<string>,malformed:boolean>"
)


def allowed(policy: Policy, access: F.Column) -> F.Column:
    """The decision ladder, first hit wins; ``access`` is a struct like :data:`ACCESS`, null for unrestricted."""
    if policy.system:
        return F.lit(True)

    def known(name):
        return F.coalesce(access[name], F.array().cast("array<string>"))

    def hits(name, values):
        return F.arrays_overlap(known(name), F.array(*[F.lit(v) for v in values]).cast("array<string>")) if values else F.lit(False)

    held = F.array(*[F.lit(v) for v in policy.markings]).cast("array<string>")
    mine = policy.identities
    restricted = (
        access["owner"].isNotNull() | (F.size(known("creators")) > 0) | (F.size(known("members")) > 0)
        | (F.size(known("authorities")) > 0) | (F.size(known("shared")) > 0) | (F.size(known("organisations")) > 0)
    )
    ladder = (
        F.when(access.isNull(), True)
        .when(F.coalesce(access["malformed"], F.lit(False)), False)
        .when(F.size(F.array_except(known("markings"), held)) > 0, False)
        .when((F.size(known("tenants")) > 0) & ~F.array_contains(known("tenants"), F.lit(policy.tenant or "\x00")), False)
        .when(hits("denied", mine), False)
        .when(F.coalesce(access["owner"] == F.lit(policy.user), F.lit(False)), True)
        .when(hits("creators", [policy.user]), True)
        .when(hits("members", mine), True)
        .when(hits("authorities", policy.authorities), True)
        .when(F.coalesce(access["public"], F.lit(False)) | hits("shared", mine), True)
        .when(hits("organisations", policy.organisations), True)
        .when(restricted, False)
        .otherwise(True)
    )
    return F.coalesce(ladder, F.lit(False))


def visible_edges(edges, nodes):
    """Edges whose both ends are among the nodes that the caller may see (two semi joins, no expansion)."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
