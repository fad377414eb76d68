"""Syntax trees to DataFrames.

A query's rows are joins of label frames and a type frame; names inside are ``variable__column``.  WHERE
comes right after the joins and is left to Catalyst to push below them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BudgetExceeded, ParseError
from ..operators.predicate import compare, contains, kind_of
from . import cypher as C

NATIVE = ("id", "src", "dst", "rel_type")
MAX_LOADED, MAX_RETURNED, MAX_TEXT, MAX_PARAMS = 50_000, 10_000, 8_192, 128


class Rows:
    """Bound rows: the frame and the columns of each variable."""

    def __init__(self, frame: DataFrame, columns: dict[str, dict[str, T.DataType]]):
        self.frame, self.columns = frame, columns

    def ref(self, var: str, prop: str):
        """(column, type) of a property, or None; ``id`` is the record's own unless a property overrides it."""
        kinds = self.columns[var]
        if prop in kinds and prop not in ("src", "dst"):
            return F.col(f"`{var}__{prop}`"), kinds[prop]
        return None


def _named(frame: DataFrame, var: str) -> tuple[DataFrame, dict[str, T.DataType]]:
    kinds = {f.name: f.dataType for f in frame.schema.fields}
    return frame.select(*[F.col(f"`{c}`").alias(f"{var}__{c}") for c in frame.columns]), kinds


def _node_rows(graph, pattern: C.NodePattern, params: dict) -> tuple[DataFrame, dict]:
    frame, kinds = _named(graph.nodes(pattern.label), pattern.var)
    for key, value in pattern.props.items():
        value = C.bind(value, params)
        if key not in kinds:
            frame = frame.where(F.lit(False))
        else:
            frame = frame.where(compare(F.col(f"`{pattern.var}__{key}`"), kinds[key], "=", value))
    return frame, kinds


def match(graph, query: C.Query, params: dict, outer: bool = False) -> Rows:
    """Rows of the MATCH clause; edges with an unseen end vanish in the inner joins."""
    columns: dict[str, dict] = {}
    frame = None
    for p in query.patterns:
        if p.node.var in columns:
            continue
        rows, kinds = _node_rows(graph, p.node, params)
        if p.target is not None:
            rel_var = p.rel_var or "_rel"
            rels, rel_kinds = _named(graph.rels(p.rel_type), rel_var)
            ends, end_kinds = _node_rows(graph, p.target, params) if p.target.var != p.node.var else (None, kinds)
            how = "left" if outer and query.optional else "inner"
            rows = rows.join(rels, F.col(f"`{p.node.var}__id`") == F.col(f"`{rel_var}__src`"), how)
            if ends is None:
                rows = rows.where(F.col(f"`{rel_var}__dst`") == F.col(f"`{p.node.var}__id`"))
            else:
                rows = rows.join(ends, F.col(f"`{rel_var}__dst`") == F.col(f"`{p.target.var}__id`"), how)
                columns[p.target.var] = end_kinds
            columns[rel_var] = rel_kinds
        columns[p.node.var] = kinds
        # a product of small filtered sides, asked for by the text itself
        frame = rows if frame is None else frame.crossJoin(rows)
    return Rows(frame, columns)


def condition(tree, rows: Rows, params: dict) -> F.Column:
    if isinstance(tree, C.Bool):
        out = None
        for item in tree.items:
            c = condition(item, rows, params)
            out = c if out is None else (out & c if tree.op == "AND" else out | c)
        return out
    found = rows.ref(tree.ref.var, tree.ref.prop)
    if tree.op == "NULL":
        return found[0].isNull() if found else F.lit(True)
    if tree.op == "NOT_NULL":
        return found[0].isNotNull() if found else F.lit(False)
    value = C.bind(tree.value, params)
    if tree.op in ("IN", "NOT_IN"):
        if not isinstance(value, list):
            raise ParseError("IN takes a list")
        if not found:
            return F.lit(tree.op == "NOT_IN")
        inside = contains(*found, value)
        return inside if tree.op == "IN" else ~F.coalesce(inside, F.lit(False))
    return compare(*found, tree.op, value) if found else F.lit(False)


def _numbers(column, dtype) -> F.Column:
    """Finite numbers as doubles; null for all else."""
    if kind_of(dtype) == "integer":
        return column.cast("double")
    if kind_of(dtype) == "float":
        wide = column.cast("double")
        return F.when(~F.isnan(wide) & (F.abs(wide) < F.lit(float("inf"))), wide)
    return F.lit(None).cast("double")


def sort_keys(rows: Rows, order) -> list[F.Column]:
    keys = []
    for ref, down in order:
        found = rows.ref(ref, "id") if isinstance(ref, str) else rows.ref(ref.var, ref.prop)
        if found:
            keys.append(found[0].desc_nulls_last() if down else found[0].asc_nulls_first())
    # ties fall to the ids that are bound, so pages are stable
    return keys + [F.col(f"`{v}__id`").asc_nulls_first() for v in rows.columns if "id" in rows.columns[v]]


def run(graph, text: str | C.Query, params: dict | None = None, *, outer: bool = False, max_loaded: int | None = None, max_returned: int | None = None) -> DataFrame:
    """A read query as a DataFrame with native types.

    ``max_loaded`` bounds the pattern's rows before WHERE, ``max_returned`` the result; beyond either the query
    fails as a whole.  Both are off by default: a scan over a cluster has no reason to stop.
    """
    params = params or {}
    if isinstance(text, str):
        if len(text) > MAX_TEXT or len(params) > MAX_PARAMS:
            raise BudgetExceeded("the text or the parameters are too long")
        query = C.parse(text)
    else:
        query = text
    if query.mutates:
        raise ParseError("a change goes through a store")
    rows = match(graph, query, params, outer)
    if max_loaded is not None and rows.frame.limit(max_loaded + 1).count() > max_loaded:
        raise BudgetExceeded(f"more than {max_loaded} rows before WHERE")
    frame = rows.frame
    if query.where is not None:
        frame = frame.where(condition(query.where, rows, params))
    paged = query.skip is not None or query.limit is not None
    if query.order or paged:
        frame = frame.orderBy(*sort_keys(rows, query.order))
    if query.skip is not None:
        frame = frame.offset(C.bind(query.skip, params))
    if query.limit is not None:
        frame = frame.limit(C.bind(query.limit, params))
    out = project(frame, rows, query.items)
    if query.distinct:
        out = out.distinct()  # after the limit, as the language has it
    if max_returned is not None and out.limit(max_returned + 1).count() > max_returned:
        raise BudgetExceeded(f"more than {max_returned} rows to return")
    return out


def project(frame: DataFrame, rows: Rows, items: list[C.Item]) -> DataFrame:
    aggregates = [i for i in items if i.aggregate]
    if aggregates:
        made = []
        for i in aggregates:
            if i.aggregate == "COUNT":
                c = F.count(F.lit(1)) if i.ref == "*" else F.count(F.col(f"`{i.ref}__id`"))
            else:
                found = rows.ref(i.ref.var, i.ref.prop)
                number = _numbers(*found) if found else F.lit(None).cast("double")
                c = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[i.aggregate](number)
            made.append(c.alias(i.name))
        return frame.agg(*made)
    made = []
    for i in items:
        if isinstance(i.ref, str):
            made.append(F.col(f"`{i.ref}__id`").alias(i.name))
        else:
            found = rows.ref(i.ref.var, i.ref.prop)
            made.append((found[0] if found else F.lit(None).cast("string")).alias(i.name))
    return frame.select(*made)


def rendered(frame: DataFrame) -> DataFrame:
    """Values as text: lists joined by commas, whole floats without their fraction, null as 'null'."""

    def one(f):
        c = F.col(f"`{f.name}`")
        kind = kind_of(f.dataType)
        if kind == "float":
            c = F.when(c == F.floor(c), c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string"))
        elif kind == "list":
            c = F.concat_ws(",", c.cast("array<string>"))
        return F.coalesce(c.cast("string"), F.lit("null")).alias(f.name)

    return frame.select(*[one(f) for f in frame.schema.fields])
