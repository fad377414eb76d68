"""One typed predicate for both surfaces, compiled to columns.

A missing property makes every leaf false (but NOT IN of the query language, which is true); values of
other types never compare; whole numbers and floats do.  Trees of AND and OR treat a null leaf as a
filter treats false, so plain leaves stay plain and reach the Parquet scan; only what is negated is
wrapped in ``coalesce`` first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidRequest

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType, T.DecimalType)
MAX_DEPTH, MAX_NODES = 16, 128


def kind_of(dtype) -> str:
    if isinstance(dtype, T.StringType):
        return "string"
    if isinstance(dtype, NUMBERS):
        return "integer"
    if isinstance(dtype, FLOATS):
        return "float"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "time"
    if isinstance(dtype, T.ArrayType):
        return "list"
    return "other"


def literal_kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    return {int: "integer", float: "float", str: "string", type(None): "null"}.get(type(value), "list")


def _apply(left, op: str, right):
    return {"=": left == right, "<>": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]


def compare(column, dtype, op: str, value) -> F.Column:
    """A comparison with a literal; false across types and for missing values."""
    a, b = kind_of(dtype), literal_kind(value)
    if a == "time" and b == "string":  # RFC 3339 text, compared as an instant so that the filter reaches the scan
        return _apply(column, op, F.to_timestamp_ntz(F.lit(value.rstrip("Z").replace("T", " "))))
    if a == "bool" and b == "bool" and op in ("=", "<>") or a == b == "string" or a == b == "integer":
        return _apply(column, op, F.lit(value))
    if {a, b} <= {"integer", "float"}:
        wide = column.cast("double") if a == "integer" else column
        return _apply(wide, op, F.lit(float(value)))
    return F.lit(False)


def contains(column, dtype, values: list) -> F.Column:
    """Equality with any literal; for a list property, membership of any."""
    if kind_of(dtype) == "list":
        inner = kind_of(dtype.elementType)
        same = [v for v in values if literal_kind(v) == inner]
        if not same:
            return F.lit(False)
        return F.arrays_overlap(column, F.array(*[F.lit(v).cast(dtype.elementType) for v in same]))
    a = kind_of(dtype)
    kinds = {v for v in map(literal_kind, values)}
    if kinds == {a} and a in ("string", "integer"):
        return column.isin(values)
    out = F.lit(False)
    for v in values:
        out = out | compare(column, dtype, "=", v)
    return out


def wildcard(pattern: str) -> str:
    """A whole-string regular expression for a glob with ``*`` and ``?``."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.sub(r"([\\.^$|()\[\]{}+])", r"\\\1", c) for c in pattern) + "$"


# ---------------------------------------------------------------- contract predicates


@dataclass
class Filter:
    """One condition of a read request: equal, not_equal, exists, not_exists, in, not_in, gt, gte, lt, lte, wildcard, nested."""

    field: str
    op: str
    value: object = None


@dataclass
class Group:
    """``all`` or ``any`` of conditions and groups."""

    mode: str
    items: list = field(default_factory=list)


RANGES = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<="}


def validate(predicate, depth: int = 1, nodes: list | None = None) -> None:
    """Depth, size and shape limits of a predicate; raises InvalidRequest."""
    nodes = nodes if nodes is not None else [0]
    nodes[0] += 1
    if depth > MAX_DEPTH or nodes[0] > MAX_NODES:
        raise InvalidRequest(f"a predicate is at most {MAX_DEPTH} deep and has at most {MAX_NODES} nodes")
    if isinstance(predicate, Group):
        if predicate.mode not in ("all", "any") or not predicate.items:
            raise InvalidRequest("a group is all or any of at least one item")
        for item in predicate.items:
            validate(item, depth + 1, nodes)
        return
    if not predicate.field:
        raise InvalidRequest("a condition names a field")
    op, value = predicate.op, predicate.value
    if op in ("in", "not_in") and not (isinstance(value, list) and value):
        raise InvalidRequest(f"{op} takes a list")
    if op in RANGES and (isinstance(value, list) or value is None):
        raise InvalidRequest(f"{op} takes one value")
    if op == "wildcard" and not isinstance(value, str):
        raise InvalidRequest("wildcard takes a pattern")
    if op == "nested":
        if not isinstance(value, Group):
            raise InvalidRequest("nested takes a group of conditions")
        validate(value, depth + 1, nodes)
    elif op not in ("equal", "not_equal", "exists", "not_exists", "in", "not_in", "wildcard", *RANGES):
        raise InvalidRequest(f"unknown operator {op}")


class Fields:
    """Looks up dotted fields in typed columns or structs: ``(column, type)`` or None where absent."""

    def __init__(self, schema: T.StructType, base: F.Column | None = None):
        self.schema, self.base = schema, base

    def __call__(self, path: str):
        at, schema = self.base, self.schema
        for part in path.split("."):
            if not isinstance(schema, T.StructType) or part not in schema.names:
                return None
            at = F.col(f"`{part}`") if at is None else at.getField(part)
            schema = schema[part].dataType
        return at, schema


def to_column(predicate, fields) -> F.Column:
    """A contract predicate as a column for a filter."""
    if isinstance(predicate, Group):
        out = None
        for item in predicate.items:
            c = to_column(item, fields)
            out = c if out is None else (out & c if predicate.mode == "all" else out | c)
        return out
    found = fields(predicate.field)
    op, value = predicate.op, predicate.value
    if op == "exists":
        return found[0].isNotNull() if found else F.lit(False)
    if op == "not_exists":
        return found[0].isNull() if found else F.lit(True)
    if not found:
        return F.lit(False)
    column, dtype = found
    is_list = kind_of(dtype) == "list"
    present = column.isNotNull()
    if op == "nested":
        if is_list:
            return F.exists(column, lambda x: to_column(value, Fields(dtype.elementType, x)))
        return present & to_column(value, Fields(dtype, column))
    if op == "equal":
        exact = _typed_equal(column, dtype, value)
        return exact | contains(column, dtype, [value]) if is_list else exact
    if op == "not_equal":
        return present & ~F.coalesce(_typed_equal(column, dtype, value), F.lit(False))
    if op == "in":
        return contains(column, dtype, value) if is_list else _any_equal(column, dtype, value)
    if op == "not_in":
        if is_list:
            return present & ~F.coalesce(contains(column, dtype, value), F.lit(False))
        return present & ~_any_equal(column, dtype, value)
    if op == "wildcard":
        rule = wildcard(value)
        if is_list:
            return F.exists(column, lambda x: x.rlike(rule))
        return column.rlike(rule) if kind_of(dtype) == "string" else F.lit(False)
    if is_list:
        return F.lit(False)
    return compare(column, dtype, RANGES[op], value)


def _typed_equal(column, dtype, value) -> F.Column:
    """Equality of type and value: 1 and 1.0 differ here."""
    a, b = kind_of(dtype), literal_kind(value)
    if a == "list" and b == "list":
        return column == F.array(*[F.lit(v) for v in value]).cast(dtype)
    return column == F.lit(value) if a == b else F.lit(False)


def _any_equal(column, dtype, values) -> F.Column:
    same = [v for v in values if literal_kind(v) == kind_of(dtype)]
    return column.isin(same) if same else F.lit(False)
