"""Records: nodes and relationships of a graph under one contract, and reads over them.

A record is ``id, kind, revision, body``; ``body`` is a struct of typed fields.  A read names kinds, a
predicate, an order and a limit; totals are counted before the limit and after access rules.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import BudgetExceeded, InvalidRequest
from .predicate import Fields, kind_of, to_column, validate

MAX_LIST, MAX_TERMS, MAX_CANDIDATES, MAX_PAGE = 10_000, 1_000, 1_000_000, 1_000


@dataclass
class Read:
    """``order``: (field, descending) pairs; ids break ties."""

    kinds: list[str] = field(default_factory=list)
    predicate: object = None
    order: list = field(default_factory=list)
    limit: int = 100


def record_fields(records: DataFrame):
    """Field lookup: id, kind and revision, ``type`` from the body, other names inside the body."""
    body = Fields(records.schema["body"].dataType, F.col("body"))

    def find(path: str):
        if path in ("id", "revision"):
            return F.col(path), records.schema[path].dataType
        if path in ("kind", "type"):
            return body("type") or (F.col("kind"), records.schema["kind"].dataType)
        return body(path)

    return find


def to_records(frame: DataFrame, kind, revision=None) -> DataFrame:
    """A record view of a typed frame: kind is a literal or a column."""
    rest = [c for c in frame.columns if c != "id"]
    return frame.select(
        "id", (kind if isinstance(kind, F.Column) else F.lit(kind)).alias("kind"),
        (revision if revision is not None else F.lit(1)).cast("long").alias("revision"), F.struct(*rest).alias("body"),
    )


def selected(records: DataFrame, read: Read, allowed: F.Column | None = None) -> DataFrame:
    """Records the caller may see that match the request."""
    if read.predicate is not None:
        validate(read.predicate)
    out = records if allowed is None else records.where(allowed)
    if read.kinds:
        out = out.where(F.lower("kind").isin([k.lower() for k in read.kinds]))
    if read.predicate is not None:
        out = out.where(to_column(read.predicate, record_fields(records)))
    return out


def order_keys(records: DataFrame, order) -> list[F.Column]:
    find = record_fields(records)
    keys = []
    for name, down in order:
        found = find(name)
        if found:
            keys.append(found[0].desc_nulls_last() if down else found[0].asc_nulls_first())
    return [*keys, F.col("id").asc()]


def listed(records: DataFrame, read: Read, allowed: F.Column | None = None) -> DataFrame:
    if not 1 <= read.limit <= MAX_LIST:
        raise InvalidRequest(f"limit is 1 to {MAX_LIST}")
    return selected(records, read, allowed).orderBy(*order_keys(records, read.order)).limit(read.limit)


def counted(records: DataFrame, read: Read, allowed: F.Column | None = None) -> DataFrame:
    return selected(records, read, allowed).agg(F.count(F.lit(1)).alias("count"))


def after(records: DataFrame, order, cursor: tuple) -> F.Column:
    """Rows strictly after a cursor of order values and an id, in the order of :func:`order_keys`.

    Ascending fields have nulls first, descending ones last.
    """
    find = record_fields(records)
    fields = [(*find(n), d) for n, d in order if find(n)]
    columns = [(c, d) for c, _, d in fields] + [(F.col("id"), False)]
    out, same = F.lit(False), F.lit(True)
    for (c, down), v in zip(columns, cursor):
        if v is None:
            later = F.lit(False) if down else c.isNotNull()
            equal = c.isNull()
        else:
            later = (c < F.lit(v)) | c.isNull() if down else c > F.lit(v)
            equal = c == F.lit(v)
        out = out | (same & F.coalesce(later, F.lit(False)))
        same = same & F.coalesce(equal, F.lit(False))
    return out


# ---------------------------------------------------------------- aggregation


@dataclass
class Aggregation:
    """kind: count, cardinality, terms, date_histogram, sum, average, minimum, maximum, filter, nested, reverse_nested."""

    kind: str
    field: str | None = None
    limit: int = 10
    step: str = "day"
    offset_minutes: int = 0
    fill: bool = False
    predicate: object = None
    inner: "Aggregation | None" = None


NUMERIC = {"sum": F.sum, "average": F.avg, "minimum": F.min, "maximum": F.max}


def check(plan: Aggregation, depth: int = 1) -> None:
    if depth > 16:
        raise InvalidRequest("an aggregation is at most 16 deep")
    if plan.kind in ("cardinality", "terms", "date_histogram", "nested", *NUMERIC) and not plan.field:
        raise InvalidRequest(f"{plan.kind} names a field")
    if plan.kind == "terms" and not 1 <= plan.limit <= MAX_TERMS:
        raise InvalidRequest(f"terms limit is 1 to {MAX_TERMS}")
    if plan.kind == "date_histogram" and (plan.step not in ("hour", "day") or abs(plan.offset_minutes) > 1080):
        raise InvalidRequest("steps are hour or day, offsets at most 1080 minutes")
    if plan.kind in ("filter", "nested", "reverse_nested"):
        if plan.inner is None:
            raise InvalidRequest(f"{plan.kind} holds an aggregation")
        check(plan.inner, depth + 1)
    if plan.kind == "filter":
        validate(plan.predicate)


def aggregate(subjects: DataFrame, plan: Aggregation, roots: DataFrame | None = None) -> DataFrame:
    """One aggregation tree.  Subjects have ``root`` (the record's id) and ``value`` (a struct, or a list's item).

    count, cardinality and numbers give one row ``value``; terms and date_histogram rows ``key, count``.
    """
    check(plan)
    roots = subjects if roots is None else roots
    dtype = subjects.schema["value"].dataType
    find = (lambda path: (F.col("value"), dtype)) if plan.field == "$value" else Fields(dtype, F.col("value"))
    if plan.kind == "count":
        return subjects.agg(F.count(F.lit(1)).alias("value"))
    if plan.kind == "filter":
        return aggregate(subjects.where(to_column(plan.predicate, Fields(dtype, F.col("value")))), plan.inner, roots)
    if plan.kind == "reverse_nested":
        back = roots.join(subjects.select("root").distinct(), "root", "left_semi")
        return aggregate(back, plan.inner, roots)
    found = find(plan.field)
    if plan.kind == "nested":
        if not found:
            return aggregate(subjects.where(F.lit(False)), plan.inner, roots)
        items = F.explode(found[0]) if kind_of(found[1]) == "list" else found[0]
        return aggregate(subjects.select("root", items.alias("value")).where("value is not null"), plan.inner, roots)
    if not found:
        found = (F.lit(None).cast("string"), subjects.sparkSession.createDataFrame([], "x string").schema["x"].dataType)
    column, kind = found[0], kind_of(found[1])
    if plan.kind in NUMERIC:
        number = column.cast("double") if kind in ("integer", "float") else F.lit(None).cast("double")
        finite = F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)
        return subjects.agg(NUMERIC[plan.kind](finite).alias("value"))
    if plan.kind == "cardinality":
        values = subjects.select((F.explode(column) if kind == "list" else column).alias("v"))
        return values.agg(F.count_distinct("v").alias("value"))
    if plan.kind == "terms":
        values = subjects.select((F.explode(F.array_distinct(column)) if kind == "list" else column).alias("key")).where("key is not null")
        counts = values.groupBy("key").agg(F.count(F.lit(1)).alias("count"))
        # ties by the key's JSON text
        return counts.orderBy(F.desc("count"), F.to_json(F.struct("key")).asc()).limit(plan.limit)
    step, shift = {"hour": 3600, "day": 86400}[plan.step], plan.offset_minutes * 60
    # text that isn't a time, and other types, are in no bucket
    instant = column.cast("timestamp") if kind == "time" else F.try_to_timestamp(column) if kind == "string" else F.lit(None).cast("timestamp")
    seconds = F.unix_seconds(instant)
    buckets = (
        subjects.select((F.floor((seconds + shift) / step) * step - shift).alias("key")).where("key is not null")
        .groupBy("key").agg(F.count(F.lit(1)).alias("count"))
    )
    if plan.fill:
        ends = buckets.agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a is not null")
        every = ends.select(F.explode(F.sequence("a", "z", F.lit(step).cast("long"))).alias("key"))
        buckets = every.join(buckets, "key", "left").select("key", F.coalesce("count", F.lit(0)).alias("count"))
    return buckets.orderBy("key")


def aggregate_records(records: DataFrame, read: Read, plan: Aggregation, allowed: F.Column | None = None, candidate_limit: int | None = None) -> DataFrame:
    """An aggregation over the records of a request; more candidates than the limit is an error, never a part."""
    chosen = selected(records, read, allowed)
    if candidate_limit is not None:
        if not 1 <= candidate_limit <= MAX_CANDIDATES:
            raise InvalidRequest(f"candidate_limit is 1 to {MAX_CANDIDATES}")
        if chosen.limit(candidate_limit + 1).count() > candidate_limit:
            raise BudgetExceeded(f"more than {candidate_limit} candidates")
    return aggregate(chosen.select(F.col("id").alias("root"), F.col("body").alias("value")), plan)


class ResultCache:
    """Collected buckets by plan and access fingerprint; cleared whenever data changes."""

    def __init__(self):
        self.kept: dict = {}

    def get(self, key, make):
        if key not in self.kept:
            self.kept[key] = make().collect()
        return self.kept[key]

    def clear(self):
        self.kept.clear()


def fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """(rows, digest): SHA-256 over the number of rows and the sums of four 60-bit parts of each row's SHA-256.

    Sums commute, so tasks add up their rows before anything is shuffled and the order and partitioning don't matter; equal rows count.
    """
    one = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256).alias("h")
    part = lambda i: F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(28,0)")
    sums = rows.select(one).agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(part(i)), F.lit(0)).cast("string").alias(f"s{i}") for i in range(4)])
    return sums.select("rows", F.sha2(F.concat_ws(",", F.col("rows").cast("string"), "s0", "s1", "s2", "s3"), 256).alias("digest"))


DIGESTS = {
    "nodes": ("id", "revision"), "relationships": ("id", "src", "dst", "rel_type"), "properties": ("id", "key", "value"),
    "labels": ("id", "label"), "statuses": ("id", "status"),
}


def graph_digests(nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """(part, rows, digest) of a stored graph: nodes, relationships, properties, labels and statuses, each on its own."""
    parts = {
        "nodes": nodes.select("id", F.col("version").alias("revision")), "relationships": rels.select("id", "src", "dst", "rel_type"),
        "properties": nodes.select("id", F.explode("props").alias("key", "value")), "labels": nodes.select("id", F.explode("labels").alias("label")),
        "statuses": nodes.select("id", "status").unionByName(rels.select("id", "status")),
    }
    out = None
    for name, rows in parts.items():
        one = fingerprint(rows, *DIGESTS[name]).select(F.lit(name).alias("part"), "rows", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def listed_with_total(records: DataFrame, read: Read, allowed: F.Column | None = None) -> tuple[DataFrame, DataFrame]:
    """A list and the number of all records that match, before the limit."""
    return listed(records, read, allowed), counted(records, read, allowed).withColumnRenamed("count", "total")


def percentiles(rows: DataFrame, column: str, bounds: list[float], wanted=(50, 95, 99)) -> DataFrame:
    """Percentiles from a histogram of fixed upper bounds: the bound of the bucket that reaches each share."""
    label = F.lit(float(bounds[-1]))
    for b in reversed(bounds):
        label = F.when(F.col(column) <= b, F.lit(float(b))).otherwise(label)
    counts = rows.groupBy(label.alias("bound")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("bound")
    run = counts.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy()))
    return run.agg(*[F.min(F.when(F.col("upto") * 100 >= F.col("all") * p, F.col("bound"))).alias(f"p{p}") for p in wanted])
