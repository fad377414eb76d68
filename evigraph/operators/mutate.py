"""Changes: created, merged, updated and deleted records as appended versions.

A change is planned as DataFrames of new versions and committed once; reads of the same statement never see it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import BudgetExceeded, Conflict, InvalidRequest
from ..model import WRITABLE
from ..plans import cypher as C
from .traverse import cut

RESERVED = ("status", "confidence", "evidence_refs")
#: Changes one statement may make where it is bounded, as requests are; jobs over whole tables run unbounded.
MAX_MUTATIONS = 5_000


def encode(value) -> str:
    """A literal as the JSON text that stored properties hold."""
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def json_test(column, op: str, value) -> F.Column:
    """A comparison with stored JSON text: of one type, or of numbers."""
    text = encode(value)
    if isinstance(value, bool) or op in ("=", "<>") and isinstance(value, str):
        if isinstance(value, bool) and op not in ("=", "<>"):
            return F.lit(False)
        alike = column.startswith('"') if isinstance(value, str) else column.isin("true", "false")
        return F.coalesce(alike & ((column == text) if op == "=" else (column != text)), F.lit(False))
    if isinstance(value, (int, float)):
        number = F.when(column.rlike(r"^-?\d"), column.try_cast("double"))
        left, right = number, F.lit(float(value))
    elif isinstance(value, str):
        left, right = F.when(column.startswith('"'), F.from_json(F.concat(F.lit('{"v":'), column, F.lit("}")), "v string")["v"]), F.lit(value)
    else:
        return F.lit(False)
    out = {"=": left == right, "<>": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]
    return F.coalesce(out, F.lit(False))


def _prop(var: str, name: str, native: bool = True) -> F.Column:
    row = F.col(var)
    own = row["props"][name]
    if native and name == "id":
        return F.coalesce(own, F.to_json(F.struct(row["id"].alias("v"))).substr(F.lit(6), F.lit(1 << 20)).substr(F.lit(1), F.length(F.to_json(F.struct(row["id"].alias("v")))) - 6))
    if native and name == "status":
        return F.concat(F.lit('"'), F.coalesce(row["status"], F.lit("candidate")), F.lit('"'))
    if native and name == "confidence":
        return row["confidence"].cast("string")
    return own


def node_rows(nodes: DataFrame, pattern: C.NodePattern, params: dict) -> DataFrame:
    """Nodes of a pattern as one struct column named by its variable."""
    rows = nodes
    if pattern.label:
        rows = rows.where(F.array_contains("labels", pattern.label))
    for key, value in pattern.props.items():
        value = C.bind(value, params)
        own = F.col("props")[key]
        rows = rows.where(own == "null" if value is None else json_test(own, "=", value))
    return rows.select(F.struct(*nodes.columns).alias(pattern.var))


def condition(tree, params: dict) -> F.Column:
    if isinstance(tree, C.Bool):
        out = None
        for item in tree.items:
            c = condition(item, params)
            out = c if out is None else (out & c if tree.op == "AND" else out | c)
        return out
    column = _prop(tree.ref.var, tree.ref.prop)
    if tree.op == "NULL":
        return column.isNull()
    if tree.op == "NOT_NULL":
        return column.isNotNull()
    value = C.bind(tree.value, params)
    if tree.op in ("IN", "NOT_IN"):
        inside = F.lit(False)
        for v in value:
            listed = F.coalesce(F.array_contains(F.from_json(F.when(column.startswith("["), column), "array<string>"), str(v)), F.lit(False)) if isinstance(v, str) else F.lit(False)
            inside = inside | json_test(column, "=", v) | listed
        return inside if tree.op == "IN" else ~inside
    return json_test(column, tree.op, value)


def matched(store, query: C.Query, params: dict) -> DataFrame:
    nodes, frame = store.nodes(), None
    for p in query.patterns:
        rows = node_rows(nodes, p.node, params)
        if p.target is not None:
            var = p.rel_var or "_rel"
            rels = store.rels()
            if p.rel_type:
                rels = rels.where(F.col("rel_type") == p.rel_type)
            rels = rels.select(F.struct(*rels.columns).alias(var))
            ends = node_rows(nodes, p.target, params)
            rows = rows.join(rels, F.col(p.node.var)["id"] == F.col(var)["src"]).join(ends, F.col(var)["dst"] == F.col(p.target.var)["id"])
        frame = rows if frame is None else frame.crossJoin(rows)
    if frame is not None and query.where is not None:
        frame = frame.where(condition(query.where, params))
    return frame


def _new_node(spark, ids: DataFrame, pattern: C.NodePattern, params: dict, now: str) -> DataFrame:
    """Version 1 of a node for each row of ``ids(id)``."""
    props = {k: encode(C.bind(v, params)) for k, v in pattern.props.items()}
    made = F.create_map(*[F.lit(x) for kv in props.items() for x in kv]) if props else F.create_map().cast("map<string,string>")
    return ids.select(
        "id", F.lit(1).cast("long").alias("version"),
        (F.array(F.lit(pattern.label)) if pattern.label else F.array()).cast("array<string>").alias("labels"),
        made.cast("map<string,string>").alias("props"), F.lit("candidate").alias("status"), F.lit(None).cast("double").alias("confidence"),
        F.array().cast("array<string>").alias("evidence_refs"), F.lit(now).alias("recorded_at"),
    )


def _highest(store, table: str, kind: str) -> int:
    top = store.versions(table).where(F.col("id").rlike(f"^{kind}--\\d+$")).agg(F.max(F.substring_index("id", "--", -1).cast("long"))).first()[0]
    return top or 0


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with ``n``, their number from 1 in an order: ranges of it are sorted apart, each goes on from those before it.

    The sorted ranges are kept in the shared folder, so every use of the numbers sees the same ones.
    """
    ranged = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.select(*rows.columns, F.shiftright("_at", 33).alias("_range"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("size"))
    starts = sizes.select("_range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    return ranged.join(F.broadcast(starts), "_range").select(*rows.columns, (F.col("start") + F.col("_at") + 1).alias("n"))


def _new_rel(rows: DataFrame, start: int, src, dst, kind: str, now: str) -> DataFrame:
    return numbered(rows.select(src.alias("src"), dst.alias("dst")), "src", "dst").select(
        F.concat(F.lit("rel--"), (F.col("n") + start).cast("string")).alias("id"), F.lit(1).cast("long").alias("version"), "src", "dst",
        F.lit(kind).alias("rel_type"), F.create_map().cast("map<string,string>").alias("props"), F.lit("candidate").alias("status"),
        F.lit(None).cast("double").alias("confidence"), F.array().cast("array<string>").alias("evidence_refs"), F.lit(now).alias("recorded_at"),
    )


def _without(props: F.Column, key: str) -> F.Column:
    return F.map_filter(props, lambda k, v: k != F.lit(key))


def _set_version(var: str, changes: list, params: dict, now: str) -> F.Column:
    """The struct of a record's next version with assignments applied; all are validated first."""
    row = F.col(var)
    props, fields = row["props"], {}
    for ref, value in changes:
        if ref.prop in RESERVED:
            if ref.prop == "evidence_refs":
                if not isinstance(value, list):
                    raise InvalidRequest("evidence_refs takes a list")
                parts = [F.col(v.var)["id"] if isinstance(v, C.PropRef) else F.lit(C.bind(v, params)) for v in value]
                fields["evidence_refs"] = F.array(*parts).cast("array<string>")
                continue
            value = C.bind(value, params)
            if ref.prop == "status":
                clean = value.strip().lower() if isinstance(value, str) else None
                if clean not in WRITABLE:
                    raise InvalidRequest(f"status can't be {value!r}")
                fields["status"] = F.lit(clean)
            else:
                if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value <= 1:
                    raise InvalidRequest("confidence is between 0 and 1")
                fields["confidence"] = F.lit(float(value))
        else:
            kept = _without(props, ref.prop)
            props = F.map_concat(kept, F.create_map(F.lit(ref.prop), F.lit(encode(C.bind(value, params)))))
    return row, props, fields, now


def run(store, text: str, params: dict | None = None, now: str = "1970-01-01T00:00:00Z", bounded: bool = True) -> DataFrame:
    """A changing statement: one commit, then the returned items, or a row of counters without RETURN.

    A bounded statement (a request) is refused whole beyond ``MAX_MUTATIONS``; an unbounded one changes all that it matches.
    """
    params = params or {}
    q = C.parse(text)
    if not q.mutates:
        raise InvalidRequest("the statement changes nothing")
    spark = store.spark
    expected = store.manifest()["revision"]
    rows = matched(store, q, params)
    if rows is not None:
        rows = rows.cache()
    n = rows.count() if rows is not None else 1
    made = dict.fromkeys(("nodes_created", "rels_created", "nodes_merged", "rels_merged", "properties_set", "properties_removed", "records_deleted"), 0)
    planned = n * (sum(2 if p.target else 1 for p in [*q.create, *q.merge]) + len(q.set) + len(q.remove) + len(q.delete))
    if bounded and planned > MAX_MUTATIONS:
        raise BudgetExceeded(f"up to {planned} changes; {MAX_MUTATIONS} are allowed")
    nodes, rels, kept = [], [], [] if rows is None or q.items else [rows]
    next_node, next_rel = _highest(store, "nodes", "node"), _highest(store, "rels", "rel")
    for p in q.create:
        if p.target is None:
            next_node += 1
            ids = spark.createDataFrame([(f"node--{next_node}",)], "id string")
            nodes.append(_new_node(spark, ids, p.node, params, now))
            made["nodes_created"] += 1
        elif n:
            pairs = numbered(rows.select(F.col(p.node.var)["id"].alias("src")), "src").select("src", F.concat(F.lit("node--"), (F.col("n") + next_node).cast("string")).alias("dst"))
            nodes.append(_new_node(spark, pairs.select(F.col("dst").alias("id")), p.target, params, now))
            rels.append(_new_rel(pairs, next_rel, F.col("src"), F.col("dst"), p.rel_type, now))
            next_node, next_rel = next_node + n, next_rel + n
            made["nodes_created"] += n
            made["rels_created"] += n
    for p in q.merge:
        goal = p.target or p.node
        found = node_rows(store.nodes(), goal, params).select(F.min(F.col(goal.var)["id"])).first()[0]
        if found is None:
            next_node += 1
            found = f"node--{next_node}"
            nodes.append(_new_node(spark, spark.createDataFrame([(found,)], "id string"), goal, params, now))
            made["nodes_created"] += 1
        else:
            made["nodes_merged"] += 1
        if p.target is not None and n:
            pairs = rows.select(F.col(p.node.var)["id"].alias("src"), F.lit(found).alias("dst")).distinct()
            there = store.rels().where(F.col("rel_type") == p.rel_type).select("src", "dst")
            fresh = pairs.join(there, ["src", "dst"], "left_anti").cache()
            kept.append(fresh)
            k = fresh.count()
            made["rels_merged"] += pairs.count() - k
            made["rels_created"] += k
            if k:
                rels.append(_new_rel(fresh, next_rel, F.col("src"), F.col("dst"), p.rel_type, now))
                next_rel += k
    touched: dict[str, list] = {}
    for ref, value in q.set:
        touched.setdefault(ref.var, []).append((ref, value))
    rel_vars = {p.rel_var for p in q.patterns if p.rel_var}
    for ref in q.remove:
        if ref.var not in rel_vars:  # relationship properties aren't removed
            touched.setdefault(ref.var, []).append((ref, None))
    for var in {*touched, *q.delete}:
        row, props, fields, _ = _set_version(var, touched.get(var, []), params, now)
        gone = var in q.delete
        columns = (rels if var in rel_vars else nodes)
        names = ["id", "src", "dst", "rel_type"] if var in rel_vars else ["id", "labels"]
        status = F.lit("tombstoned") if gone else fields.get("status", row["status"])
        new = rows.select(
            *[row[c].alias(c) for c in names], (row["version"] + 1).alias("version"), props.alias("props"), status.alias("status"),
            fields.get("confidence", row["confidence"]).alias("confidence"), fields.get("evidence_refs", row["evidence_refs"]).alias("evidence_refs"),
            F.lit(now).alias("recorded_at"),
        ).dropDuplicates(["id"])
        if any(r.prop == "status" and C.bind(v, params) == "exportable" for r, v in touched.get(var, []) if v is not None):
            if new.where("confidence is null or size(evidence_refs) = 0").limit(1).count():
                raise InvalidRequest("an exportable record has a confidence and evidence")
        columns.append(new)
        k = new.count()
        made["records_deleted"] += k if gone else 0
        made["properties_set"] += k * sum(v is not None for _, v in touched.get(var, []))
        made["properties_removed"] += k * sum(v is None for _, v in touched.get(var, []))

    def union(parts):
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    frames = {name: union(parts) for name, parts in (("nodes", nodes), ("rels", rels)) if parts}
    if frames:
        store.commit(expected, **frames)
    for frame in kept:
        frame.unpersist()
    if q.items and rows is not None:
        return rows.select(*[(F.col(i.ref)["id"] if isinstance(i.ref, str) else _prop(i.ref.var, i.ref.prop)).alias(i.name) for i in q.items])
    return spark.createDataFrame([tuple(made.values())], ", ".join(f"{k} long" for k in made))


def upsert(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """(id, outcome, version): created, replaced or unchanged for each incoming record; both have id and digest, current version."""
    a, b = incoming.alias("i"), current.alias("c")
    outcome = F.when(F.col("c.digest").isNull(), "created").when(F.col("c.digest") == F.col("i.digest"), "unchanged").otherwise("replaced")
    return a.join(b, F.col("i.id") == F.col("c.id"), "left").select(
        F.col("i.id").alias("id"), outcome.alias("outcome"),
        (F.coalesce(F.col("c.version"), F.lit(0)) + F.when(outcome == "unchanged", 0).otherwise(1)).cast("long").alias("version"),
    )


def import_records(store, incoming: DataFrame, workspace: str, key: str, now: str = "1970-01-01T00:00:00Z") -> dict:
    """Typed import of ``incoming(id, labels, props)``, written to the store in one commit with its receipt.

    Records not there or deleted are created, changed ones replaced, equal ones left alone.  A repeated request of one key
    is answered from its receipt; the same key with other records is a conflict.
    """
    from .records import fingerprint

    asked = fingerprint(incoming.select("id", F.to_json(F.struct("labels", F.array_sort(F.map_entries("props")))).alias("content")), "id", "content").first()["digest"]
    kept = store.versions("receipts").where((F.col("workspace") == workspace) & (F.col("key") == key)).first()
    if kept is not None:
        if kept["request"] != asked:
            raise Conflict("the key was used for another request")
        return json.loads(kept["response"])
    revision = store.manifest()["revision"]
    before = live_or_version(store.newest("nodes"))

    def digest(*c):
        return F.xxhash64(F.array_sort(F.map_entries(c[1])), F.array_sort(c[0]))

    given = incoming.withColumn("digest", digest("labels", "props"))
    there = before.select("id", F.when(F.col("status").isNotNull(), digest("labels", "props")).alias("digest"), "version")
    outcomes = upsert(there, given).where("outcome <> 'unchanged'")
    new = given.join(outcomes, "id").select(
        "id", "version", "labels", "props", F.lit("candidate").alias("status"), F.lit(None).cast("double").alias("confidence"),
        F.array().cast("array<string>").alias("evidence_refs"), F.lit(now).alias("recorded_at"), "outcome",
    ).cache()
    counts = {r["outcome"]: r["count"] for r in new.groupBy("outcome").count().collect()}  # two rows
    response = {"created": counts.get("created", 0), "replaced": counts.get("replaced", 0), "received": given.count()}
    receipt = store.spark.createDataFrame([(workspace, key, asked, json.dumps(response))], "workspace string, key string, request string, response string")
    store.commit(revision, nodes=new.drop("outcome"), receipts=receipt)
    new.unpersist()
    return response


def live_or_version(newest: DataFrame) -> DataFrame:
    """Last versions in which a deleted record keeps its id and version only."""
    gone = F.col("status") == "tombstoned"
    kept = ("id", "version")
    return newest.withColumn("status", F.coalesce("status", F.lit("candidate"))).select(*[c if c in kept else F.when(~gone, F.col(c)).alias(c) for c in newest.columns])


def write_batch(store, changes: DataFrame, atomic: bool = True, now: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Typed writes ``changes(id, action, expected, labels, props)`` against current versions; (id, outcome).

    create needs no record, update and delete one of the expected version; one conflict stops an atomic batch.
    A deleted record can be created again: its versions go on, nothing else of it stays.
    """
    manifest = store.manifest()
    current = live_or_version(store.newest("nodes")).select("id", F.col("version").alias("at"), F.col("labels").alias("old_labels"), F.col("props").alias("old"), "confidence", "evidence_refs", "status")
    there = F.col("status").isNotNull()
    ok = F.when(F.col("action") == "create", ~there).otherwise(there & (F.col("expected").isNull() | (F.col("expected") == F.col("at"))))
    rows = changes.join(current, "id", "left").withColumn("ok", ok).cache()
    if atomic and rows.where("not ok").limit(1).count():
        raise Conflict("a record isn't at its expected version")
    new = rows.where("ok").select(
        "id", (F.coalesce("at", F.lit(0)) + 1).cast("long").alias("version"), F.coalesce("labels", "old_labels").alias("labels"),
        F.coalesce("props", "old").alias("props"), F.when(F.col("action") == "delete", "tombstoned").otherwise(F.coalesce("status", F.lit("candidate"))).alias("status"),
        "confidence", F.coalesce("evidence_refs", F.array().cast("array<string>")).alias("evidence_refs"), F.lit(now).alias("recorded_at"),
    )
    store.commit(manifest["revision"], nodes=new)
    return rows.select("id", F.when(F.col("ok"), F.concat(F.col("action"), F.lit("d"))).otherwise("conflict").alias("outcome"))


# ---------------------------------------------------------------- merge and reconciliation


def redirect(rels: DataFrame, moved: DataFrame) -> DataFrame:
    """Edges after records are merged: ``moved(from_id, to_id)``; (id, src, dst, rel_type, outcome).

    Outcomes: kept, redirected, duplicate (of an edge with a lesser id between the same ends), loop.
    """
    table = moved.select("from_id", "to_id")
    out = rels.select("id", "src", "dst", "rel_type")
    for c in ("src", "dst"):
        out = out.join(table.select(F.col("from_id").alias(c), F.col("to_id").alias(f"{c}_to")), c, "left")
    ends = out.select("id", "rel_type", F.coalesce("src_to", "src").alias("src"), F.coalesce("dst_to", "dst").alias("dst"), (F.col("src_to").isNotNull() | F.col("dst_to").isNotNull()).alias("moved"))
    # the least id of each (src, type, dst) by aggregation: a supernode's edges are reduced before they meet
    first = ends.groupBy("src", "rel_type", "dst").agg(F.min("id").alias("keep"), F.max("moved").alias("any_moved"))
    outcome = (
        F.when(F.col("moved") & (F.col("src") == F.col("dst")), "loop").when(F.col("any_moved") & (F.col("id") != F.col("keep")), "duplicate")
        .when(F.col("moved"), "redirected").otherwise("kept")
    )
    return ends.join(first, ["src", "rel_type", "dst"]).select("id", "src", "dst", "rel_type", outcome.alias("outcome"))


def diff(reference: DataFrame, shadow: DataFrame, key: str = "id") -> DataFrame:
    """(id, finding): records that are missing, unexpected or differ in some column."""
    columns = [c for c in reference.columns if c != key]
    a = reference.select(key, F.struct(*columns).alias("a"))
    b = shadow.select(F.col(key).alias("other"), F.struct(*columns).alias("b"))
    finding = F.when(F.col("other").isNull(), "missing").when(F.col(key).isNull(), "unexpected").otherwise("different")
    return (
        a.join(b, F.col(key) == F.col("other"), "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
        .select(F.coalesce(key, "other").alias(key), finding.alias("finding"))
    )
