"""Analytic Parquet tables seen as a property graph.

Ids are ``label--key``.  Every label and relationship type is a lazily read DataFrame with plain
typed columns, so filters and column lists reach the scans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: label: (table, key column, {property: column})
NODES = {
    "Region": ("region", "r_regionkey", {"name": "r_name", "regionkey": "r_regionkey"}),
    "Nation": ("nation", "n_nationkey", {"name": "n_name", "nationkey": "n_nationkey", "regionkey": "n_regionkey"}),
    "Customer": ("customer", "c_custkey", {"name": "c_name", "custkey": "c_custkey", "nationkey": "c_nationkey", "acctbal": "c_acctbal", "mktsegment": "c_mktsegment"}),
    "Supplier": ("supplier", "s_suppkey", {"name": "s_name", "suppkey": "s_suppkey", "nationkey": "s_nationkey", "acctbal": "s_acctbal"}),
    "Part": ("part", "p_partkey", {"name": "p_name", "partkey": "p_partkey", "brand": "p_brand", "type": "p_type", "size": "p_size", "retailprice": "p_retailprice"}),
    "Order": ("orders", "o_orderkey", {"orderkey": "o_orderkey", "custkey": "o_custkey", "orderstatus": "o_orderstatus", "totalprice": "o_totalprice", "orderdate": "o_orderdate", "orderpriority": "o_orderpriority"}),
    "Event": ("events", "event_id", {"event_id": "event_id", "user_id": "user_id", "event_type": "event_type", "value": "value", "ts": "ts", "props": "props"}),
    "Document": ("documents", "doc_id", {"doc_id": "doc_id", "text": "text", "lang": "lang", "source": "source", "n_chars": "n_chars"}),
}
LINE = ("linenumber", "quantity", "extendedprice", "discount", "tax", "returnflag", "linestatus", "shipdate")
#: type: (table, source label, source column, target label, target column, {property: column})
RELS = {
    "IN_REGION": ("nation", "Nation", "n_nationkey", "Region", "n_regionkey", {}),
    "LIVES_IN": ("customer", "Customer", "c_custkey", "Nation", "c_nationkey", {}),
    "BASED_IN": ("supplier", "Supplier", "s_suppkey", "Nation", "s_nationkey", {}),
    "PLACED": ("orders", "Customer", "o_custkey", "Order", "o_orderkey", {}),
    "CONTAINS": ("lineitem", "Order", "l_orderkey", "Part", "l_partkey", {p: f"l_{p}" for p in LINE} | {"suppkey": "l_suppkey"}),
    "PERFORMED": ("events", "User", "user_id", "Event", "event_id", {}),
}


class PropertyGraph:
    """Nodes by label and relationships by type.

    A node frame has ``id``, a relationship frame ``id, src, dst``; other columns are properties, except
    the native ``status``, ``confidence`` and ``evidence_refs`` where a frame has them.
    """

    def __init__(self, spark: SparkSession, nodes: dict[str, Callable[[], DataFrame]], rels: dict[str, Callable[[], DataFrame]], keyed: bool = False):
        self.spark, self._nodes, self._rels, self._keyed = spark, nodes, rels, keyed

    @property
    def labels(self) -> list[str]:
        return sorted(self._nodes)

    @property
    def types(self) -> list[str]:
        return sorted(self._rels)

    def nodes(self, label: str | None = None) -> DataFrame:
        if label is not None:
            if label not in self._nodes:
                return self.spark.createDataFrame([], "id string")
            return self._nodes[label]()
        out = None
        for name in self.labels:
            part = self._nodes[name]()
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def rels(self, kind: str | None = None) -> DataFrame:
        if kind is not None:
            if kind not in self._rels:
                return self.spark.createDataFrame([], "id string, src string, dst string")
            return self._rels[kind]()
        return self.edges(self.types)

    def node(self, record: str) -> DataFrame:
        """The node of an id.  Ids of tables tell label and key, so the key's own column is filtered and the scan skips the rest."""
        name, _, key = record.partition("--")
        label = next((x for x in self.labels if x.lower() == name), None)
        if label is None or (self._keyed and not _is_key(key)):
            return self.spark.createDataFrame([], "id string")
        return self._nodes[label](int(key)) if self._keyed else self._nodes[label]().where(F.col("id") == record)

    def incident(self, kind: str, source: str | None = None, target: str | None = None) -> DataFrame:
        """Relationships of a type out of one node, into one, or from one to another; filtered by their keys."""
        ends = {"src": source, "dst": target}
        if not self._keyed:
            rows = self.rels(kind)
            for c, record in ends.items():
                rows = rows if record is None else rows.where(F.col(c) == record)
            return rows
        keys = []
        for c, label in zip(ends, RELS[kind][1:4:2]):
            name, _, key = (ends[c] or "").partition("--")
            if ends[c] is not None and (name != label.lower() or not _is_key(key)):
                return self.rels(kind).limit(0)
            keys.append(None if ends[c] is None else int(key))
        return self._rels[kind](*keys)

    def edges(self, kinds: list[str]) -> DataFrame:
        """Adjacency without payload: id, src, dst, rel_type."""
        out = None
        for k in kinds:
            part = self._rels[k]().select("id", "src", "dst", F.lit(k).alias("rel_type"))
            out = part if out is None else out.unionByName(part)
        return out


def node_id(label: str, column) -> F.Column:
    return F.concat(F.lit(label.lower() + "--"), F.col(column).cast("string"))


def _is_key(text: str) -> bool:
    return text.lstrip("-").isdigit() and str(int(text)) == text


def load(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The graph over the Parquet tables of a folder."""

    def read(name):
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def node(label):
        name, key, props = NODES[label]

        def make(wanted: int | None = None):
            rows = read(name) if wanted is None else read(name).where(F.col(key) == wanted)
            return rows.select(node_id(label, key).alias("id"), *[F.col(c).alias(p) for p, c in props.items()])

        return make

    def rel(kind):
        name, a, ac, b, bc, props = RELS[kind]

        def make(source: int | None = None, target: int | None = None):
            rows = read(name)
            for c, wanted in ((ac, source), (bc, target)):
                rows = rows if wanted is None else rows.where(F.col(c) == wanted)
            own = [F.lit(kind.lower()), F.col(ac).cast("string"), F.col(bc).cast("string")]
            if "linenumber" in props:
                own.append(F.col(props["linenumber"]).cast("string"))
            return rows.select(
                F.concat_ws("--", *own).alias("id"), node_id(a, ac).alias("src"), node_id(b, bc).alias("dst"),
                *[F.col(c).alias(p) for p, c in props.items()],
            )

        return make

    nodes = {label: node(label) for label in NODES}
    nodes["User"] = lambda wanted=None: (
        (read("events") if wanted is None else read("events").where(F.col("user_id") == wanted))
        .select(node_id("User", "user_id").alias("id"), F.col("user_id")).distinct()
    )
    rels = {kind: rel(kind) for kind in RELS}
    rels["SUPPLIED_BY"] = lambda: (
        read("lineitem").select("l_partkey", "l_suppkey").distinct().select(
            F.concat_ws("--", F.lit("supplied_by"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("id"),
            node_id("Part", "l_partkey").alias("src"), node_id("Supplier", "l_suppkey").alias("dst"),
        )
    )
    return PropertyGraph(spark, nodes, rels, keyed=True)
