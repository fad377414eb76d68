"""Near-duplicate vectors by a pivot-permutation index (operator 6).

Pivots are a bounded sample of the vectors (``pivots_for``: 256, more with the square root of
the number of different vectors, at most 4096), thinned so that no two lie within twice the
threshold's angle: a tight group has one pivot however large it is, and its members do not
choose among pivots of their own by chance.  Every vector is described by its permutation: its
``TOP`` nearest pivots, nearest first.  The inverted list of a pivot, of one label and one length,
holds the vectors that have it among their ``LISTED`` nearest.  Two vectors of a list are
candidates when their permutations share ``SHARED`` pivots or more, and are compared in the list
of the least listed pivot that both have, so once.

Equal vectors of a label are one node with a count, so copies cost nothing.  Nodes are grouped by the
values themselves; hashes only join them back to their rows, after a count has shown that no two
nodes have the same.  Lists are runs of sorted rows; shared pivots are counted by products of
indicator blocks, candidates compared in double precision.  A list yields a sum for each
node and links that span its groups, never its pairs.  A list of more than ``LIST`` rows or
``LIST_BYTES`` of vectors is cut into blocks, and each pair of blocks is a list of its own, in another task if need be.

The index holds every vector; only the choice of candidates is approximate (recall against
brute force is measured in the tests at two sizes).  Links are never below the threshold.

Null labels, null or empty vectors, zero vectors and ones with null or non-finite components link
with nothing.  Vectors of different lengths never link.  Rows that repeat an id are vectors of their
own.  Pivots equally near count by their number.  Other columns of ``rows`` are not read, so their
names cannot clash; an empty table gives no rows; a vector of any length is compared whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_pairs, cut, map_arrow
from .components import connected_components

TOP, LISTED, SHARED = 8, 3, 3
LIST, LIST_BYTES = 8192, 4 << 20  # rows of a list that stays whole, and of their vectors in double precision
DRAWS = 4  # vectors drawn for a pivot wanted
WIDTH = 256  # columns of an indicator block


def pivots_for(n: int) -> int:
    return int(min(4096, max(256, math.sqrt(n))))


def spread_pivots(vectors: list[list[float]], want: int, threshold: float) -> list[list[float]]:
    """The first ``want`` vectors of which no two of a length lie within twice the threshold's angle."""
    apart = math.cos(min(math.pi, 2 * math.acos(max(-1.0, min(1.0, threshold)))))
    chosen: list[list[float]] = []
    kept: dict[int, tuple[np.ndarray, int]] = {}
    for v in vectors:
        if len(chosen) == want:
            break
        unit = _unit(np.array([v], np.float64))[0]
        table, n = kept.get(len(v), (np.empty((64, len(v))), 0))
        if n and (table[:n] @ unit).max() >= apart:
            continue
        if n == len(table):
            table = np.concatenate([table, np.empty_like(table)])
        table[n] = unit
        kept[len(v)] = (table, n + 1)
        chosen.append(list(v))
    return chosen


def usable(rows: DataFrame):
    """Is the vector one that can link?"""
    return F.expr(
        "label is not null and embedding is not null and size(embedding) > 0 "
        "and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) "
        "and exists(embedding, x -> x <> 0)"
    )


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1)[:, None]  # squares of very large or small numbers stay finite
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def permutations(vectors: np.ndarray, numbers: np.ndarray, units: np.ndarray) -> np.ndarray:
    """The numbers of each vector's ``TOP`` nearest pivots, nearest first, the lesser number first of equals; -1 where there are fewer."""
    out = np.full((len(vectors), TOP), -1, np.int16)
    k = min(TOP, len(numbers))
    if k:
        close = -(vectors @ units.T)
        out[:, :k] = numbers[np.argsort(close, axis=1, kind="stable")[:, :k]]
    return out


def _described(nodes: DataFrame, pivots: list[list[float]], wide: bool) -> DataFrame:
    """(g, c, label, dim, perm, listed, vector): permutations as bytes of int16, vectors as bytes."""
    kind = np.float64 if wide else np.float32
    by_size: dict[int, list] = {}
    for i, p in enumerate(pivots):
        by_size.setdefault(len(p), []).append((i, p))
    shared = nodes.sparkSession.sparkContext.broadcast(
        {n: (np.array([i for i, _ in ps], np.int16), _unit(np.array([p for _, p in ps], np.float64))) for n, ps in by_size.items()}
    )

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                column = b.column("vector")
                sizes = np.diff(column.offsets.to_numpy(zero_copy_only=False))
                flat = column.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes)
                perms, vectors = [None] * len(sizes), [None] * len(sizes)
                for n in np.unique(sizes):
                    rows = np.flatnonzero(sizes == n)
                    v = flat[(ends[rows] - n)[:, None] + np.arange(n)].astype(kind)
                    numbers, units = shared.value.get(int(n), (np.zeros(0, np.int16), np.zeros((0, n))))
                    for r, p, x in zip(rows, permutations(_unit(v.astype(np.float64)), numbers, units), v):
                        perms[r], vectors[r] = p, x.tobytes()
                listed = [p[:LISTED][p[:LISTED] >= 0].tolist() or [-1] for p in perms]  # no pivot of the length: one list of the label
                yield pa.RecordBatch.from_arrays(
                    [b.column("g"), b.column("c"), b.column("label"), pa.array(sizes, pa.int32()), pa.array([p.tobytes() for p in perms], pa.binary()),
                     pa.array(listed, pa.list_(pa.int16())), pa.array(vectors, pa.binary())],
                    names=["g", "c", "label", "dim", "perm", "listed", "vector"],
                )

    label = nodes.schema["label"].dataType.simpleString()
    return map_arrow(nodes.select("g", "c", "label", "vector"), run, f"g long, c long, label {label}, dim int, perm binary, listed array<short>, vector binary")


def _indicators(perm: np.ndarray) -> np.ndarray:
    """Rows of how often each column's pivots occur: products are never less than the number of pivots shared."""
    out, rows = np.zeros((len(perm), WIDTH), np.float32), np.arange(len(perm))
    for k in range(perm.shape[1]):
        has = perm[:, k] >= 0
        out[rows[has], perm[has, k] % WIDTH] += 1
    return out


def _verify(p: int, unit, perm, g, c, side, threshold: float):
    """Sums and spanning links of one list; of two sides only pairs between them."""
    n = len(unit)
    listed = perm[:, :LISTED]
    before = np.where((listed >= 0) & (listed < p), listed, -1)
    marks = _indicators(perm)
    need = SHARED if p >= 0 else 0
    # rows with fewer pivots than are to be shared: few pivots there are, so all are candidates
    few = (perm >= 0).sum(axis=1) < TOP
    two = side.min() != side.max()
    sums = np.zeros(n, np.float64)  # of whole numbers
    label, links = np.arange(n), []
    for a in range(0, n, 512):
        z = min(a + 512, n)
        met = marks[a:z] @ marks[:z].T >= need
        met |= few[a:z, None] & few[None, :z]
        for x in range(LISTED):
            for y in range(LISTED):
                met &= (before[a:z, x][:, None] != before[None, :z, y]) | (before[a:z, x] < 0)[:, None]
        met &= np.arange(z)[None, :] < np.arange(a, z)[:, None]
        if two:
            met &= side[a:z, None] != side[None, :z]
        i, j = np.nonzero(met)
        if len(i) * 8 < met.size:
            for s in range(0, len(i), 65536):
                e = slice(s, s + 65536)
                met[i[e], j[e]] = np.einsum("ij,ij->i", unit[a + i[e]], unit[j[e]]) >= threshold
        else:
            met &= unit[a:z] @ unit[:z].T >= threshold
        i, j = np.nonzero(met)
        if not len(i):
            continue
        sums += np.bincount(a + i, c[j], minlength=n)
        sums += np.bincount(j, c[a + i], minlength=n)
        for r in np.unique(i):
            around = np.unique(label[np.append(np.flatnonzero(met[r]), a + r)])
            if len(around) > 1:
                links += [(int(g[around[0]]), int(g[m])) for m in around[1:]]
                label[np.isin(label, around[1:])] = around[0]
    return [(int(g[i]), int(sums[i])) for i in np.flatnonzero(sums)], links


def _found(lists: DataFrame, threshold: float, wide: bool) -> DataFrame:
    """(g, n, v): a sum for a node (v null), or a link g - v (n null)."""
    names = ["p", "dim", "g", "c", "perm", "vector", "side"]
    kind = np.float64 if wide else np.float32
    keys = ["label", "dim", "p", "i", "j"]

    def run(batches):
        def out(parts):
            rows = pa.Table.from_batches(parts)
            if rows.num_rows < 2:
                return None
            dim, p = rows.column("dim")[0].as_py(), rows.column("p")[0].as_py()
            vectors = np.frombuffer(b"".join(rows.column("vector").to_pylist()), kind).reshape(-1, dim).astype(np.float64)
            perm = np.frombuffer(b"".join(rows.column("perm").to_pylist()), np.int16).reshape(-1, TOP)
            g, c, side = (rows.column(x).to_numpy() for x in ("g", "c", "side"))
            sums, links = _verify(p, _unit(vectors), perm, g, c.astype(np.float64), side, threshold)
            if not sums:
                return None
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([x for x, _ in sums] + [a for a, _ in links], pa.int64()),
                    pa.array([n for _, n in sums] + [None] * len(links), pa.int64()),
                    pa.array([None] * len(sums) + [b for _, b in links], pa.int64()),
                ],
                names=["g", "n", "v"],
            )

        at, parts = None, []
        for b in batches:
            columns = [b.column(x).to_pylist() for x in keys]
            starts = [r for r in range(b.num_rows) if r == 0 or any(x[r] != x[r - 1] for x in columns)]
            for start, stop in zip(starts, [*starts[1:], b.num_rows]):
                key = tuple(x[start] for x in columns)
                if key != at:
                    if parts and (done := out(parts)) is not None:
                        yield done
                    at, parts = key, []
                parts.append(b.select(names).slice(start, stop - start))
        if parts and (done := out(parts)) is not None:
            yield done

    placed = lists.repartition(*keys).sortWithinPartitions(*keys)
    return map_arrow(placed.select(*keys, *[x for x in names if x not in keys]), run, "g long, n long, v long")


def near_vectors(rows: DataFrame, threshold: float = 0.98) -> DataFrame:
    """``rows(vec_id, embedding, label)`` to ``(vec_id, n_links, component_id, kept)``, one row each."""
    wide = "float" not in rows.schema["embedding"].dataType.simpleString()
    same = [F.xxhash64(F.lit(s), "label", "embedding").alias(f"h{s}") for s in (1, 2)]
    marked = rows.select("vec_id", "label", F.when(usable(rows), F.col("embedding")).alias("embedding"))
    nodes = cut(
        marked.where("embedding is not null").groupBy("label", F.col("embedding").alias("vector"))
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("c"))
        .withColumn("g", F.monotonically_increasing_id())
    )
    n = nodes.count()
    want = pivots_for(n)
    # a bounded sample, the same on every run
    sample = nodes.select("vector", F.xxhash64(F.lit(17), "label", "vector").alias("h")).orderBy("h").limit(DRAWS * want).collect()
    pivots = spread_pivots([r["vector"] for r in sample], want, threshold)
    lists = _described(nodes, pivots, wide).withColumn("p", F.explode("listed")).drop("listed")
    limit = F.greatest(F.lit(1), F.least(F.lit(LIST), F.floor(F.lit(LIST_BYTES) / (F.lit(8) * F.col("dim")))))
    found = cut(_found(block_pairs(lists, ["label", "dim", "p"], limit, "g"), threshold, wide))
    sums = found.where("n is not null").groupBy("g").agg(F.sum("n").alias("others"))
    groups = connected_components(found.where("v is not null").select(F.col("g").alias("u"), "v"))
    nodes = nodes.withColumnRenamed("vector", "embedding")
    member = nodes.select("g", "least", "c", *same).join(groups, nodes["g"] == groups["node"], "left").join(sums, "g", "left").withColumn(
        "component", F.coalesce("component", "g")
    )
    least = member.groupBy("component").agg(F.min("least").alias("component_id"))
    counted = member.join(least, "component").select(
        "g", "h1", "h2", (F.col("c") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"
    )
    classes = cut(counted)
    names = ["h1", "h2"]
    if not classes.groupBy("h1", "h2").count().where("count > 1").isEmpty():  # by the values then
        classes = classes.join(nodes.select("g", "label", "embedding"), "g")
        names += ["label", "embedding"]
    marked = marked.select("*", *[F.when(F.col("embedding").isNotNull(), h).alias(f"h{s}") for s, h in zip((1, 2), same)])
    return marked.join(classes, names, "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
