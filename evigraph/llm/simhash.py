"""SimHash near-duplicates with generalised pigeonhole candidates (operator 10).

Fingerprints are made in one pass over the texts, without a shuffle.  Equal ones are
reduced to one node first, so copies cost nothing later.  The 64 bits are dealt to
parts such that correlated bits share a part; each part i gets its own threshold t_i
with sum(t_i + 1) = distance + 1, so that any two fingerprints within the distance
agree to within t_i on some part i.  A dynamic programme picks the thresholds that
cost least: rows of keys made plus candidate pairs, counted from the parts' values
over all fingerprints.  A part with threshold t is probed by the keys that leave out t
of its bits: fingerprints within t of one another on the part share such a key.

Keys are sorted, so a bucket is a run of rows; a run is verified block by block with
numpy and yields a spanning forest of its links, never its pairs.  Runs beyond
``LONG`` are cut into blocks whose pairs are keys of their own, at any distance.

Empty or null texts have fingerprint zero and link like any other; rows that repeat an
id keep their own rows; null ids stay null and count last.  Texts of any length count whole.
Only doc_id and text are read, so other columns may have any names; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH, aside, block_pairs, cut, dropped, hash_share, map_arrow, slices, stored, swept
from .components import connected_components

LONG = 8192
PARTS = (3, 4, 5)
PAIR_COST = 0.005  # of the cost of a key row
GATE = 44  # of 128 bits; the tests compute what it loses at a similarity of 0.8
BLOCK, BLOCK_ITEMS = 512, 2 << 20  # sets compared in one task, and their shingles
SHORT, DENSE = 16, 4  # rows of one key that are always compared pair by pair, and pairs a row from which a longer run counts as dense
ROUND = 32_000_000  # rows of keys that are shuffled at a time
SAMPLE = 2000


def _hash_bits(items, seed: int = 42) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_digest
    raw = b"".join([digest(x, seed) for x in items])
    return np.frombuffer(raw, np.uint8).reshape(-1, 8)


def _counts(items, seed: int = 42, weights=None) -> np.ndarray:
    """For each of 64 bits (highest first), the weight of the items whose hash has it set."""
    total = np.zeros(64)
    for i in range(0, len(items), 65536):
        bits = np.unpackbits(_hash_bits(items[i : i + 65536], seed), axis=1)
        if weights is None:
            total += bits.sum(axis=0, dtype=np.int32)
        else:
            total += np.asarray(weights[i : i + 65536], np.float64) @ bits
    return total


def _signed(bits: np.ndarray) -> int:
    return int(np.packbits(bits).view(">i8")[0])


def shingles(words: list[bytes], n: int) -> list[bytes]:
    """Runs of n words joined by spaces; all words if there are fewer, nothing if there are none."""
    if len(words) < n:
        return [b" ".join(words)] if words else []
    if n == 3:
        return [a + b" " + b + b" " + c for a, b, c in zip(words, words[1:], words[2:])]
    return [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def fingerprint(text: str | None, words: int = 3) -> int:
    """A text's fingerprint as a signed 64-bit number: a bit is set if over half of the shingles' hashes have it."""
    s = shingles(words_of(text), words)
    return _signed(_counts(s) * 2 > len(s)) if s else 0


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, fp long)``."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, 2000, 8 << 20):
                got = [fingerprint(t.as_py(), words) for t in b.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").cast(pa.int64()), pa.array(got, pa.int64())], names=["doc_id", "fp"]
                )

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def shingle_set(text: str | None, shingle: int = 5) -> tuple[np.ndarray, int, int]:
    """The distinct shingles as sorted 64-bit hashes, and the two halves of a 128-bit SimHash over them."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    s = list(dict.fromkeys(shingles(words_of(text), shingle)))
    if not s:
        return np.zeros(0, np.uint64), 0, 0
    total, own = np.zeros(128), []
    for i in range(0, len(s), 65536):
        raw = np.frombuffer(b"".join([digest(x, 1) for x in s[i : i + 65536]]), np.uint8).reshape(-1, 16)
        total += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int32)
        own.append(raw[:, :8].copy().view(np.uint64).ravel())
    bits = total * 2 > len(s)
    return np.unique(np.concatenate(own)), _signed(bits[:64]), _signed(bits[64:])


# ---------------------------------------------------------------- parts and thresholds


def bit_products(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each pair of bits, how many have both set (fixed size: 64 x 64)."""

    def run(batches):
        n, total = 0, np.zeros((64, 64))
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            bits = np.unpackbits(fp.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            n += len(fp)
            total += bits.T @ bits
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(np.arange(4096), 4096), pa.int32()),
                pa.array(np.append(total.ravel(), n).astype(np.int64)),
            ],
            names=["cell", "n"],
        )

    rows = map_arrow(prints.select("fp"), run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = {r["cell"]: r["n"] for r in rows}
    return cells.get(4096, 0), np.array([cells.get(i, 0) for i in range(4096)], np.float64).reshape(64, 64)


def bit_parts(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the bits (0 is the highest) to parts of even size, each grown by the bit most correlated with it."""
    n = max(n, 1)
    mean = np.diag(both) / n
    cov = both / n - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, out = set(range(64)), []
    for i in range(parts):
        size = 64 // parts + (i < 64 % parts)
        members = [max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())]
        free.discard(members[0])
        while len(members) < size:
            best = max(sorted(free), key=lambda b: corr[b, members].sum())
            members.append(best)
            free.discard(best)
        out.append(sorted(members))
    return out


def part_value(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    value = np.zeros(len(fp), np.uint64)
    for b in bits:
        value = (value << np.uint64(1)) | ((fp >> np.uint64(63 - b)) & np.uint64(1))
    return value


def _key_rows(prints: DataFrame, plan: list[tuple[list[int], int]], carry: list[str]) -> DataFrame:
    """(key, fp, carry...) for every key of every fingerprint; plan: bits and threshold of each part in use."""
    masks = []
    for p, (bits, t) in enumerate(plan):
        for k, out in enumerate(itertools.combinations(range(len(bits)), t)):
            mask = (1 << len(bits)) - 1
            for b in out:
                mask &= ~(1 << b)
            masks.append((p, k, mask))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                fp = b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                values = [part_value(fp, bits) for bits, _ in plan]
                keys = np.empty((len(masks), len(fp)), np.uint64)
                for i, (p, k, mask) in enumerate(masks):
                    tag = np.uint64(((p + 1) << 20 | k) << 32)
                    keys[i] = (values[p] & np.uint64(mask)) ^ tag
                times = lambda c: pa.array(np.tile(c.to_numpy(zero_copy_only=False).astype(np.int64), len(masks)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)), *(times(b.column(c)) for c in ["fp", *carry])],
                    names=["key", "fp", *carry],
                )

    return map_arrow(
        prints.select("fp", *carry), run, ", ".join(f"{c} long" for c in ["key", "fp", *carry])
    )


def choose_plan(prints: DataFrame, distance: int, parts=PARTS) -> list[tuple[list[int], int]]:
    """Parts and thresholds of least estimated cost, from all fingerprints; parts that are not probed are left out."""
    n, both = bit_products(prints)
    layouts = {m: bit_parts(n, both, m) for m in parts}
    flat = [(m, i, bits) for m, layout in layouts.items() for i, bits in enumerate(layout)]
    values = _key_rows(prints, [(bits, 0) for _, _, bits in flat], [])
    same = (
        values.groupBy("key").agg(F.count("*").alias("c"))
        .groupBy(F.shiftright("key", 52).alias("part")).agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2).alias("pairs"))
    ).collect()
    pairs = {r["part"] - 1: r["pairs"] for r in same}
    best = None
    for m in parts:
        cost = [[0.0] for _ in range(m)]  # cost[i][s]: of spending s = t + 1 on part i; 0 leaves it out
        for j, (mm, i, bits) in enumerate(flat):
            if mm == m:
                for t in range(0, min(distance, 3) + 1):
                    keys = len(list(itertools.combinations(range(len(bits)), t)))
                    # leaving out t bits makes a bucket 2**t times as large
                    cost[i].append(keys * n + PAIR_COST * keys * (2**t) * pairs.get(j, 0.0))
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for i in range(m):
            step: dict[int, tuple[float, list[int]]] = {}
            for spent, (c, chosen) in table.items():
                for s, extra in enumerate(cost[i]):
                    k = min(spent + s, distance + 1)
                    if k not in step or c + extra < step[k][0]:
                        step[k] = (c + extra, [*chosen, s - 1])
            table = step
        if distance + 1 in table:
            c, chosen = table[distance + 1]
            if best is None or c < best[0]:
                best = (c, [(bits, t) for bits, t in zip(layouts[m], chosen) if t >= 0])
    return best[1]


# ---------------------------------------------------------------- verification


def _forest(fp: np.ndarray, checks: np.ndarray, ids: np.ndarray, distance: int, check_distance: int):
    """Links that span each group of linked rows of one run."""

    def near(rows, others):
        got = np.bitwise_count(fp[rows][:, None] ^ fp[others][None]) <= distance
        if len(checks):
            got &= sum(np.bitwise_count(c[rows][:, None] ^ c[others][None]).astype(np.int32) for c in checks) <= check_distance
        return got

    return _span(near, ids)


def _span(near, ids: np.ndarray):
    """Links that span each group of rows linked by ``near(rows, others)``.

    Rows of one group need no comparison with one another: a few rows are held against all first, and then only
    rows outside the largest group found so far, block by block.
    """
    n = len(ids)
    label = np.arange(n)
    us, vs = [], []

    def unite(row, with_rows):
        met = np.unique(label[np.append(with_rows, row)])
        if len(met) > 1:
            us.extend([ids[met[0]]] * (len(met) - 1))
            vs.extend(ids[met[1:]])
            label[np.isin(label, met[1:])] = met[0]

    everyone, tried = np.arange(n), np.zeros(n, bool)
    if n > 512:
        for _ in range(16):
            values, counts = np.unique(label, return_counts=True)
            outside = np.flatnonzero((label != values[counts.argmax()]) & ~tried)
            if not len(outside):
                break
            row = outside[0]
            tried[row] = True
            unite(row, np.flatnonzero(near(np.array([row]), everyone)[0]))
        values, counts = np.unique(label, return_counts=True)
        largest = label == values[counts.argmax()]
        rest, inside = np.flatnonzero(~largest), np.flatnonzero(largest)
        everyone = np.concatenate([rest, inside])  # rest x all, with the rest's own pairs once
    else:
        rest = everyone
    for a in range(0, len(rest), 256):
        z = min(a + 256, len(rest))
        met = near(rest[a:z], everyone)
        met &= (np.arange(n)[None, :] < np.arange(a, z)[:, None]) | (np.arange(n) >= len(rest))[None, :]
        for i in np.nonzero(met.any(axis=1))[0]:
            unite(rest[a + i], everyone[np.nonzero(met[i])[0]])
    return us, vs


def _links_in_runs(run, fp, checks, ids, distance, check_distance):
    """Links within runs of equal numbers (in sequence)."""
    starts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    sizes = np.diff(np.append(starts, len(run)))
    us, vs = [], []
    small = np.repeat(sizes <= 16, sizes)
    k, f, i, c = run[small], fp[small], ids[small], [x[small] for x in checks]
    for s in range(1, 16):
        if len(k) <= s:
            break
        ok = np.flatnonzero(k[s:] == k[:-s])
        if not len(ok):
            break
        ok = ok[np.bitwise_count(f[ok] ^ f[ok + s]) <= distance]
        if len(checks):
            ok = ok[sum(np.bitwise_count(x[ok] ^ x[ok + s]).astype(np.int32) for x in c) <= check_distance]
        us += list(i[ok])
        vs += list(i[ok + s])
    for a, n in zip(starts[sizes > 16], sizes[sizes > 16]):
        rows = slice(a, a + n)
        got = _forest(fp[rows], [x[rows] for x in checks], ids[rows], distance, check_distance)
        us += got[0]
        vs += got[1]
    return us, vs


def _run_links(keyed: DataFrame, checks: list[str], distance: int, check_distance: int) -> DataFrame:
    """``keyed(key, fp, node, checks...)`` to links ``(u, v)`` within equal keys; long runs are cut into pairs of blocks."""
    names = ["key", "i", "j", "node", "fp", *checks]

    def run(batches):
        left = None

        def found(data, runs):
            c = [x.view(np.uint64) for x in data[4:]]
            us, vs = _links_in_runs(runs, c[0], c[1:], data[3], distance, check_distance)
            both = np.unique(np.array([us, vs], np.int64).T.reshape(-1, 2), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["u", "v"])

        for b in batches:
            data = [b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]
            if left is not None:
                data = [np.concatenate(x) for x in zip(left, data)]
            if len(data[0]) == 0:
                continue
            runs = np.append(0, np.cumsum(np.any([x[1:] != x[:-1] for x in data[:3]], axis=0)))
            end = int(np.searchsorted(runs, runs[-1]))
            left = [x[end:] for x in data]
            if end:
                yield found([x[:end] for x in data], runs[:end])
        if left is not None and len(left[0]):
            yield found(left, np.zeros(len(left[0]), np.int64))

    rows = block_pairs(keyed, ["key"], LONG, "node")
    return map_arrow(rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").select(*names), run, "u long, v long")


def links(prints: DataFrame, distance: int, check_distance: int = 0, parts=PARTS) -> DataFrame:
    """``prints(fp, node[, c1, c2])``, one row a node, to links ``(u, v)`` that span the groups of near fingerprints.

    With ``c1`` and ``c2`` a link also needs these 128 bits to differ in at most ``check_distance``.
    """
    checks = [c for c in ("c1", "c2") if c in prints.columns]
    plan = choose_plan(prints, distance, parts)
    return _run_links(_key_rows(prints, plan, ["node", *checks]), checks, distance, check_distance)


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, fp, component_id)``: groups linked by fingerprints that differ in few bits.

    ``component_id`` is the smallest id of the group; each input row has one row.
    """
    prints = cut(fingerprints(docs, words))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.col("fp")))
    return prints.join(_classes(nodes, links(nodes, distance)), "fp").select("doc_id", "fp", "component_id")


def _classes(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(fp, component_id) for every node's fingerprint columns."""
    groups = connected_components(found)
    member = nodes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = member.where("component <> node").groupBy("component").agg(F.min("least").alias("others"))
    roots = member.where("component = node").join(least, "component", "left").select(
        "component", F.least("least", "others").alias("component_id")
    )
    return cut(member.join(roots, "component").select(*[c for c in nodes.columns if c not in ("least", "node")], "component_id"))


# ---------------------------------------------------------------- similarity of shingle sets


def prefix(hashes: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first of a set's shingles in one order for all sets: two sets of that Jaccard similarity or more share one of theirs."""
    n = len(hashes)
    if not n:
        return hashes
    hot = np.isin(hashes, common)  # shingles known to be common come last; any order that is the same for all would do
    return np.concatenate([hashes[~hot], hashes[hot]])[: n - math.ceil(similarity * n - 1e-9) + 1]


def parities(hashes: np.ndarray) -> bytes:
    """For each of 1,024 buckets whether it holds an odd number of shingles: two sets differ in as many shingles as bits here, or more."""
    return np.packbits(np.bincount((hashes & np.uint64(1023)).astype(np.int64), minlength=1024).astype(np.uint8) & 1).tobytes()


def _common_shingles(docs: DataFrame, shingle: int) -> np.ndarray:
    """Shingles of three or more different texts of a sample of about ``SAMPLE`` texts, counted by the executors; they only save work."""
    share = SAMPLE / max(docs.count(), 1)
    texts = docs.select("text", _text_hash().alias("t")).where(hash_share("t", 5) < share).groupBy("t").agg(F.first("text").alias("text"))

    def run(batches):
        for whole in batches:
            for b in slices(whole, 500, 4 << 20):
                for text in b.column("text"):
                    yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py(), shingle)[0].view(np.int64))], names=["h"])

    common = map_arrow(texts, run, "h long").groupBy("h").count().where("count >= 3").select("h").collect()
    return np.array([r["h"] for r in common], np.int64).view(np.uint64)


def _marks(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(doc_id, t, n1, n2, c1, c2, size, keys, odd) of every row, written once.

    t: a hash of the text that tells rows of one id apart; n1, n2: 128-bit digest of the set; c1, c2: its SimHash; keys: its prefix;
    odd: its ``parities``.
    """
    import xxhash

    common = docs.sparkSession.sparkContext.broadcast(_common_shingles(docs, shingle))

    def run(batches):
        for whole in batches:
            for b in slices(whole, 500, 4 << 20):
                own, size, keys, odd = [], [], [], []
                for text in b.column("text"):
                    h, c1, c2 = shingle_set(text.as_py(), shingle)
                    n = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes(), 7), np.int64)
                    own.append((n[0], n[1], c1, c2))
                    size.append(len(h))
                    odd.append(parities(h))
                    keys.append(prefix(h, common.value, similarity).view(np.int64))
                own = np.array(own, np.int64).reshape(-1, 4)
                ends = np.append(0, np.cumsum([len(x) for x in keys]))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("t"), *(pa.array(np.ascontiguousarray(own[:, i])) for i in range(4)), pa.array(size, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *keys]))),
                     pa.array(odd, pa.binary())],
                    names=["doc_id", "t", "n1", "n2", "c1", "c2", "size", "keys", "odd"],
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_hash().alias("t"))
    schema = "doc_id long, t long, n1 long, n2 long, c1 long, c2 long, size long, keys array<long>, odd binary"
    return stored(map_arrow(texts, run, schema, BATCH), "marks")


def _text_hash():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _may_be(x, y, c1, c2, size, place, similarity: float):
    """Which pairs of rows (x, y broadcast together) of one key can be of the similarity: by sizes and by what follows the shared shingle, both
    exact, and by 128 bits within ``GATE``.  A pair passes the second at the first shingle it shares, or it isn't similar."""
    need = similarity / (1 + similarity) * (size[x] + size[y]) - 1e-6
    ok = np.minimum(size[x], size[y]) >= need
    ok &= np.minimum(size[x] - place[x], size[y] - place[y]) >= need
    return ok & (np.bitwise_count(c1[x] ^ c1[y]).astype(np.int16) + np.bitwise_count(c2[x] ^ c2[y]) <= GATE)


def _pairs_in_runs(run, node, c1, c2, size, place, similarity: float):
    """(u, v, dense) of the runs of equal numbers: every pair that may be similar (dense 0), or, in a run of more than ``SHORT`` rows where a row
    has more than about ``DENSE`` such pairs, links that span the groups which these form (dense 1)."""
    starts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    sizes = np.diff(np.append(starts, len(run)))
    us, vs, dense = [], [], []

    def add(u, v, kind):
        us.append(node[u])
        vs.append(node[v])
        dense.append(np.full(len(u), kind))

    at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SHORT), sizes))
    for s in range(1, SHORT):
        x, y = at[:-s], at[s:]
        same = run[x] == run[y]
        if not same.any():
            break
        x, y = x[same], y[same]
        ok = _may_be(x, y, c1, c2, size, place, similarity)
        add(x[ok], y[ok], 0)
    for a, n in zip(starts[sizes > SHORT], sizes[sizes > SHORT]):
        near = lambda x, y: _may_be((a + x)[:, None], (a + y)[None, :], c1, c2, size, place, similarity)  # noqa: B023, E731
        everyone = np.arange(n)
        some = np.unique(np.linspace(0, n - 1, min(n, 256)).astype(np.int64))
        if near(some, everyone).sum() - len(some) > 2 * DENSE * len(some):
            got = np.array(_span(near, everyone), np.int64).reshape(2, -1)
            add(a + got[0], a + got[1], 1)
            continue
        for b in range(0, n, 512):
            x = everyone[b : b + 512]
            i, j = np.nonzero(near(x, everyone[: b + 512]) & (everyone[None, : b + 512] < x[:, None]))
            add(a + x[i], a + j, 0)
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *us]), np.concatenate([empty, *vs]), np.concatenate([empty, *dense])


def _candidates(nodes: DataFrame, similarity: float) -> DataFrame:
    """``(u, v, dense)``, u > v, once each: pairs of sets that share a shingle of their prefixes and may be similar; see ``_pairs_in_runs``.

    Keys are taken in rounds of about ``ROUND`` rows, so the shuffle's disk doesn't grow with the table: a round's files go before the next.
    """
    names = ["key", "i", "j", "node", "c1", "c2", "size", "place"]

    def run(batches):
        left = None

        def found(data):
            if not len(data[0]):
                return
            runs = np.append(0, np.cumsum(np.any([x[1:] != x[:-1] for x in data[:3]], axis=0)))
            u, v, dense = _pairs_in_runs(runs, data[3], data[4].view(np.uint64), data[5].view(np.uint64), data[6], data[7], similarity)
            apart = u != v
            rows = np.unique(np.array([np.maximum(u, v), np.minimum(u, v), dense])[:, apart].T, axis=0)
            for a in range(0, len(rows), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[a : a + (1 << 16), k])) for k in range(3)], names=["u", "v", "dense"])

        def whole(held):
            nonlocal left
            data = [np.concatenate(x) for x in zip(*([left] if left is not None else []), *held)]
            last = np.all([x == x[-1] for x in data[:3]], axis=0)
            end = 0 if last.all() else int(len(last) - np.argmin(last[::-1]))
            left = [x[end:] for x in data]
            yield from found([x[:end] for x in data])

        held, n = [], 0
        for b in batches:
            held.append([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in names])
            n += b.num_rows
            if n >= 1 << 16:
                yield from whole(held)
                held, n = [], 0
        if n:
            yield from whole(held)
        if left is not None:
            yield from found(left)

    many = nodes.agg(F.sum(F.size("keys"))).first()[0] or 0
    rounds, parts = max(1, math.ceil(many / ROUND)), []
    long = _long_keys(nodes)
    for r in range(rounds):
        keyed = nodes.select(F.posexplode("keys").alias("place", "key"), "node", "c1", "c2", "size").where(F.pmod("key", F.lit(rounds)) == r)
        rows = keyed.withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
        if long is not None:
            own = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")
            rows = (
                keyed.join(long.withColumnRenamed("key", "long"), F.col("key") == F.col("long"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
                .withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
            )
        placed = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").select(*names)
        parts.append(stored(map_arrow(placed, run, "u long, v long, dense long").distinct(), "pairs"))
        del keyed, rows, placed
        swept(nodes.sparkSession)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    pairs = cut(found.groupBy("u", "v").agg(F.max("dense").alias("dense")))
    for p in parts:
        dropped(p)
    return pairs


def _pigeonholed(nodes: DataFrame, distance: int) -> DataFrame:
    """Links ``(u, v)`` that span the groups of sets whose 64-bit fingerprints differ in ``distance`` bits or fewer, by the query's parts and
    thresholds; sets of one fingerprint are reduced to one node first."""
    prints = cut(nodes.groupBy(F.col("c1").alias("fp")).agg(F.min("node").alias("v")))
    equal = nodes.select(F.col("node").alias("u"), "c1").join(prints, F.col("c1") == F.col("fp")).where("u <> v").select("u", "v")
    found = cut(links(prints.select("fp", F.col("v").alias("node")), distance).unionByName(equal))
    swept(nodes.sparkSession)
    return found


def _between(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """``pairs(u, v)`` less those within one of ``groups(node, component)``, whose sets are compared exactly as a group."""
    ends = [groups.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in ("u", "v")]
    return pairs.join(ends[0], "u", "left").join(ends[1], "v", "left").where("not coalesce(of_u = of_v, false)").select("u", "v")


def _not_apart(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """``pairs(u, v)`` less those whose sets differ in too many shingles, as their parities prove (exact; sets are sent for the rest only)."""

    def run(batches):
        for b in batches:
            u, v, n, x, y = (b.column(b.schema.get_field_index(c)) for c in ("u", "v", "n", "x", "y"))
            bits = [np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(-1, 16) for c in (x, y)]
            differ = np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1, dtype=np.int64)
            near = pa.array(differ <= (1 - similarity) / (1 + similarity) * n.to_numpy(zero_copy_only=False) + 1e-6)
            yield pa.RecordBatch.from_arrays([u.filter(near), v.filter(near)], names=["u", "v"])

    ends = [nodes.select(F.col("node").alias(c), F.col("odd").alias(o), F.col("size").alias(f"n{c}")) for c, o in (("u", "x"), ("v", "y"))]
    both = pairs.select("u", "v").join(ends[0], "u").join(ends[1], "v").select("u", "v", (F.col("nu") + F.col("nv")).alias("n"), "x", "y")
    return cut(map_arrow(both, run, "u long, v long"))


def _long_keys(nodes: DataFrame) -> DataFrame | None:
    """(key, blocks) of keys that more than ``LONG`` nodes have, as a sample of nodes shows; one not seen is compared whole all the same."""
    share = min(1.0, 128 / LONG)
    some = nodes if share == 1 else nodes.where(hash_share("node", 9) < share)
    counts = some.select(F.explode("keys").alias("key")).groupBy("key").agg((F.count("*") / F.lit(share)).alias("n")).where(F.col("n") > LONG)
    long = cut(counts.select("key", F.ceil(F.col("n") / LONG).cast("int").alias("blocks")))
    return None if long.isEmpty() else long


def _pairs_verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links ``(u, v)`` of exact similarity among ``pairs(u, v)``: the sets around each u meet, in parts of about ``BLOCK`` sets."""
    size = nodes.select(F.col("node").alias("v"), "size")
    sized = pairs.select("u", "v").join(size, "v")
    parts = sized.groupBy("u").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_ITEMS)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("v", F.lit(5)), F.col("parts")).cast("int").alias("part")
    around = cut(
        pairs.select("u", "v").join(parts, "u").select("u", part, F.col("v").alias("node"))
        .unionByName(parts.select("u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("u").alias("node")))
    )
    member = nodes.select("node", "rep").join(around.select("node").distinct(), "node")
    sets = _sets(docs, member.withColumn("component", F.lit(0).cast("long")).withColumn("blocks", F.lit(1)), shingle)
    swept(docs.sparkSession)
    found = cut(_compared(around.join(sets.select("node", "items"), "node"), ["u", "part"], similarity))
    dropped(sets)
    return found


def _similar(nodes, sets, similarity: float):
    """Links that span the groups of sets of exact Jaccard similarity."""
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), size)
    several = np.bincount(at, minlength=len(values)) > 1
    place = np.cumsum(several) - 1
    row, at = row[several[at]], place[at[several[at]]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    shared = np.zeros((n, n), np.float32)  # of whole numbers
    for start in range(0, int(several.sum()), 4096):
        a, z = np.searchsorted(at, [start, start + 4096])
        has = np.zeros((n, 4096), np.float32)
        has[row[a:z], at[a:z] - start] = 1
        shared += has @ has.T
    shared = shared.astype(np.float64)
    near = np.tril(shared >= similarity * (size[:, None] + size[None, :] - shared) - 1e-9, -1)
    label, us, vs = np.arange(n), [], []
    for i in np.flatnonzero(near.any(axis=1)):
        met = np.unique(label[np.append(np.flatnonzero(near[i]), i)])
        us += [int(nodes[met[0]])] * (len(met) - 1)
        vs += [int(nodes[m]) for m in met[1:]]
        label[np.isin(label, met[1:])] = met[0]
    return us, vs


def _compared(rows: DataFrame, keys: list[str], similarity: float) -> DataFrame:
    """Links ``(u, v)`` of exact similarity between the sets ``rows(keys..., node, items)`` of equal keys, each in one task."""

    def run(batches):
        def out(group):
            if len(group) < 2:
                return None
            us, vs = _similar(list(group), list(group.values()), similarity)
            return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

        at, group = None, {}
        for b in batches:
            columns = (b.column(b.schema.get_field_index(c)) for c in (*keys, "node", "items"))
            for *key, node, items in zip(*(x.to_pylist() for x in columns)):
                if key != at:
                    if (done := out(group)) is not None:
                        yield done
                    at, group = key, {}
                group[node] = np.frombuffer(items, np.uint64)
        if (done := out(group)) is not None:
            yield done

    placed = rows.select(*keys, "node", "items").repartition(*keys).sortWithinPartitions(*keys)
    return map_arrow(placed, run, "u long, v long")


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, component, blocks, items): the shingle sets of the nodes wanted, written once."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_hash().alias("t"))
    chosen = texts.join(
        wanted.select(F.col("rep.doc_id").alias("of"), F.col("rep.t").alias("of_t"), "node", "component", "blocks"),
        F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("t") == F.col("of_t")),
    ).select("text", "node", "component", "blocks")

    def run(batches):
        for whole in batches:
            for b in slices(whole, 500, 4 << 20):
                got = [shingle_set(t.as_py(), shingle)[0].tobytes() for t in b.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in ("node", "component", "blocks")), pa.array(got, pa.binary())], names=["node", "component", "blocks", "items"]
                )

    return stored(map_arrow(chosen, run, "node long, component long, blocks int, items binary"), "sets")


def _verified(docs: DataFrame, nodes: DataFrame, groups: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links ``(u, v)`` of exact similarity within the groups of candidates.

    Groups of up to ``BLOCK`` sets are compared in one task.  Larger ones are dealt twice to blocks of that size, which
    unites most of what is alike; then only sets outside a group's largest class are compared, with all others, by pairs of blocks.
    """
    member = nodes.select("node", "rep", "size").join(groups, "node")
    counts = member.groupBy("component").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_ITEMS)).cast("int").alias("blocks")
    )
    sets = _sets(docs, member.join(counts, "component"), shingle)
    deal = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    rows = sets.withColumn("salt", F.explode(F.when(F.col("blocks") > 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))))
    first = cut(_compared(rows.withColumn("own", deal("salt", "blocks")), ["component", "salt", "own"], similarity))
    large = sets.where("blocks > 1")
    if large.isEmpty():
        dropped(sets)
        return first
    labels = large.select("node", "component", F.length("items").alias("bytes")).join(
        connected_components(first).withColumnRenamed("component", "label"), "node", "left"
    ).withColumn("label", F.coalesce("label", "node"))
    sizes = labels.groupBy("component", "label").agg(F.count("*").alias("n"))
    main = sizes.groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    labels = cut(labels.join(main, "component").withColumn("inside", F.col("label") == F.col("main")).select("node", "component", "inside", "bytes"))
    blocks = lambda of: F.greatest(
        F.ceil(F.count(F.when(of, 1)) / BLOCK), F.ceil(F.sum(F.when(of, F.col("bytes"))) / (8 * BLOCK_ITEMS)), F.lit(0)
    ).cast("int")
    shape = labels.groupBy("component").agg(blocks(F.col("inside")).alias("m"), blocks(~F.col("inside")).alias("r")).where("r > 0")
    left = large.drop("blocks").join(labels.drop("bytes"), ["node", "component"]).join(shape, "component")
    far = left.withColumn("own", F.when(F.col("inside"), deal(3, "m")).otherwise(deal(3, "r")))
    numbers = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    pairs = far.select(
        "component", "node", "items",
        F.explode(
            F.when(F.col("inside"), F.transform(numbers("r"), lambda x: F.struct(F.lit(0).alias("kind"), x.alias("i"), F.col("own").alias("j"))))
            .otherwise(
                F.concat(
                    F.transform(numbers("m"), lambda x: F.struct(F.lit(0).alias("kind"), F.col("own").alias("i"), x.alias("j"))),
                    F.transform(numbers("r"), lambda x: F.struct(F.lit(1).alias("kind"), F.least("own", x).alias("i"), F.greatest("own", x).alias("j"))),
                )
            )
        ).alias("pair"),
    ).select("component", "pair.*", "node", "items")
    found = cut(first.unionByName(_compared(pairs, ["component", "kind", "i", "j"], similarity)))
    dropped(sets)
    return found


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, distance: int = 3) -> DataFrame:
    """All columns of ``docs``, one document of each group of near-duplicates: that of the smallest id.

    Near: an exact Jaccard similarity of ``similarity`` or more of the sets of five-word shingles (as 64-bit hashes).
    Sets whose 64-bit SimHash differs in at most ``distance`` bits are found by the pigeonhole of ``near_duplicates`` and form groups, each
    compared exactly.  A Hamming distance that can be probed reaches few pairs near ``similarity``, so the rest is found otherwise:
    sets so similar share a shingle of their prefixes; pairs that do, that their sizes, the shingles' places and parities (all exact)
    do not rule out, and whose 128-bit SimHash differs in at most ``GATE`` bits are compared exactly: pair by pair, or by groups where
    a shingle has many such pairs.  Sets with one 128-bit digest are taken to be equal.

    Null texts count as empty; texts without words are one group.  Null ids come last; of rows with one id and text one
    stays.  Texts of any length count whole.  Other columns are carried along whatever their names; an empty table stays empty.
    """
    marks = _marks(docs, shingle, similarity)
    nodes = stored(
        marks.groupBy("n1", "n2").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t")).alias("rep"),
            F.first("c1").alias("c1"), F.first("c2").alias("c2"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("odd").alias("odd"),
        ).withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    repeated = cut(marks.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again")))
    dropped(marks)
    close = _pigeonholed(nodes, distance)
    pairs = _candidates(nodes, similarity)
    groups = cut(connected_components(close.unionByName(pairs.where("dense = 1").select("u", "v"))))
    sparse = _not_apart(_between(pairs.where("dense = 0"), groups), nodes, similarity)
    found = _verified(docs, nodes, groups, shingle, similarity).unionByName(_pairs_verified(docs, nodes, sparse, shingle, similarity))
    classes = connected_components(found)
    member = nodes.select("node", "rep").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    chosen = stored(
        member.groupBy("component").agg(F.min("rep").alias("rep")).select(F.col("rep.doc_id").alias("_of"), F.col("rep.t").alias("_t")), "chosen"
    )
    dropped(nodes)
    of, again = F.col("_of"), F.col("_again")
    plain, restore = aside(docs, "doc_id", "text")
    id_ = F.col("doc_id").cast("long")
    if repeated.isEmpty():
        return plain.join(chosen, id_.eqNullSafe(of), "left_semi").select(*restore)
    kept = plain.join(chosen, id_.eqNullSafe(of) & (_text_hash() == F.col("_t")), "left_semi")
    once = kept.join(repeated, id_.eqNullSafe(again), "left_anti")
    several = kept.join(repeated, id_.eqNullSafe(again), "left_semi").withColumn("_text", F.coalesce("text", F.lit("")))
    return once.unionByName(several.dropDuplicates(["doc_id", "_text"]).drop("_text")).select(*restore)
