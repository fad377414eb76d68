"""The corpus operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from evigraph.llm import bpe, cws, langid, linededup, mixing, pii, pivots, quality, queries, simhash, tokenfile

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


@pytest.fixture(scope="module")
def texts(spark):
    return [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


def duck(sql, **tables):
    import duckdb

    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    return con.execute(sql).fetchall(), [d[0] for d in con.description]


# ---------------------------------------------------------------- BPE and token files


def test_bpe_equals_the_library(tokenizer, texts):
    own = bpe.Bpe(bpe.read_spec(queries.tokenizer_path()))
    rng = random.Random(3)
    parts = ["abcdefgh", " \n\t", "éèüßñÑÇİıſKΣσς", "'stredvml", "0123٣", "!?.,$%#", "̧̀́‍　\x1d", "漢字😀가"]
    hard = ["".join(rng.choice(rng.choice(parts)) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    hard += ["", "<|startoftext|>hi<|endoftext|> x", "İstanbul ΣΑΣ", "don't WE'LL", "a" * 5000, "x y " * 3000, "\x00 \x85v"]
    for text in hard + [t for _, t, _ in texts[:150]]:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_memory_is_bounded_and_exact(tokenizer):
    own = bpe.Bpe(bpe.read_spec(queries.tokenizer_path()))
    own.pieces.room = 50
    rng = random.Random(1)
    for _ in range(300):
        t = " ".join("".join(rng.choice("abcdeT,.") for _ in range(rng.randint(1, 7))) for _ in range(20))
        assert own.encode(t) == tokenizer.encode(t, add_special_tokens=False).ids
        assert len(own.pieces) <= 51


def test_encoding_documents_remembers_ids_only(tokenizer, spark, monkeypatch):
    """What a worker holds on to counts in its executor while later stages run: ids of a bounded number of pieces and no texts of them."""
    import pyarrow as pa

    from evigraph.llm.common import worker_cache

    runs = []
    monkeypatch.setattr(bpe, "map_arrow", lambda df, run, schema: runs.append(run))
    monkeypatch.setattr(bpe, "FEW_PIECES", 50)
    monkeypatch.setattr(bpe, "FEW_FITS", 20)
    bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string"), queries.tokenizer_path())
    rng = random.Random(4)
    hard = ["İstanbul ΣΑΣ <|endoftext|>x DON'T", "\x1c a\x1db", "", "a" * 300]
    texts = hard + [" ".join("".join(rng.choice("abcdeéT,.3") for _ in range(rng.randint(1, 7))) for _ in range(20)) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    got = [ids for b in runs[0](iter([batch])) for ids in b.column("ids").to_pylist()]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    held = worker_cache("bpe_ids").pop("bpe")
    worker_cache("bpe_ids").clear()
    assert 0 < len(held.packed) <= 51 and 0 < len(held.fits) <= 20 and {type(v) for v in held.packed.values()} == {bytes}
    assert not held.pieces and not {"number", "token"} & set(vars(held))


def test_documents_encode_and_decode(spark, tokenizer):
    docs = spark.createDataFrame([(1, "The cat, the CAT"), (2, None), (3, "")], "doc_id long, text string")
    got = bpe.encode_documents(docs, queries.tokenizer_path())
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[1]["ids"] == tokenizer.encode("The cat, the CAT", add_special_tokens=False).ids
    assert rows[2]["ids"] == rows[3]["ids"] == []
    text = {r["doc_id"]: r["text"] for r in bpe.decode_documents(got, queries.tokenizer_path()).collect()}
    assert text[1] == tokenizer.decode(rows[1]["ids"], skip_special_tokens=False) and text[2] == ""


def test_token_files_round_trip(spark, tokenizer, texts, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tokenfile.write(docs, queries.tokenizer_path(), str(tmp_path / "t"))
    got = tokenfile.checked(spark, str(tmp_path / "t")).orderBy("doc_id").collect()
    start = 0
    for row, (doc, text, _) in zip(got, texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert (row["doc_id"], row["start"], row["n_tokens"]) == (doc, start, len(ids))
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    one = tokenfile.documents(spark, str(tmp_path / "t"), ["ids"], "doc_id = 17").collect()
    assert one[0]["ids"][:-1] == tokenizer.encode(texts[17][1], add_special_tokens=False).ids
    plan = tokenfile.starts(spark, str(tmp_path / "t"))._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    import pyarrow.parquet as pq

    files = sorted((tmp_path / "t").glob("*.parquet"))
    meta = pq.ParquetFile(files[0]).metadata.row_group(0)
    by_name = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in by_name["doc_id"].encodings
    assert any("DICTIONARY" in e for e in by_name["ids.list.element"].encodings)
    assert by_name["doc_id"].has_column_index and by_name["doc_id"].has_offset_index


# ---------------------------------------------------------------- near-duplicates


def union_find(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprint_is_the_contracts():
    import xxhash

    def plain(text):
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if x]
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for t in ["", "One", "one two", "A b\tc\x0bd É f g h", "x " * 50, "ÀÉ\xa0z É f g h i j k l"]:
        assert simhash.fingerprint(t) & (2**64 - 1) == plain(t)


def test_simhash_groups_equal_brute_force(spark, texts):
    rng = random.Random(5)
    rows = [(d, t) for d, t, _ in texts[:400]]
    base = texts[3][1].split(" ")
    for i in range(60):  # near copies of one text
        w = list(base)
        w[rng.randrange(len(w))] = "zz%d" % (i % 20)
        rows.append((5000 + i, " ".join(w)))
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, texts[3][1])]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fp = np.array([simhash.fingerprint(t) for _, t in rows], np.int64).view(np.uint64)
    pairs = np.argwhere(np.triu(np.bitwise_count(fp[:, None] ^ fp[None]) <= 3, 1))
    want = union_find(len(rows), pairs)
    assert len(got) == len(rows)
    for i, (d, _) in enumerate(rows):
        assert got[d]["component_id"] == rows[want[i]][0]


@pytest.mark.parametrize("distance", [1, 3, 7])
def test_pigeonhole_finds_every_link(spark, distance):
    rng = np.random.default_rng(distance)
    seeds = rng.integers(-(2**63), 2**63, 300)
    near = [int(s) ^ int(sum(1 << int(b) for b in rng.choice(63, rng.integers(1, distance + 2), replace=False))) for s in seeds]
    values = sorted({int(x) for x in [*seeds, *near]})
    nodes = spark.createDataFrame([(v, v) for v in values], "fp long, node long")
    from evigraph.llm.components import connected_components

    got = {r["node"]: r["component"] for r in connected_components(simhash.links(nodes, distance)).collect()}
    fp = np.array(values, np.int64).view(np.uint64)
    pairs = np.argwhere(np.triu(np.bitwise_count(fp[:, None] ^ fp[None]) <= distance, 1))
    want = union_find(len(values), pairs)
    for i, v in enumerate(values):
        assert got.get(v, v) == values[want[i]]


def test_long_runs_lose_no_link(monkeypatch):
    monkeypatch.setattr(simhash, "LONG", 64)
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fp = np.concatenate([base, base ^ np.uint64(5), base ^ np.uint64(1 << 60)])
    key = np.zeros(len(fp), np.int64)
    ids = np.arange(len(fp))
    us, vs = simhash._links_in_runs(key, fp, [], ids, 3, 0)
    assert len(set(union_find(len(fp), zip(us, vs)))) == 40


def test_thresholds_follow_the_principle(spark):
    nodes = spark.createDataFrame([(int(x), int(x)) for x in np.random.default_rng(1).integers(-(2**62), 2**62, 500)], "fp long, node long")
    for d in (2, 3, 6):
        plan = simhash.choose_plan(nodes, d)
        assert sum(t + 1 for _, t in plan) >= d + 1
        bits = [b for part, _ in plan for b in part]
        assert len(set(bits)) == len(bits)


def test_keep_one_drops_copies_and_keeps_the_rest(spark, texts):
    rng = random.Random(2)
    rows = [(d, t, la, "s", 1) for d, t, la in texts[:150] if len(t.split()) > 60]
    first = {t: min(r[0] for r in rows if r[1] == t) for _, t, *_ in rows}
    near = []
    for d, t, la, *_ in rows[:30]:
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        near.append((10_000 + d, " ".join(w), la, "s", 1))
    docs = spark.createDataFrame(rows + near, "doc_id long, text string, lang string, source string, n_chars int")
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert not kept & {r[0] for r in near}
    shingle = lambda t: {tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    for d, t, *_ in rows:
        if d not in kept:  # a dropped one has a close neighbour that came before
            assert any(len(shingle(t) & shingle(u)) / len(shingle(t) | shingle(u)) > 0.5 for e, u, *_ in rows if e < d) or first[t] < d


def _edited(rng):
    """Texts of random words with appended, truncated and scattered edits, and their exact similarity."""
    rows, pairs = [], []
    jaccard = lambda a, b: len(a & b) / len(a | b)
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for i in range(90):
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 400))]
        share = rng.choice([0.72, 0.76, 0.79, 0.81, 0.84, 0.9])
        kind = ("appended", "truncated", "scattered")[i % 3]
        if kind == "appended":
            v = w + [f"x{rng.randrange(3000)}" for _ in range(round(len(w) * (1 / share - 1)))]
        elif kind == "truncated":
            v = w[: round(len(w) * share)]
        else:
            v = list(w)
            for at in range(3, len(w), max(5, round(5 * (1 + share) / (1 - share)))):
                v[at] = "changed"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
        pairs.append((2 * i + 1, jaccard(sets(w), sets(v))))
    return rows, pairs


def test_keep_one_finds_every_pair_of_the_similarity(spark):
    rows, pairs = _edited(random.Random(6))
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = [d for d, j in pairs if j >= 0.8]
    assert len(near) > 30 and not kept & set(near)


def test_keep_one_keeps_what_is_less_similar(spark):
    rows, pairs = _edited(random.Random(7))
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    apart = [d for d, j in pairs if j < 0.8]
    assert len(apart) > 30 and set(apart) <= kept and {d - 1 for d, _ in pairs} <= kept


def test_keep_one_probes_by_the_pigeonhole(spark, monkeypatch):
    """Near copies within three bits are found by fingerprints alone, and their pairs go nowhere else; what only looks near stays."""
    rng = random.Random(15)
    rows, near, apart = [], set(), set()
    while len(near) < 6 or len(apart) < 4:
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(150, 400))]
        if len(near) < 6:
            v, kind = [*w[:-1], "changed"], near
        else:
            v, kind = w[: round(len(w) * 0.78)], apart
        (a, c, _), (b, d, _) = (simhash.shingle_set(" ".join(x)) for x in (w, v))
        if ((c ^ d) & (1 << 64) - 1).bit_count() <= 3:
            alike = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            assert (alike >= 0.8) == (kind is near)
            kind.add(len(rows) + 1)
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(v))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {d for d, _ in rows} - near
    sent, verified = [], simhash._pairs_verified
    monkeypatch.setattr(simhash, "_pairs_verified", lambda docs, nodes, pairs, *rest: sent.append(pairs.count()) or verified(docs, nodes, pairs, *rest))
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == kept and sent == [0]
    monkeypatch.setattr(simhash, "_candidates", lambda nodes, _: spark.createDataFrame([], "u long, v long, dense long"))
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == kept


def test_pigeonholed_sets_of_one_fingerprint_are_linked(spark):
    from evigraph.llm.components import connected_components

    rows = [(0, 5), (1, 5), (2, 4), (3, -1), (4, 5), (5, -2), (6, 1 << 40)]
    found = connected_components(simhash._pigeonholed(spark.createDataFrame(rows, "node long, c1 long"), 3)).collect()
    assert {r["node"]: r["component"] for r in found} == {0: 0, 1: 0, 2: 0, 4: 0, 6: 0, 3: 3, 5: 3}


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    rows = []
    for i in range(40):
        w = list(base)
        w[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(simhash, "BLOCK", 6)
    assert [r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]


def test_forest_of_a_long_run_is_whole():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fp = base[np.minimum(rng.integers(0, 60, 1500), 29)]  # half of all rows near one fingerprint
    for _ in range(2):
        fp = fp ^ (np.uint64(1) << rng.integers(0, 63, len(fp)).astype(np.uint64))
    us, vs = simhash._forest(fp, [], np.arange(len(fp)), 3, 0)
    i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None]) <= 3)
    assert union_find(len(fp), zip(us, vs)) == union_find(len(fp), zip(i, j))


def test_long_keys_meet_in_pairs_of_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    fp = np.unique(np.uint64(7 << 40) ^ (np.uint64(1) << rng.integers(0, 30, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 30, 400).astype(np.uint64)))
    monkeypatch.setattr(simhash, "LONG", 25)
    nodes = spark.createDataFrame([(int(x), int(x)) for x in fp], "fp long, node long")
    from evigraph.llm.components import connected_components

    got = {r["node"]: r["component"] for r in connected_components(simhash.links(nodes, 2)).collect()}
    i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None]) <= 2)
    want = union_find(len(fp), zip(i, j))
    ids = {}
    for x, w in zip(fp, want):
        ids.setdefault(w, int(x))
    assert [got.get(int(x), int(x)) for x in fp] == [ids[w] for w in want]


def test_keep_one_goes_by_rows(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a, "p"), (1, a, "q"), (1, b, "r"), (None, c, "s"), (None, c, "t"), (None, a, "u"), (2, b, "v"), (3, None, "w"), (4, "", "x")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _text string")).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in got) == sorted(str(x) for x in [(1, a), (1, b), (None, c), (3, None)])


def test_large_groups_keep_their_classes(spark, monkeypatch):
    """Groups of candidates beyond a block hold several classes; those of brute force are found."""
    rng = random.Random(11)
    rows, shared = [], [f"s{i}" for i in range(60)]
    for k in range(6):
        own = shared + [f"{k}w{i}" for i in range(50)]
        for _ in range(9 if k else 25):
            t = list(own)
            for _ in range(rng.randint(0, 1)):
                t[rng.randrange(len(t))] = f"e{rng.random()}"
            rows.append((len(rows), " ".join(t)))
    sets = [set(simhash.shingle_set(t)[0].tolist()) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = union_find(len(rows), pairs)
    first = {}
    for i, w in enumerate(want):
        first.setdefault(w, i)
    monkeypatch.setattr(simhash, "BLOCK", 6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == sorted(first.values())


def test_chains_of_candidates_are_not_compared_in_whole(spark, monkeypatch):
    """Texts that share half of their shingles with the next form one long chain: the sets sent are in proportion to the texts."""
    rng = random.Random(12)
    words = [f"w{rng.randrange(10**6)}" for _ in range(30 * 200 + 70)]
    docs = spark.createDataFrame([(i, " ".join(words[30 * i : 30 * i + 100])) for i in range(200)], "doc_id long, text string")
    sent, compared = [], simhash._compared
    monkeypatch.setattr(simhash, "BLOCK", 6)
    monkeypatch.setattr(simhash, "_compared", lambda rows, *rest: sent.append(rows.count()) or compared(rows, *rest))
    assert simhash.keep_one(docs).count() == 200
    assert sum(sent) < 5 * 200


def test_keep_one_by_rounds_and_long_keys(spark, monkeypatch):
    rows, pairs = _edited(random.Random(13))
    near = {d for d, j in pairs if j >= 0.8}
    monkeypatch.setattr(simhash, "ROUND", 1500)
    monkeypatch.setattr(simhash, "LONG", 20)
    base = [f"b{i}" for i in range(120)]
    copies = [(1000 + i, " ".join(w if j != 3 * i else f"c{i}" for j, w in enumerate(base))) for i in range(40)]
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows + copies, "doc_id long, text string")).collect()}
    assert kept == {d for d, _ in rows} - near | {1000}


def test_keep_one_leaves_no_keys_or_sets_behind(spark):
    """The files of marks, nodes and sets go with their last reader, so they don't add to the disk of what follows."""
    from pathlib import Path

    from evigraph.llm.common import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.glob("*-*"))
    rows, _ = _edited(random.Random(14))
    simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {p.name.split("-")[0] for p in set(folder.glob("*-*")) - before if p.is_dir()} & {"marks", "nodes", "sets"} == set()


def test_gate_loses_next_to_nothing():
    """Chance that sets of a similarity of 0.8 differ in more bits than the gate, by enumeration over small sets."""
    from math import comb

    def half(n):
        return np.array([comb(n, k) for k in range(n + 1)], float) / 2.0**n

    worst = 0.0
    for both in range(4, 81):
        for a in range(0, both // 4 + 1):
            b = both // 4 - a
            common, pa, pb = half(both), half(a), half(b)
            k = np.arange(both + 1)
            up_a = sum(p * (2 * (k + i) > both + a) for i, p in enumerate(pa))
            up_b = sum(p * (2 * (k + i) > both + b) for i, p in enumerate(pb))
            worst = max(worst, float((common * (up_a * (1 - up_b) + up_b * (1 - up_a))).sum()))
    assert sum(comb(128, k) * worst**k * (1 - worst) ** (128 - k) for k in range(simhash.GATE + 1, 129)) < 1e-3


# ---------------------------------------------------------------- lines, mixing: the SQL on small tables


def compare(spark, frame, sql, docs):
    got = sorted(map(tuple, frame.collect()), key=str)
    rows, names = duck(sql, documents=docs.toPandas())
    at = [names.index(c) for c in frame.columns]
    assert got == sorted((tuple(r[i] for i in at) for r in rows), key=str)


def test_line_chunks_equal_sql(spark, texts):
    shared = "word " * 60
    rows = [(d, t) for d, t, _ in texts[:120]] + [(2000 + i, f"a{i}\n{shared}\nb{i}") for i in range(5)]
    rows += [(3000, None), (3001, ""), (3002, "\n\n"), (3003, texts[5][1]), (3004, "x\n" * 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    done = linededup.dedup_lines(docs)
    out = done.select("doc_id", "n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
    compare(spark, out, linededup.SQL, docs)
    kept = {r["doc_id"]: r["text"] for r in done.collect()}
    assert kept[2000] == f"a0\n{shared}\nb0" and all(kept[2000 + i] == f"a{i}\nb{i}" for i in range(1, 5))
    pair = spark.createDataFrame([(1, shared), (2, shared), (3, None), (4, "")], "doc_id long, text string")
    assert {r["doc_id"] for r in linededup.drop_repeats(pair).collect()} == {1, 3, 4}


def test_boundaries_resist_shifts(spark):
    rng = random.Random(4)
    body = [f"line {rng.random()} words here" for _ in range(40)]
    docs = spark.createDataFrame([(1, "\n".join(body)), (2, "\n".join(["new one", "and two", *body, "tail"]))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in linededup.dedup_lines(docs).collect()}
    assert got[1]["n_removed_lines"] == 0 and got[2]["n_removed_lines"] > 25


def test_mix_equals_sql_and_keeps_its_bounds(spark, texts):
    rng = random.Random(6)
    rows = [(d, t, rng.choice(["a", "b", "b", "b", None, "z"])) for d, t, _ in texts[:300]] + [(900_001, None, "a"), (900_002, "", None), (900_003, "one", "solo")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    frame = mixing.taken(docs)
    compare(spark, frame, mixing.SQL, docs)
    got = frame.collect()
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    by = Counter()
    for r, s in zip(sorted(got, key=lambda r: r["doc_id"]), [x[2] for x in sorted(rows)]):
        by[s] += r["taken"]
    targets = {s: t for s, t in {(x[2], next(r["target"] for r in got if r["doc_id"] == x[0])) for x in rows}}
    for s, t in targets.items():
        assert abs(by[s] - t) <= 1
    total = sum(r["size"] for r in got)
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6 * total


def test_schedule_is_spread(spark, texts):
    docs = spark.createDataFrame([(d, t, "a" if d % 3 else "b") for d, t, _ in texts[:200]], "doc_id long, text string, source string")
    _, targets, used = mixing.mix(docs)
    slots = used.select("slot", "s").distinct().orderBy("slot").collect()
    share = sum(r["s"] == 0 for r in slots) / len(slots)
    for n in (100, len(slots) // 2):
        assert abs(sum(r["s"] == 0 for r in slots[:n]) / n - share) < 0.05
    assert used.groupBy("slot", "s").count().count() == len(slots)


# ---------------------------------------------------------------- learned operators


def test_languages_are_learned(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op5_bigru_language(spark, SF).collect()}
    held = [(d, la) for d, _, la in texts if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(got[d]["held_out"] for d, _ in held)
    assert sum(got[d]["lang_pred"] == la for d, la in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    model = langid.fit(docs.where(~langid.held_out(docs)), steps=20)
    preds, scores = langid.predict(model, [None, "", "123 !", "le de que"])
    assert preds[:3] == ["und"] * 3 and scores[:3] == [0.0] * 3 and preds[3] in model["names"]


def test_gru_gradients_match_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in langid._init(rng, 2).items()}
    ids = rng.integers(0, 256, (6, 4))
    weight = rng.normal(size=(6, 4, langid.HIDDEN))
    loss = lambda: float((langid._run(p["xf"], p["uf"], ids)[0] * weight).sum())
    _, kept = langid._run(p["xf"], p["uf"], ids)
    gx, gu = langid._back(p["xf"], p["uf"], ids, kept, weight)
    for array, grad, at in ((p["uf"], gu, (1, 3)), (p["uf"], gu, (0, 20)), (p["xf"], gx, (int(ids[2, 1]), 5)), (p["xf"], gx, (int(ids[0, 0]), 18))):
        e, old = 1e-3, array[at]
        array[at] = old + e
        a = loss()
        array[at] = old - e
        b = loss()
        array[at] = old
        assert abs((a - b) / (2 * e) - grad[at]) < 2e-2 * max(1, abs(grad[at]))


def test_whole_text_counts_towards_a_language(texts):
    rows = [(t, la) for _, t, la in texts if len(t) > 500][:200]
    model = langid.train([t[:300] for t, _ in rows], [la for _, la in rows], steps=120)
    short, long = ["le de que un " * 4, "le de que un " * 4 + "the of and that with " * 400], ["fr", "en"]
    assert langid.predict(model, short)[0] == long


def test_quality_on_held_out_labels(spark):
    got = queries.op2_bradley_terry(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.93
    assert all((r["score"] >= 0.3) == (r["predicted"] == 1) for r in got)


def test_base_patterns_equal_plain_regular_expressions():
    rules = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def plain(t):
        out = []
        for k, rule in enumerate(rules):
            for m in re.finditer(rule, t):
                d = re.sub("[^0-9]", "", m[0])
                ok = (True, all(int(p) <= 255 for p in m[0].split(".")) if k == 1 else 0, 13 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15)[k]
                if ok:
                    out.append((k, *m.span()))
        return out

    rng = random.Random(8)
    for _ in range(5000):
        t = "".join(rng.choice(rng.choice(["ab@.", "01259 -", "+(). 1", "a.b@c-d.e", ".@@..x", "4111 1111"])) for _ in range(rng.randint(0, 45)))
        assert plain(t) == pii.base_spans(t)
    assert pii.base_spans("1" * 100_000) == []


def test_field_adds_what_patterns_miss():
    field = pii.train()
    cases = {
        "Call me at (415) 555-0134 tomorrow": "phone", "write to amy at post dot example dot com now": "email",
        "from 10[.]1[.]2[.]3 it came": "ip", "card 4111.1111.1111.1111 was used": "card",
    }
    for text, kind in cases.items():
        got = pii.added_spans(field, [text], [pii.base_spans(text)])[0]
        assert [pii.KINDS[k] for k, _, _ in got] == [kind], text
    clean = ["In 2021 there were 14 of 250 left.", "The dot is at the end.", "", "v1.2.3.4567 at 12:30", "a " * 20_000]
    assert pii.added_spans(field, clean, [[] for _ in clean]) == [[] for _ in clean]


def test_viterbi_equals_enumeration():
    import itertools

    field = pii.train(steps=30)
    rng = np.random.default_rng(1)
    stretches = [rng.normal(size=(n, len(pii.LABELS))) * 3 for n in (1, 2, 4, 3)]
    move = field.moves()

    def value(e, path):
        return move[path[-1], 0] + move[len(pii.LABELS), path[0]] + e[0, path[0]] + sum(move[a, b] + e[i + 1, b] for i, (a, b) in enumerate(zip(path, path[1:])))

    for e, got in zip(stretches, field.decode(stretches)):
        best = max(itertools.product(range(len(pii.LABELS)), repeat=len(e)), key=lambda p: value(e, p))
        assert tuple(got) == best


# ---------------------------------------------------------------- vectors and fingerprints


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 32))
    rows = []
    for i in range(1200):
        v = centres[i % 60] + rng.normal(size=32) * rng.choice([0.02, 0.06, 0.5])
        rows.append((i, [float(x) for x in v], i % 3))
    rows += [(2000 + i, rows[7][1], 1) for i in range(40)]
    rows += [(3000, None, 1), (3001, [0.0] * 32, 1), (3002, [float("nan")] * 32, 1), (3003, [None] * 32, 1), (3004, rows[7][1], None), (3005, [], 2), (3006, [2 * x for x in rows[7][1]], 1)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in pivots.near_vectors(docs).collect()}
    ok = [r for r in rows if r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1]) and r[2] is not None]
    x = np.array([r[1] for r in ok])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in ok])
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    links = near.sum(1)
    assert len(got) == len(rows)
    assert sum(got[r[0]]["n_links"] for r in ok) >= 0.9 * links.sum()
    assert all(got[r[0]]["n_links"] <= n for r, n in zip(ok, links))
    for v in (3000, 3001, 3002, 3003, 3004, 3005):
        assert got[v]["n_links"] == 0 and got[v]["component_id"] == v and got[v]["kept"]
    assert got[2000]["n_links"] == got[2001]["n_links"] >= 40 and got[3006]["component_id"] == got[7]["component_id"]


@pytest.mark.parametrize("spread", [0.05, 0.14])
@pytest.mark.parametrize("pivot_count", [256, 1024])
def test_a_large_group_keeps_its_links(spark, monkeypatch, pivot_count, spread):
    """A third of all vectors in one tight group, at as many pivots as a small and a large table have."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(2000, 64)), rng.normal(size=64) + spread * rng.normal(size=(1000, 64))])
    monkeypatch.setattr(pivots, "pivots_for", lambda n: pivot_count)
    docs = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = (x @ x.T >= 0.98).sum() - len(x)
    assert 0.99 * links <= sum(r["n_links"] for r in pivots.near_vectors(docs).collect()) <= links


def test_long_lists_are_cut_exactly(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in 1 + rng.normal(size=16) * 0.05], 0) for i in range(150)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    whole = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pivots.near_vectors(docs).collect()}
    monkeypatch.setattr(pivots, "LIST", 20)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pivots.near_vectors(docs).collect()} == whole


def test_collisions_estimate_generalised_jaccard(texts):
    errors = []
    for (_, a, _), (_, b, _) in zip(texts[:60], texts[1:61]):
        c = cws.edited(a, b)
        s = cws.signatures([a, c])
        x, y = Counter(cws._terms(a)), Counter(cws._terms(c))
        exact = sum((x & y).values()) / max(1, sum((x | y).values()))
        errors.append(float(cws.likeness(s[0], s[1])) - exact)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07


def test_next_documents_by_descending_id(spark, texts):
    rng = random.Random(9)
    rows = [(d * 7 + 1, t) for d, t, _ in texts[:300]] + [(-5, None), (10_001, ""), (10_002, "é" * 7)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in cws.map_arrow(docs, lambda b: b, "doc_id long, text string").transform(cws.fingerprints).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for (d, t), (_, u) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        n = len(t) // 3
        assert got[d]["edited_sha256"] == hashlib.sha256((t[: len(t) - n] + u[:n]).encode()).hexdigest()
        assert got[d]["n_chars"] == len(t)
    same = {}
    for d, t in rows:
        assert same.setdefault(t or "", got[d]["fingerprint"]) == got[d]["fingerprint"]
