"""Whole tables: jobs that no limit for single requests may stop, and steps that no single task may carry."""

import pytest

from evigraph import catalog
from evigraph.operators import mutate as mu
from evigraph.operators import textindex as ti
from evigraph.operators.search import terms_of

from test_catalog import duck, test_query as as_in_sql  # noqa: F401


@pytest.mark.parametrize("name", ["dm_create", "dm_merge", "dm_set_remove", "dm_delete", "st_versions"])
def test_changes_of_whole_tables(spark, duck, monkeypatch, name):  # noqa: F811
    """The limit of a request's changes stops no job over a table."""
    monkeypatch.setattr(mu, "MAX_MUTATIONS", 1)
    as_in_sql(spark, duck, name)


def test_numbers_over_ranges(spark):
    """Numbers go on from range to range, in the order of the whole, and stay the same at every use."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(1000).selectExpr("concat('node--', id) as src", "id % 7 as other")
        frame = mu.numbered(rows, "src")
        got = [tuple(r) for r in frame.collect()]
        assert sorted(got, key=lambda r: r[2]) == [(s, o, n) for n, (s, o) in enumerate(sorted((f"node--{i}", i % 7) for i in range(1000)), 1)]
        assert sorted(tuple(r) for r in frame.collect()) == sorted(got)
        assert frame.rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def scans(spark, rows: int) -> list:
    """Records handed to a shuffle by each stage so far that read so many rows of files."""
    sc = spark.sparkContext
    jvm, none = sc._jvm, sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
    found = [stages.apply(i) for i in range(stages.size())]
    return [s.shuffleWriteRecords() for s in found if s.inputRecords() == rows]


def test_index_deals_documents_not_words(spark, tmp_path):
    """One file of one row group: its documents are dealt to all tasks before their words are handled, none by the task that reads them."""
    words = [f"w{i:03d}" for i in range(40)]
    docs = [(i, " ".join(words[(i * k) % 40] for k in range(1, 60))) for i in range(311)]
    spark.createDataFrame(docs, "id long, text string").coalesce(1).write.parquet(str(tmp_path / "docs"))
    index = ti.TextIndex(spark, str(tmp_path / "index"))
    index.rebuild(spark.read.parquet(str(tmp_path / "docs")), ["text"])
    assert max(scans(spark, 311)) == 311
    df = {r["term"]: r["df"] for r in index.table("terms").collect()}
    assert df == {w: sum(w in t.split() for _, t in docs) for w in words if any(w in t.split() for _, t in docs)}


@pytest.mark.parametrize("fields", [["text"], ["title", "text"]])
def test_index_by_plain_computation(spark, tmp_path, monkeypatch, fields):
    """Postings, terms and statistics of odd documents, in slices of a few words and partitions of a few bytes."""
    monkeypatch.setattr(ti, "WORDS", 3)
    monkeypatch.setattr(ti, "PART_BYTES", 100)
    docs = [("a", "The End", "b c-d the THE end of the end"), ("b", None, ""), ("c", "", None), ("d", "x yy", "--"), ("e", "Ünï zz", "zz zz 日本 zz ünï"), *[(f"f{i}", f"t{i}", f"zz w{i} w{i}") for i in range(60)]]
    spark.createDataFrame(docs, "id string, title string, text string").write.parquet(str(tmp_path / "docs"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    index = ti.TextIndex(spark, str(tmp_path / "index"))
    index.rebuild(spark.read.parquet(str(tmp_path / "docs")), fields)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    want, lengths = set(), []
    for key, *texts in docs:
        of = {f: terms_of(t or "") for f, t in zip(("title", "text"), texts) if f in fields}
        lengths.append(sum(map(len, of.values())))
        want |= {(w, key, f, ws.count(w), lengths[-1], tuple(i for i, x in enumerate(ws) if x == w)) for f, ws in of.items() for w in ws}
    rows = index.table("postings")
    assert dict(rows.dtypes) == {"term": "string", "doc": "string", "field": "string", "tf": "int", "length": "bigint", "pos": "array<int>"}
    got = [(r["term"], r["doc"], r["field"], r["tf"], r["length"], tuple(r["pos"])) for r in rows.collect()]
    assert len(got) == len(want) and set(got) == want
    assert {(r["term"], r["df"]) for r in index.table("terms").collect()} == {(t, len({d for w, d, *_ in want if w == t})) for t in {w[0] for w in want}}
    stats = index.table("stats").first()
    assert stats["docs"] == len(docs) and abs(stats["mean"] - sum(lengths) / len(docs)) < 1e-12


def test_index_of_nothing(spark, tmp_path):
    index = ti.TextIndex(spark, str(tmp_path / "index"))
    index.rebuild(spark.createDataFrame([], "id string, text string"), ["text"])
    assert tuple(index.table("stats").first()) == (0, None) and index.bm25(["aa"]).count() == 0


def test_index_of_a_table_in_another_store(spark, tmp_path):
    """The documents may be where only Spark reads, and not in the store of the index."""
    spark.createDataFrame([(1, "one two"), (2, "two")], "id long, text string").write.parquet(str(tmp_path / "docs"))
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.elsewhere.link./in", f"file://{tmp_path}")
    index = ti.of_table(spark, str(tmp_path / "shared"), "viewfs://elsewhere/in/docs", ["text"], "id")
    assert {(r["term"], r["df"]) for r in index.table("terms").collect()} == {("one", 1), ("two", 2)}
