"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, clashing extra columns."""

import pytest
from pyspark.sql import functions as F

from evigraph.llm import bpe, cws, langid, linededup, mixing, pii, pivots, quality, queries, simhash, tokenfile

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, "Some words of the text\nand more of it here", "en", "a", 10), (1, "Some words of the text\nand more of it here", "en", "a", 10),
    (2, None, "en", "a", None), (3, "", None, None, 0), (None, "le mot de la fin", "fr", "b", 3), (None, None, None, None, None),
    (4, "x" * 200_000, "en", "a", 1), (5, "ab cd " * 30_000, "fr", None, 1), (6, "\n \t\n", "fr", "b", 1), (7, "😀 é漢字 +1 555 0100 a@b.co", "fr", "b", 1),
    (1, "another text of the same id", "fr", "b", 2),
]
EXTRA = ["fp", "score", "size", "_row", "_lines", "_chunks", "removed", "key", "lang_pred", "_time", "name", "times", "node", "component", "aside_0", "pid", "role", "n_lines"]

OPERATORS = {
    "pii": pii.find,
    "quality": lambda d: quality.score(d, None),
    "tokens": lambda d: tokenfile.round_trip(d, queries.tokenizer_path()),
    "mix": mixing.taken,
    "mixed": mixing.mixed,
    "language": lambda d: langid.accepted(d, steps=3),
    "fingerprints": cws.fingerprints,
    "bpe": lambda d: bpe.encode_digests(d, queries.tokenizer_path()),
    "encode": lambda d: bpe.encode_documents(d, queries.tokenizer_path()),
    "lines": linededup.dedup_lines,
    "drop_repeats": linededup.drop_repeats,
    "simhash": simhash.near_duplicates,
    "keep_one": simhash.keep_one,
}
ROW_FOR_ROW = ("pii", "quality", "tokens", "mix", "fingerprints", "bpe", "encode", "lines", "simhash")
STAGES = ("mixed", "language", "drop_repeats", "keep_one")


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    docs = spark.createDataFrame(ROWS, DOCS).repartition(3)
    got = OPERATORS[name](docs).collect()
    if name in ROW_FOR_ROW:
        assert len(got) == len(ROWS)
        assert sum(r["doc_id"] is None for r in got) == 2
    # equal rows end up alike
    if name in ("pii", "quality", "bpe", "encode", "simhash"):
        assert len({str(r) for r in got if r["doc_id"] == 1}) <= 2


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(spark, name):
    docs = spark.createDataFrame([r for r in ROWS if r[0] != 4], DOCS)
    for c in EXTRA:
        docs = docs.withColumn(c, F.lit("other"))
    got = OPERATORS[name](docs)
    rows = got.collect()
    if name in STAGES:
        assert got.columns == docs.columns
        assert all(r["name"] == "other" for r in rows)
    elif name in ROW_FOR_ROW:
        assert len(rows) == len(ROWS) - 1


def test_odd_labels(spark):
    docs = spark.createDataFrame([(i, ("Good text here. " * 5) if i % 2 else "BAD!! BAD!! " * 9) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None), (5, 1), (999, 0)], "doc_id long, quality int")
    ranker = quality.learn(docs, labels)
    got = {r["doc_id"]: r["predicted"] for r in quality.score(docs, ranker).collect()}
    assert all(got[i] == i % 2 for i in range(40))
    assert quality.learn(docs, labels.where("quality = 1")) is None


def test_odd_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert pivots.near_vectors(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [1.0, 0.0, 0.0], 1), (3, [-1.0, 0.0], 1)]
    got = pivots.near_vectors(spark.createDataFrame(rows, schema).withColumn("g", F.lit(1))).collect()
    assert sorted(r["n_links"] for r in got) == [0, 0, 2, 2, 2]


def test_pipeline_stages_follow_one_another(spark, tmp_path):
    """Each stage of the pipeline on its predecessor's rows, with the columns of documents."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        path = str(tmp_path / name)
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        if name != "encode":
            assert docs.columns == columns
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    want = sorted((r["doc_id"], tok.encode(r["text"], add_special_tokens=False).ids) for r in before.collect())
    assert sorted((r["doc_id"], r["ids"]) for r in docs.collect()) == want
