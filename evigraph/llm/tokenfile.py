"""Token ids as Parquet list columns (operator 3).

One row a document, in ascending doc_id order over and within files (nulls first): its
number of ids, the ids before it in its file, and its ids as a list column.  ``doc_id`` and
the counts are delta-encoded (format version 2), ids are dictionary-encoded, row groups and
pages are small and carry page indexes, so a reader of some documents' ids or of the counts
alone skips the rest.

Texts are put in order (one shuffle of texts by range, no task holds more than its range)
before they are encoded, so what is encoded is written straight to its file.  A text's
pieces between white space are remembered per worker, in bounded memory; no
token crosses such a place.  A file's first start comes from the files' own totals.

A null or empty text has the end id alone.  Rows that repeat an id follow one another,
by text.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Pieces, cut_pieces, read_spec
from .common import map_arrow, new_path, slices, worker_cache

#: Pieces remembered by a worker, twice: some 200 bytes each.
ROOM = 500_000

OPTIONS = {
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "compression": "zstd",
}


def _pieces(spec: str, key: str = "tokenfile") -> Pieces:
    kept = worker_cache(key)
    mark = hash(spec)
    if kept.get("mark") != mark:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(spec)
        tok.no_truncation()
        tok.no_padding()

        def ids(text):
            return array("i", tok.encode(text, add_special_tokens=False).ids).tobytes()

        kept["pieces"], kept["mark"] = Pieces(ids, ids, bytes.__add__, ROOM), mark
    return kept["pieces"]


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1) -> None:
    """Encode ``docs(doc_id, text)`` and write the files to the folder ``path``."""
    shared = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))
    end = np.array([end_id], "<i4").tobytes()

    def run(batches):
        known = _pieces(shared.value)
        get = known.__getitem__
        before = 0
        for whole in batches:
            for b in slices(whole, 1000, 2 << 20):
                rows = []
                for text in b.column("text").to_pylist():
                    rows.append(b"".join([*map(get, cut_pieces(text)), end]) if text else end)
                counts = np.array([len(r) // 4 for r in rows], np.int64)
                ends = np.cumsum(counts)
                ids = pa.ListArray.from_arrays(
                    pa.array(np.append(0, ends).astype(np.int32)), pa.array(np.frombuffer(b"".join(rows), "<i4"))
                )
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").cast(pa.int64()), pa.array(counts), pa.array(before + ends - counts), ids],
                    names=["doc_id", "n_tokens", "before", "ids"],
                )
                before += int(ends[-1])

    # the hash parts rows that share an id; a file a task, whatever the session's limit, since ``before`` counts by task
    rows = docs.select("doc_id", "text").withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    encoded = map_arrow(ordered, run, "doc_id long, n_tokens long, before long, ids array<int>")
    encoded.write.options(**OPTIONS).option("maxRecordsPerFile", 0).parquet(path)


def documents(spark: SparkSession, path: str, columns: list[str] | None = None, where=None) -> DataFrame:
    """Rows of the files; only the columns named are read, and ``where`` (on doc_id, say) skips row groups and pages."""
    rows = spark.read.schema("doc_id long, n_tokens long, before long, ids array<int>").parquet(path)
    rows = rows.where(where) if where is not None else rows
    return rows.select(*columns) if columns else rows


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """(file, base): ids in all files before each file, from the counts alone; one row a file."""
    per = (
        documents(spark, path).select("doc_id", "n_tokens", F.col("_metadata.file_path").alias("file"))
        .groupBy("file").agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("nulls"), F.sum("n_tokens").alias("n"))
    )
    order = Window.orderBy(F.col("nulls").desc(), F.col("least").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("file", F.coalesce(F.sum("n").over(order), F.lit(0)).cast("long").alias("base"))


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens), without reading ids."""
    rows = documents(spark, path).select("doc_id", "n_tokens", "before", F.col("_metadata.file_path").alias("file"))
    return rows.join(file_starts(spark, path), "file").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens")


def checked(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, read back from the files."""

    def run(batches):
        for b in batches:
            ids = b.column("ids")
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            at = ids.offsets.to_numpy()
            raw, edge = memoryview(np.ascontiguousarray(flat)).cast("B"), (at * 4).tolist()
            crc = [zlib.crc32(raw[a:z]) for a, z in zip(edge, edge[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("before"), b.column("file"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["doc_id", "before", "file", "n_tokens", "ids_crc32"],
            )

    rows = documents(spark, path).select("doc_id", "before", "ids", F.col("_metadata.file_path").alias("file"))
    read = map_arrow(rows, run, "doc_id long, before long, file string, n_tokens long, ids_crc32 long")
    return read.join(file_starts(spark, path), "file").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write(docs, tokenizer, path, end_id)
    return checked(spark, path)
