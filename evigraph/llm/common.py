"""Shared helpers: storage that all executors see, Arrow maps, worker caches."""

from __future__ import annotations

import gc
import sys
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all nodes share: ``spark.checkpoint.dir``, or the checkpoint folder that was set.

    Where neither is set a folder beside the warehouse is taken, which a cluster's nodes share as well.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named is None:
        named = sc.getCheckpointDir()
    if named is None:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there on; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, shared by the tasks it runs."""
    keep = sys.modules.setdefault("_evigraph_worker_cache", types.ModuleType("_evigraph_worker_cache"))
    return keep.__dict__.setdefault(name, {})


def hash_share(column: str, salt: int = 0):
    """A reproducible number in [0, 1) for each value of a column."""
    return (F.xxhash64(F.lit(salt), F.col(column)).bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))


def slices(batch: pa.RecordBatch, rows: int, chars: int, column: str = "text"):
    """Cut a batch into pieces of bounded rows and text bytes (one row at least), so memory doesn't follow batch size."""
    if batch.num_rows == 0:
        return
    col = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = int(np.searchsorted(ends, base + chars, side="right"))
        stop = min(max(stop, start + 1), start + rows, batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def map_arrow(df: DataFrame, function, schema, batch: int | None = None) -> DataFrame:
    """``mapInArrow``; the import keeps pyarrow.compute loaded on workers.

    With ``batch`` the session's limit of records a batch is lowered to it, where whole rows of long texts pass both sides.
    """
    conf, limit = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if batch is not None and not 0 < int(conf.get(limit)) <= batch:
        conf.set(limit, batch)

    def run(batches):
        import pyarrow.compute  # noqa: F401

        yield from function(batches)

    return df.mapInArrow(run, schema)


def crc_bucket(column: str, parts: int):
    """crc32 of the decimal text of an id, modulo ``parts``; null ids count as the text ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def aside(docs: DataFrame, *used: str) -> tuple[DataFrame, list]:
    """``docs`` with every column but ``used`` renamed out of the way of working columns, and the columns that undo it."""
    names = {c: c if c in used else f"aside_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(n).alias(c) for c, n in names.items()]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it from there on."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that ``stored`` wrote and nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    swept(spark)


def swept(spark: SparkSession) -> None:
    """Let Spark delete shuffle files and checkpoints that nothing refers to; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def block_pairs(rows: DataFrame, keys: list[str], limit, by: str) -> DataFrame:
    """Adds (i, j, side) for comparing the rows of equal ``keys`` within one task.

    Keys of at most ``limit`` rows stay whole: (0, 0, 0).  The rows of a larger one are dealt to blocks by a hash of
    ``by`` and every pair of blocks i <= j becomes a key of its own, so that each pair of rows still meets; where
    i < j, ``side`` tells the two blocks apart and pairs of one side belong to another key.
    """
    limit = F.lit(limit) if isinstance(limit, int) else limit
    sizes = (
        rows.withColumn("limit", limit).groupBy(*keys).agg(F.count("*").alias("n"), F.max("limit").alias("limit")).where("n > limit")
        .select(*[F.col(k).alias(f"long_{k}") for k in keys], F.ceil(F.col("n") / F.col("limit")).cast("int").alias("blocks"))
    )
    sizes = cut(sizes)
    if sizes.isEmpty():
        return rows.select("*", *[F.lit(0).alias(c) for c in ("i", "j", "side")])
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"long_{k}"))
        same = one if same is None else same & one
    return (
        rows.join(sizes, same, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64(by, F.lit(3)), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
        .withColumn("side", F.when(F.col("own") == F.col("i"), 0).otherwise(1))
        .drop("own", "other", "blocks", *[f"long_{k}" for k in keys])
    )
