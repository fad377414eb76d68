"""Text of files and pages as chunks; all in column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIMITS = {"input_bytes": 50 << 20, "text_bytes": 10 << 20, "rows": 100_000, "cells": 1_000_000, "chunks": 10_000, "chunk_chars": 4_096}
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"))


def html_text(column) -> F.Column:
    """Text of HTML: scripts and styles go with their content, tags become spaces, four entities are read, spaces are joined."""
    c = F.regexp_replace(column, "(?is)<(script|style)\\b.*?</\\1\\s*>", " ")
    c = F.regexp_replace(c, "(?s)<[^>]*>", " ")
    for name, text in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(text))
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def csv_text(column) -> F.Column:
    """Cells joined by spaces, rows by line feeds; quoted cells keep their commas, no header."""
    rows = F.split(column, "\r?\n")
    one = lambda r: F.array_join(F.transform(F.regexp_extract_all(r, F.lit('(?:^|,)("(?:[^"]|"")*"|[^,]*)'), F.lit(1)), lambda x: F.regexp_replace(F.regexp_replace(x, '^"|"$', ""), '""', '"')), " ")
    return F.array_join(F.transform(F.filter(rows, lambda r: r != ""), one), "\n")


def chunks(docs: DataFrame, text: str, key: str, size: int = LIMITS["chunk_chars"]) -> DataFrame:
    """(key, ordinal, chunk): white space joined, then windows of ``size`` characters; empty texts have none."""
    clean = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\\s+", " "))
    rows = docs.select(key, clean.alias("_t")).where(F.length("_t") > 0)
    numbered = rows.withColumn("ordinal", F.explode(F.sequence(F.lit(0), F.floor((F.length("_t") - 1) / size).cast("int"))))
    return numbered.select(key, "ordinal", F.substring("_t", F.col("ordinal") * size + 1, F.lit(size)).alias("chunk"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of UTF-8 files, one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, digest, text, failure) of files by ending; text is null where something failed."""
    raw = spark.read.format("binaryFile").load(path).select("path", "length", "content", F.lower(F.substring_index("path", ".", -1)).alias("kind"))
    text = F.try_validate_utf8(F.col("content"))
    failure = (
        F.when(F.col("length") > LIMITS["input_bytes"], "too_large").when(~F.col("kind").isin("txt", "md", "csv", "html", "htm"), "unsupported")
        .when(text.isNull(), "not_utf8")
    )
    body = F.when(F.col("kind").isin("html", "htm"), html_text(text)).when(F.col("kind") == "csv", csv_text(text)).otherwise(text)
    return raw.select("path", "kind", F.sha2("content", 256).alias("digest"), F.when(failure.isNull(), body).alias("text"), failure.alias("failure"))
