"""Queries over the corpus tables, one for each operator of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linededup, mixing
from .common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data: base spans of the patterns and spans that the conditional random field adds."""
    from .pii import find

    return find(table(spark, sf_dir, "documents"))


def op2_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document from preference pairs of labelled ones."""
    from .quality import held_out, learn, score

    docs = table(spark, sf_dir, "documents")
    ranker = learn(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, ranker).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written as Parquet list columns and read back."""
    from .tokenfile import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_golden_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of each document by a golden-ratio schedule of equal blocks."""
    from .mixing import taken

    return taken(table(spark, sf_dir, "documents"))


def op5_bigru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document by a bidirectional GRU over bytes."""
    from .langid import fit, held_out, identify

    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(docs)))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(docs).alias("held_out"), "lang_pred", "score")


def op6_pivot_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors linked by a cosine of 0.98 or more within a label, and their groups."""
    from .pivots import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op7_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consistent weighted samples of each text, of its edited text, and their likeness."""
    from .cws import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op8_bpe_prefix_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact BPE ids and their decoding, as digests."""
    from .bpe import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines removed; counts and a digest of what each document keeps."""
    from .linededup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op10_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit SimHash of three-word shingles and the groups linked within three bits."""
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), words=3, distance=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {
    "op1_crf_pii": op1_crf_pii,
    "op2_bradley_terry": op2_bradley_terry,
    "op3_token_files": op3_token_files,
    "op4_golden_mix": op4_golden_mix,
    "op5_bigru_language": op5_bigru_language,
    "op6_pivot_permutations": op6_pivot_permutations,
    "op7_weighted_sampling": op7_weighted_sampling,
    "op8_bpe_prefix_dp": op8_bpe_prefix_dp,
    "op9_line_chunks": op9_line_chunks,
    "op10_simhash_pigeonhole": op10_simhash_pigeonhole,
}

ORACLES: dict[str, str] = {
    "op4_golden_mix": mixing.SQL,
    "op9_line_chunks": linededup.SQL,
}
