"""Registered queries of the pipeline operators, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm import compression, cotrain, hilbert, hyperminhash, licenses, linespread, media, mixing, packing, sql, suffix


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.suffix_dedup(spark, _docs(spark, sf_dir))


def op2_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(spark, _docs(spark, sf_dir), k=3, percent=85).drop("text_tag")


def op3_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.compression_rules(_docs(spark, sf_dir))


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.hilbert_shards(spark, _docs(spark, sf_dir))


def op5_signature_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(media.store(_docs(spark, sf_dir)))


def op6_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(spark, _docs(spark, sf_dir))


def op7_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.classify(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linespread.strip_boilerplate(spark, _docs(spark, sf_dir))
    text = F.coalesce("text", F.lit(""))
    return found.select("doc_id", F.col(linespread.N_LINES).cast("long").alias("n_lines"), F.col(linespread.N_REMOVED).cast("long").alias("n_removed"), F.octet_length(text).cast("long").alias("kept_bytes"), F.md5(text.cast("binary")).alias("kept_md5"))


def op9_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, _docs(spark, sf_dir))


def op10_block_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, _docs(spark, sf_dir)).drop("text_tag")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_hyperminhash": op2_hyperminhash,
    "op3_compression_bands": op3_compression_bands,
    "op4_hilbert_shards": op4_hilbert_shards,
    "op5_signature_sniffing": op5_signature_sniffing,
    "op6_license_join": op6_license_join,
    "op7_cotraining": op7_cotraining,
    "op8_site_spread": op8_site_spread,
    "op9_linear_grouping": op9_linear_grouping,
    "op10_block_mixing": op10_block_mixing,
}
ORACLES: dict[str, str] = {
    "op6_license_join": sql.license_join(),
    "op8_site_spread": sql.SITE_SPREAD,
}
