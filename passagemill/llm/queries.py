"""Queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, exact, langid, mixing, omh, packing, prefix_counts, sequences, sharding, wrapper


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as Arrow files of token sequences."""
    return sequences.token_files(_documents(spark, sf_dir))


def op2_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content of every page, by its host's wrapper."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return wrapper.extract(pages, wrapper.induce(pages))


def op3_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their shards, laid out by shard."""
    return sharding.shard(_documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies: each document to drop, and the one that stays."""
    return exact.exact_duplicates(_documents(spark, sf_dir))


def op5_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest neighbours, among all vectors, of every vector whose id is divisible by 50."""
    return ann.nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates: each document to drop, and the one that stays."""
    return omh.near_duplicates(_documents(spark, sf_dir))


def op7_water_fill_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus mixed to the target weights."""
    return mixing.mix(_documents(spark, sf_dir))


def op8_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token count of every prefix of every document."""
    return prefix_counts.prefix_counts(_documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = _documents(spark, sf_dir)
    return langid.identify(docs, langid.fit(docs))


def op10_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in its sequence."""
    return packing.pack(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q for q in (op1_token_files, op2_wrapper_induction, op3_extendible_sharding, op4_exact_dedup, op5_dimension_scan, op6_order_minhash, op7_water_fill_mix, op8_prefix_counts, op9_language_id, op10_pattern_packing)
}

ORACLES: dict[str, str] = {
    "op3_extendible_sharding": sharding.ORACLE_SQL.format(limit=sharding.SHARD_BYTES),
    "op4_exact_dedup": exact.ORACLE_SQL,
    "op7_water_fill_mix": mixing.ORACLE_SQL,
}
