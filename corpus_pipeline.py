"""The corpus pipeline: five stages over the documents table, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagemill.llm import exact, langid, mixing, omh, packing
from passagemill.llm._common import cut
from passagemill.runtime import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels cover stay, with the language found in lang; the others go.

    Null, empty and letterless texts are in no language; a table without a label keeps nothing. Null ids, repeated rows and
    texts of any length are judged by their text like all others. A table without lang, source or n_chars is an error."""
    return langid.keep_identified(docs, langid.fit(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays, that of the smallest id; a null id is larger than all others.

    Null texts equal nothing and stay, empty ones equal each other. An empty table stays empty."""
    return exact.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id.

    Null texts, texts without a word and rows without an id are in no group and stay; all rows of an id that goes go."""
    return omh.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources meet their target weights.

    A null source is a source of its own. Null and empty texts have size 0 and are drawn at their source's rate; a source
    without a character gives nothing. Rows of one id are drawn alike."""
    return mixing.mix(docs).drop("copy")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences: every piece of every document that came so far, in tokens.

    Null and empty texts have no piece; rows without an id are packed with a null id, repeated ones as often as they occur."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("best_fit_packing", best_fit_packing)]

#: SQL can express neither the parse, nor the alignment, nor the packing: the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, on the documents of sf_dir. What a stage keeps is written to the shared folder and
    read again by the next one, so that a lost executor costs a read."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
