"""Embedders: texts to sparse rows, hashed vectors or lengths."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..functions.ranking import Postings, postings
from ..functions.vectors import hashed
from ..runtime import PIECE, frugal, pieces

#: Word characters of a text-to-vector call that a model reads, by tokens.
CHARS_PER_TOKEN = 4
#: What models want before queries and passages; the first name that a model's name contains counts.
PREFIXES: tuple[tuple[str, str, str], ...] = (("e5", "query: ", "passage: "), ("bge", "Represent this sentence for searching relevant passages: ", ""), ("nomic", "search_query: ", "search_document: "))


def tfidf_fit(table: DataFrame, id_col: str = "chunk_id", features: int = 4096) -> DataFrame:
    """(term, idf) of the terms that most rows have, ties by term: ln((1 + N) / (1 + df)) + 1."""
    n = table.agg(F.count("*").cast("double").alias("n"))
    df = table.select(F.explode(F.array_distinct(tx.words(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").cast("double").alias("df")).orderBy(F.desc("df"), "term").limit(features)
    return df.join(F.broadcast(n)).select("term", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def tfidf_weights(found: Postings, idf: np.ndarray) -> np.ndarray:
    """(1 + ln f) * idf of postings, each row of length one."""
    row, term, f, lengths = found
    w = (1 + np.log(f)) * idf[term]
    return w / np.sqrt(np.bincount(row, w * w, minlength=len(lengths)))[row]


def tfidf_rows(table: DataFrame, idf: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """(id, term, weight): (1 + ln f) * idf, rows of length one. Rows without a known term are absent. One pass without a
    shuffle: idf has at most as many rows as tfidf_fit() has features, whatever the corpus, and goes to every task."""
    known = idf.collect()
    shared = table.sparkSession.sparkContext.broadcast((pa.array([r["term"] for r in known], pa.string()), np.array([r["idf"] for r in known], np.float64)))
    kind = table.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, idfs = shared.value
        for part in (p for batch in batches for p in pieces(batch)):
            found = postings(part.column(1), vocabulary)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(found[0])), vocabulary.take(pa.array(found[1])), pa.array(tfidf_weights(found, idfs))], ["id", "term", "weight"])

    rows = table.select(F.col(id_col).alias("id"), tx.words(F.col("text")).alias("w")).where("w is not null")
    return rows.mapInArrow(frugal(run), f"id {kind}, term string, weight double").withColumnRenamed("id", id_col)


def tfidf_vectors(table: DataFrame, idf: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """(id, embedding): tfidf_rows() as vectors with an element a term, zeros included, for indexes that want them."""
    known = idf.collect()  # at most the features of tfidf_fit()
    shared = table.sparkSession.sparkContext.broadcast((pa.array([r["term"] for r in known], pa.string()), np.array([r["idf"] for r in known], np.float64)))
    kind = table.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, idfs = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = postings(part.column(1), vocabulary)
                x = np.zeros((part.num_rows, len(idfs)), np.float32)
                x[found[0], found[1]] = tfidf_weights(found, idfs)
                firsts = pa.array(np.arange(0, x.size + 1, max(1, len(idfs)), dtype=np.int32)[: len(x) + 1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(firsts, pa.array(x.ravel()))], ["id", "embedding"])

    rows = table.select(F.col(id_col).alias("id"), tx.words(F.col("text")).alias("w"))
    return rows.mapInArrow(frugal(run), f"id {kind}, embedding array<float>").withColumnRenamed("id", id_col)


def lengths(table: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """(id, length): words and marks; the control that an embedder must beat."""
    return table.select(id_col, F.size(F.regexp_extract_all(F.col("text"), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]"), 0)).alias("length"))


def hash_vectors(table: DataFrame, id_col: str = "chunk_id", dimensions: int = 256, seed: int = 0) -> DataFrame:
    """(id, embedding): signed hashed words, of length one; a null or wordless text is the zero vector."""
    kind = table.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, PIECE // (4 * dimensions))
        for part in (b.slice(lo, step) for batch in batches for b in pieces(batch) for lo in range(0, b.num_rows, step)):
            rows = np.array([hashed(t or "", dimensions, seed) for t in part.column(1).to_pylist()], np.float32).reshape(-1, dimensions)
            firsts = pa.array(np.arange(0, rows.size + 1, dimensions, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(firsts, pa.array(rows.ravel()))], ["id", "embedding"])

    return table.select(F.col(id_col).alias("id"), "text").mapInArrow(frugal(run), f"id {kind}, embedding array<float>").withColumnRenamed("id", id_col)


def truncate(table: DataFrame, max_tokens: int) -> DataFrame:
    """Texts cut to max_tokens * 4 characters, with truncated: whether any were lost."""
    most = max_tokens * CHARS_PER_TOKEN
    return table.withColumn("truncated", F.length("text") > most).withColumn("text", F.expr(f"left(text, {most})"))


def with_prefix(table: DataFrame, model: str, is_query: bool) -> DataFrame:
    """Texts with what the model wants before them."""
    for name, query, passage in PREFIXES:
        if name in model.lower():
            return table.withColumn("text", F.concat(F.lit(query if is_query else passage), F.col("text")))
    return table


def remote(table: DataFrame, call: Callable[[Sequence[str]], Sequence[Sequence[float]]], id_col: str = "chunk_id", batch: int = 32, retries: int = 2, backoff: float = 0.5) -> DataFrame:
    """(id, embedding) by an injected call of a service, a batch of texts at a time; a failing call is repeated after backoff
    seconds, twice as long each time."""
    kind = table.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                for attempt in range(retries + 1):
                    try:
                        rows = call([t or "" for t in part.column(1).to_pylist()])
                        break
                    except (OSError, TimeoutError):
                        if attempt == retries:
                            raise
                        time.sleep(backoff * 2**attempt)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([list(map(float, r)) for r in rows], pa.list_(pa.float32()))], ["id", "embedding"])

    return table.select(F.col(id_col).alias("id"), "text").mapInArrow(run, f"id {kind}, embedding array<float>").withColumnRenamed("id", id_col)
