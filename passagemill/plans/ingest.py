"""What is indexed, what a hit stands for, and what a returned passage counts as when it is scored."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators import chunk as ch, models

PASSAGE = ("chunk_id", "doc_id", "start", "end", "text", "n_tokens")


@dataclass
class Ingested:
    """indexed(indexed_id, chunk_id, text): what is searched, and the passage that a hit stands for.
    retrievable: the units that evidence is resolved to. shown: wider passages, if hits stand for these.
    covers(chunk_id, place, scored_id): the units that a wider passage counts as, in order.
    siblings(chunk_id, parent_id), share: units that give way to their parent once so many of its units are hit."""

    indexed: DataFrame
    retrievable: DataFrame
    shown: DataFrame | None = None
    covers: DataFrame | None = None
    siblings: DataFrame | None = None
    share: float = 0.5

    def passages(self) -> DataFrame:
        """All that may be returned, with texts."""
        own = self.retrievable.select(*PASSAGE)
        return own if self.shown is None else own.unionByName(self.shown.select(*PASSAGE))

    def fan_out(self) -> int:
        """Indexed units for a returned passage, rounded, from 1 to 8: how much deeper the index is asked."""
        n, m = self.indexed.count(), self.retrievable.count()
        return max(1, min(8, round(n / m))) if m else 1

    def returned(self, hits: DataFrame, k: int) -> DataFrame:
        """Hits of indexed units as hits of what they stand for, the best score counts; siblings merge. (query_id, chunk_id,
        score, rank)"""
        named = hits.withColumnRenamed("chunk_id", "indexed_id").join(self.indexed.select("indexed_id", "chunk_id"), "indexed_id")
        best = named.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
        if self.siblings is not None:
            best = ch.hierarchical(best, self.siblings, self.share)
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
        return best.withColumn("rank", rank).where(F.col("rank") <= k)

    def scored(self, hits: DataFrame) -> DataFrame:
        """Returned passages as the units they count as, each where it comes first. (query_id, chunk_id, rank)"""
        if self.covers is None:
            return hits.select("query_id", "chunk_id", "rank")
        wide = hits.join(self.covers, "chunk_id", "left").select("query_id", F.coalesce("scored_id", "chunk_id").alias("chunk_id"), F.struct(F.col("rank").alias("r"), F.coalesce("place", F.lit(0)).alias("p")).alias("at"))
        first = wide.groupBy("query_id", "chunk_id").agg(F.min("at").alias("at"))
        return first.select("query_id", "chunk_id", F.row_number().over(W.partitionBy("query_id").orderBy("at")).alias("rank"))


def _numbered(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("nth", F.row_number().over(W.partitionBy("doc_id").orderBy("start", "end", "chunk_id")) - 1)


_PART = ("start", "end", "chunk_id", "text", "n_tokens")


def _merged_text(parts: str) -> Column:
    """The text of chunks in order: that of the document where they tile it, else joined by line feeds."""
    first = F.col(parts)[0]["start"]

    def more(acc: Column, p: Column) -> Column:
        rest = F.when(p["end"] > acc["end"], p["text"].substr(acc["end"] - p["start"] + 1, F.length(p["text"]))).otherwise(F.lit(""))
        return F.struct(F.concat(acc["text"], rest).alias("text"), F.greatest(acc["end"], p["end"]).alias("end"), p["end"].alias("last"), (acc["ok"] & (acc["last"] >= p["start"])).alias("ok"))

    begin = F.struct(F.lit("").alias("text"), first.alias("end"), first.alias("last"), F.lit(True).alias("ok"))
    return F.aggregate(parts, begin, more, lambda acc: F.when(acc["ok"], acc["text"]).otherwise(F.array_join(F.transform(parts, lambda p: p["text"]), "\n")))


def _together(by: DataFrame, key: str, suffix: str) -> DataFrame:
    """(key, chunk_id, doc_id, start, end, text, n_tokens, parts) of (key, doc_id, parts): one passage a key, as large as the
    group or window that the caller forms; a group of one is its chunk."""
    start, end = F.col("parts")[0]["start"], F.element_at("parts", -1)["end"]
    name = F.when(F.size("parts") > 1, F.concat(ch.chunk_id("doc_id", start, end), F.lit(f":{suffix}"))).otherwise(F.col("parts")[0]["chunk_id"])
    total = F.aggregate("parts", F.lit(0), lambda s, p: s + p["n_tokens"])
    return by.select(key, name.alias("chunk_id"), "doc_id", start.alias("start"), end.alias("end"), _merged_text("parts").alias("text"), total.alias("n_tokens"), "parts")


def plain(chunks: DataFrame) -> Ingested:
    return Ingested(chunks.select(F.col("chunk_id").alias("indexed_id"), "chunk_id", "text"), chunks)


def _groups(chunks: DataFrame, group: int) -> DataFrame:
    if group < 2:
        raise ValueError("a group has at least 2 chunks")
    keyed = _numbered(chunks).withColumn("key", F.floor(F.col("nth") / group))
    return _together(keyed.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct(*_PART))).alias("parts")), "key", "parent")


def parent_document(chunks: DataFrame, group: int = 4) -> Ingested:
    """Each chunk stands for the passage of its group of consecutive chunks."""
    parents = _groups(chunks, group)
    indexed = parents.select("chunk_id", F.explode("parts").alias("p")).select(F.col("p.chunk_id").alias("indexed_id"), "chunk_id", F.col("p.text").alias("text"))
    return Ingested(indexed, parents.select(*PASSAGE))


def sentence_window(chunks: DataFrame, window: int = 2) -> Ingested:
    """Each chunk stands for itself with its neighbours; the passage counts as all of its chunks, the middle one first."""
    if window < 1:
        raise ValueError("a window has at least 1 neighbour")
    near = W.partitionBy("doc_id").orderBy("start", "end", "chunk_id").rowsBetween(-window, window)
    windows = _together(chunks.select("doc_id", F.col("chunk_id").alias("centre"), F.collect_list(F.struct(*_PART)).over(near).alias("parts")), "centre", f"window{window}")
    # windows of one extent, at the ends of a document, are told apart by their centres
    windows = windows.withColumn("chunk_id", F.concat("chunk_id", F.lit("@"), "centre"))
    indexed = chunks.select(F.col("chunk_id").alias("indexed_id"), "text").join(windows.select(F.col("centre").alias("indexed_id"), "chunk_id"), "indexed_id").select("indexed_id", "chunk_id", "text")
    covers = windows.select("chunk_id", "centre", F.posexplode("parts").alias("p", "c")).select("chunk_id", F.when(F.col("c.chunk_id") == F.col("centre"), -1).otherwise(F.col("p")).alias("place"), F.col("c.chunk_id").alias("scored_id"))
    return Ingested(indexed, chunks, windows.select(*PASSAGE), covers)


def hierarchical(chunks: DataFrame, group: int = 4, threshold: float = 0.5) -> Ingested:
    """Chunks give way to the passage of their group once so many of it are hit; it counts as its chunks."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    parents = _groups(chunks, group)
    covers = parents.select("chunk_id", F.posexplode("parts").alias("place", "c")).select("chunk_id", "place", F.col("c.chunk_id").alias("scored_id"))
    siblings = covers.select(F.col("scored_id").alias("chunk_id"), F.col("chunk_id").alias("parent_id"))
    return Ingested(plain(chunks).indexed, chunks, parents.where(F.size("parts") > 1).select(*PASSAGE), covers, siblings, threshold)


def generated(chunks: DataFrame, model: models.Model, way: str, count: int) -> Ingested:
    """What a model says of each chunk is indexed in its place."""
    return Ingested(models.ingest(chunks, model, way, count), chunks)


def summary(docs: DataFrame, model: models.Model) -> Ingested:
    """A summary of each document is indexed, the whole document comes back."""
    whole = docs.where("length(text) > 0").select(ch.chunk_id("doc_id", F.lit(0), F.length("text")).alias("chunk_id"), "doc_id", F.lit(0).alias("start"), F.length("text").alias("end"), "text", F.size(F.regexp_extract_all(F.col("text"), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]"), 0)).alias("n_tokens"))
    said = models.summarise(docs.where("length(text) > 0"), model).select("doc_id", F.col("text").alias("said"))
    indexed = whole.join(said, "doc_id").select(F.col("chunk_id").alias("indexed_id"), "chunk_id", F.col("said").alias("text"))
    return Ingested(indexed, whole)


Ingestion = Callable[..., Ingested]
STRUCTURAL: dict[str, Ingestion] = {"plain": plain, "parent-document": parent_document, "sentence-window": sentence_window, "hierarchical": hierarchical}
GENERATED = {"contextual": 1, "hypothetical-questions": 3, "propositions": 6, "summary": 1}


def ingest(name: str, docs: DataFrame, chunks: DataFrame, model: models.Model | None = None, **how: Any) -> Ingested:
    """Ingestion by name; those that ask a model raise without one."""
    if name in STRUCTURAL:
        return STRUCTURAL[name](chunks, **how)
    if name not in GENERATED:
        raise ValueError(f"unknown ingestion {name!r}; known: {', '.join((*STRUCTURAL, *GENERATED))}")
    if model is None:
        raise ValueError(f"ingestion {name} needs a model")
    if name == "summary":
        return summary(docs, model)
    return generated(chunks, model, name, how.get("count", GENERATED[name]))
