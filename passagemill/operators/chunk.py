"""Parsers and chunkers: documents to blocks and chunks, each a literal slice of its document.

A chunker is one Arrow pass over the texts, without a shuffle; a chunk carries exact character offsets.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as tx
from ..runtime import PIECE, frugal, pieces

_CHUNKS = "doc_id bigint, idx int, start int, end int, text string, heading_path array<string>, n_tokens int"
_CHUNK_COLUMNS = ["doc_id", "idx", "start", "end", "text", "heading_path", "n_tokens"]
_CHUNK_KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.int32())
_BLOCK_COLUMNS = ["doc_id", "ord", "start", "end", "kind", "level", "text"]
_BLOCK_KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string())


def _batches(rows: Iterator[tuple], columns: list[str], kinds: tuple[pa.DataType, ...]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of at most about PIECE bytes: those of one long text may be many."""
    out, held, at = [], 0, columns.index("text")

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], columns)

    for row in rows:
        out.append(row)
        held += len(row[at]) + 64
        if held >= PIECE:
            yield made()
            out, held = [], 0
    if out:
        yield made()


def chunk(docs: DataFrame, chunker: str | Callable[..., tx.Ranges] = "fixed", markdown: bool = True, **how) -> DataFrame:
    """(chunk_id, doc_id, idx, start, end, text, heading_path, n_tokens) of docs(doc_id, text). Null texts have no chunk.
    markdown: whether headings are looked for; plain text has none, so that the structural chunker cuts it like the recursive
    one."""
    cut = tx.CHUNKERS[chunker] if isinstance(chunker, str) else chunker
    if chunker == "structural" and not markdown:
        cut = lambda text, max_size=512, min_size=None, split_tables=False, tokenizer="regex": tx.recursive(text, max_size, 0, tokenizer)  # noqa: E731, ARG005
    tokenizer = how.get("tokenizer", "regex")

    def rows(part: pa.RecordBatch) -> Iterator[tuple]:
        for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            if not text:
                continue
            ranges = cut(text, **how)
            if not ranges:
                continue
            ruler = tx.ruler_of(text, tokenizer)
            heads = tx.heading_paths(text) if markdown and ("#" in text or "\n=" in text or "\n-" in text) else []
            at = [h[0] for h in heads]
            for i, (lo, hi) in enumerate(ranges):
                h = bisect_right(at, lo)
                yield doc, i, lo, hi, text[lo:hi], heads[h - 1][1] if h else [], ruler.count(lo, hi)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                yield from _batches(rows(part), _CHUNK_COLUMNS, _CHUNK_KINDS)

    ranged = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(frugal(run), _CHUNKS)
    return ranged.select(chunk_id("doc_id", "start", "end").alias("chunk_id"), *ranged.columns)


def chunk_id(doc: str | Column, start: str | Column, end: str | Column) -> Column:
    c = lambda x: (F.col(x) if isinstance(x, str) else x).cast("string")
    return F.concat(c(doc), F.lit(":"), c(start), F.lit("-"), c(end))


def parse(docs: DataFrame, parser: str = "text") -> DataFrame:
    """(doc_id, ord, start, end, kind, level, text): the blocks of each document. parser: text or markdown."""

    def rows(part: pa.RecordBatch) -> Iterator[tuple]:
        for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            blocks = tx.markdown_blocks(text or "") if parser == "markdown" else [(a, b, "paragraph", None) for a, b in tx.paragraphs(text or "")]
            yield from ((doc, i, a, b, kind, level, text[a:b]) for i, (a, b, kind, level) in enumerate(blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                yield from _batches(rows(part), _BLOCK_COLUMNS, _BLOCK_KINDS)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(frugal(run), "doc_id bigint, ord int, start int, end int, kind string, level int, text string")


_PAGE = r"<!--\s*page:\s*(\d+)\s*-->"


def page_table(docs: DataFrame) -> DataFrame:
    """(doc_id, start, number) of the pages that markers <!-- page: n --> begin; a text before the first marker is page 1."""
    tiled = docs.select("doc_id", F.posexplode(F.split("text", _PAGE)).alias("i", "part"), F.regexp_extract_all("text", F.lit(_PAGE), 0).alias("marks"), F.regexp_extract_all("text", F.lit(_PAGE), 1).alias("numbers"))
    size = F.length("part") + F.coalesce(F.length(F.get("marks", F.col("i") - 1)), F.lit(0))
    before = F.coalesce(F.sum(size).over(W.partitionBy("doc_id").orderBy("i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")
    placed = tiled.withColumns({"start": before, "number": F.when(F.col("i") == 0, F.lit(1)).otherwise(F.get("numbers", F.col("i") - 1).cast("int"))})
    return placed.where((F.col("i") > 0) | (F.size("marks") == 0) | (F.length(F.trim("part")) > 0)).select("doc_id", "start", "number")


def with_pages(docs: DataFrame) -> DataFrame:
    """docs with pages: array of (start, number), as anchors and chunks look them up."""
    by = page_table(docs).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "number"))).alias("pages"))
    return docs.join(by, "doc_id", "left")


def page_at(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """spans(doc_id, start, ...) with page: the last page that begins at or before the start; pages: of page_table()."""
    by = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "number"))).alias("pages__"))
    upto = F.filter("pages__", lambda p: p["start"] <= F.col("start"))
    return spans.join(by, "doc_id", "left").withColumn("page", F.when(F.size(upto) > 0, F.element_at(upto, -1)["number"])).drop("pages__")


def blocks_of(blocks: DataFrame, *kinds: str) -> DataFrame:
    return blocks.where(F.col("kind").isin(*kinds))


def block_at(positions: DataFrame, blocks: DataFrame) -> DataFrame:
    """positions(doc_id, at) with ord and kind of the block that has the place, null outside all blocks."""
    held = blocks.select("doc_id", "ord", "kind", F.col("start").alias("s__"), F.col("end").alias("e__"))
    return positions.join(held, (positions["doc_id"] == held["doc_id"]) & (F.col("s__") <= F.col("at")) & (F.col("at") < F.col("e__")), "left").drop(held["doc_id"]).drop("s__", "e__")


def require_parse(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """chunks, which fail when they are read if one is no slice of its document: they belong to another parse of it."""
    own = docs.select("doc_id", F.col("text").alias("whole__"))
    same = F.expr("substring(whole__, start + 1, end - start)").eqNullSafe(F.col("text"))
    why = F.concat(F.lit("the chunk belongs to another parse: "), "chunk_id")
    return chunks.join(own, "doc_id", "left").withColumn("text", F.when(same, F.col("text")).otherwise(F.raise_error(why).cast("string"))).drop("whole__")


def verify_blocks(blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """Blocks (or chunks) whose text is not the slice of their document that their offsets name."""
    own = docs.select("doc_id", F.col("text").alias("whole"))
    return blocks.join(own, "doc_id").where(~F.expr("substring(whole, start + 1, end - start)").eqNullSafe(F.col("text"))).drop("whole")


def token_table(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, token, start, end): words and marks with offsets, white space left out. For tokens as rows;
    chunkers do not need it."""
    tiled = docs.select("doc_id", F.posexplode(tx.tiles(F.col("text"))).alias("tile", "token"))
    upto = W.partitionBy("doc_id").orderBy("tile").rowsBetween(W.unboundedPreceding, 0)
    placed = tiled.withColumn("end", F.sum(F.length("token")).over(upto).cast("int")).withColumn("start", (F.col("end") - F.length("token")).cast("int"))
    solid = placed.where(~F.col("token").rlike(r"^[\s\p{Z}]"))
    return solid.select("doc_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("tile")) - 1).alias("pos"), "token", "start", "end")


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, line, start, end) of every line, which a line feed ends."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    upto = W.partitionBy("doc_id").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    end = (F.sum(F.length("s") + 1).over(upto) - 1).cast("int")
    return lines.withColumn("end", end).select("doc_id", "line", (F.col("end") - F.length("s")).alias("start"), "end")


def decode(content: Column) -> Column:
    """Text of UTF-8 bytes without a byte order mark; empty if they are not UTF-8."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.regexp_replace(content.cast("string"), "^﻿", "")).otherwise(F.lit(""))


def looks_binary(content: Column) -> Column:
    """Whether the first 8192 bytes have a zero, or over 30 % of control bytes other than white space."""
    head = F.hex(F.substring(content, 1, 8192))
    odd = F.regexp_count(F.regexp_replace(head, "(..)", "$1 "), F.lit(r"\b(0[0-8BEF]|1[0-9A-F]|7F)\b"))
    zero = F.regexp_count(F.regexp_replace(head, "(..)", "$1 "), F.lit(r"\b00\b"))
    return (zero > 0) | (odd > 0.3 * F.length(head) / 2)


def heading_levels(sizes: DataFrame, min_ratio: float = 1.15) -> DataFrame:
    """(size, level) of font sizes at least min_ratio times the size most characters have; sizes(size, chars)."""
    total = sizes.groupBy("size").agg(F.sum("chars").alias("chars"))
    body = total.agg(F.max_by("size", F.struct("chars", -F.col("size"))).alias("body"))
    return total.crossJoin(body).where(F.col("size") >= F.col("body") * min_ratio).select("size", F.dense_rank().over(W.orderBy(F.desc("size"))).alias("level"))


def assemble_text(pieces: DataFrame) -> DataFrame:
    """pieces(doc_id, ord, text) -> (doc_id, ord, start, end, text): trimmed pieces as they lie in the text that joins
    them by blank lines; empty ones are dropped."""
    solid = pieces.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).where(F.length("text") > 0)
    before = W.partitionBy("doc_id").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0)).cast("int")
    return solid.withColumn("start", start).select("doc_id", "ord", "start", (F.col("start") + F.length("text")).alias("end"), "text")


# Ingestion: what is indexed need not be what is returned.


def parent_document(chunks: DataFrame, group: int = 4) -> DataFrame:
    """(doc_id, parent, start, end, children): each group of consecutive chunks as one."""
    nth = F.floor((F.row_number().over(W.partitionBy("doc_id").orderBy("start", "end")) - 1) / group).cast("int")
    grouped = chunks.withColumn("parent", nth).groupBy("doc_id", "parent")
    return grouped.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").cast("int").alias("children"))


def parent_map(chunks: DataFrame, group: int = 4) -> DataFrame:
    """(chunk_id, parent_id)."""
    w = W.partitionBy("doc_id").orderBy("start", "end")
    numbered = chunks.withColumn("parent", F.floor((F.row_number().over(w) - 1) / group))
    own = W.partitionBy("doc_id", "parent")
    return numbered.select("chunk_id", F.concat(chunk_id("doc_id", F.min("start").over(own), F.max("end").over(own)), F.lit("#parent")).alias("parent_id"))


def sentence_window(chunks: DataFrame, window: int = 2) -> DataFrame:
    """(chunk_id, start, end): each chunk with what its neighbours on both sides span."""
    w = W.partitionBy("doc_id").orderBy("start", "end").rowsBetween(-window, window)
    return chunks.select("chunk_id", F.min("start").over(w).alias("start"), F.max("end").over(w).alias("end"))


def hierarchical(hits: DataFrame, parents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """hits(query_id, chunk_id, score): chunks whose parent has at least this share of its chunks hit give way to it,
    with their best score."""
    size = parents.groupBy("parent_id").agg(F.count("*").alias("size"))
    hit = hits.join(parents, "chunk_id")
    found = hit.groupBy("query_id", "parent_id").agg(F.count("*").alias("n"), F.max("score").alias("score")).join(size, "parent_id")
    merged = found.where(F.col("n") >= F.col("size") * threshold)
    leaves = hit.join(merged.select("query_id", "parent_id"), ["query_id", "parent_id"], "left_anti").select("query_id", "chunk_id", "score")
    return merged.select("query_id", F.col("parent_id").alias("chunk_id"), "score").unionByName(leaves)
