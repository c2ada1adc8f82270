"""Evidence: quotes to spans of the source text, spans to relevant chunks.

Evidence is a half-open span of the source document; chunks are judged against it when a run is scored, so that
results of different chunkers compare.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import spans as sp
from ..runtime import frugal, pieces
from .search import slabs

#: Characters of the quotes that one scan of the texts looks for, of which a task has an automaton of about 90 bytes each; more
#: quotes take more scans.
SLAB = 2 << 20


def find_quotes(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """(item_id, doc_id, start, end, occurrence): every place, overlapping ones too, where a quote occurs in a document.
    quotes(item_id, quote). One scan of the texts, with an automaton of the quotes, for each slab of quotes."""
    size = quotes.agg(F.coalesce(F.sum(F.length("quote")), F.lit(0)).alias("n")).first()["n"]
    schema = "item_id bigint, doc_id bigint, start int, end int, occurrence int"
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    parts = []
    for part in slabs(quotes.where("length(quote) > 0").select("item_id", "quote"), "quote", size, SLAB):
        by_quote: dict[str, list[int]] = {}
        for r in part.collect():  # about SLAB characters
            by_quote.setdefault(r.quote, []).append(r.item_id)
        shared = docs.sparkSession.sparkContext.broadcast(by_quote)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            machine = ahocorasick.Automaton()
            for quote in shared.value:
                machine.add_word(quote, quote)
            machine.make_automaton()
            for part in (p for batch in batches for p in pieces(batch)):
                out: list[tuple] = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    seen: dict[str, int] = {}
                    for last, quote in machine.iter(text) if text and len(machine) else ():
                        n = seen[quote] = seen.get(quote, -1) + 1
                        out += [(item, doc, last + 1 - len(quote), last + 1, n) for item in shared.value[quote]]
                cols = list(zip(*out)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["item_id", "doc_id", "start", "end", "occurrence"])

        parts.append(texts.mapInArrow(frugal(run), schema))
    return reduce(DataFrame.unionByName, parts)


def occurrences(text: str, quote: str) -> list[int]:
    """Where a quote starts, overlapping places too."""
    out, at = [], text.find(quote) if quote else -1
    while at >= 0:
        out.append(at)
        at = text.find(quote, at + 1)
    return out


_WHITE = re.compile(r"\s+")


def collapse(text: str) -> tuple[str, list[tuple[int, int]]]:
    """Runs of white space as one space, and where the text left and the text given part: (place left, characters lost
    before it), in order."""
    lost, marks = 0, [(0, 0)]
    for m in _WHITE.finditer(text):
        if m.end() - m.start() > 1:
            lost += m.end() - m.start() - 1
            marks.append((m.end() - lost, lost))
    return _WHITE.sub(" ", text), marks


def _origin(marks: list[tuple[int, int]], at: int) -> int:
    return at + marks[bisect_right(marks, (at, 1 << 62)) - 1][1]


#: Where a quote is, how it was found, and in how many places it could be.
Place = tuple[int | None, int | None, str, int]


def strategies(quote: str, text: str, bounded: bool = False, slack: float = 1.5, edge: int = 3) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Each way to find a quote, with the places it finds: exact; with white space collapsed; then, if asked for, from the first
    place of its first words to its last, if that is at most slack times as long."""
    yield "exact", [(s, s + len(quote)) for s in occurrences(text, quote)]
    flat, marks = collapse(text)
    words = quote.split()
    needle = " ".join(words)
    yield "normalised", [(_origin(marks, s), _origin(marks, s + len(needle) - 1) + 1) for s in occurrences(flat, needle)]
    if bounded and len(words) >= 2 * edge:
        head, tail = " ".join(words[:edge]), " ".join(words[-edge:])
        s = flat.find(head)
        t = flat.find(tail, s + len(head)) if s >= 0 else -1
        if t >= 0 and t + len(tail) - s <= len(quote) * slack:
            yield "bounded", [(_origin(marks, s), _origin(marks, t + len(tail) - 1) + 1)]


def locate(quote: str, text: str, occurrence: int = 0, bounded: bool = False, slack: float = 1.5, edge: int = 3, page_hint: int | None = None, pages: list[tuple[int, int]] | None = None) -> Place:
    """(start, end, strategy, places): place number occurrence of the first strategy that has so many; the bounded one has one.
    Where some places start on the page that the hint names, only these count; pages: (start, number) in order. Without a place
    the strategy is out_of_range if some strategy found any, else not_found."""
    quote, seen = quote.strip(), 0
    for strategy, places in strategies(quote, text, bounded, slack, edge) if quote and text else ():
        if page_hint is not None and pages and strategy != "bounded":
            starts = [p[0] for p in pages]
            places = [p for p in places if pages[max(0, bisect_right(starts, p[0]) - 1)][1] == page_hint] or places
        seen = max(seen, len(places))
        nth = 0 if strategy == "bounded" else occurrence
        if nth < len(places):
            return *places[nth], strategy, len(places)
    return None, None, "out_of_range" if seen else "not_found", seen


def resolve_anchors(anchors: DataFrame, docs: DataFrame, bounded: bool = False) -> DataFrame:
    """anchors(item_id, doc_id, quote, occurrence, and if it is there page_hint) -> with start, end, strategy and ambiguous:
    whether the first of several places was taken. Without a place the strategy says why: not_found, out_of_range, or
    no_document. docs may have pages: array of (start, number)."""
    hints = "page_hint" if "page_hint" in anchors.columns else None
    own = docs.select("doc_id", "text", *(["pages"] if "pages" in docs.columns else []), F.lit(True).alias("known"))
    pages = F.col("pages") if "pages" in docs.columns else F.lit(None).cast("array<struct<start:int,number:int>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b, "text")):
            out = []
            for quote, text, n, known, hint, at in zip(*(batch.column(c).to_pylist() for c in ("quote", "text", "occurrence", "known", "hint", "pages"))):
                if not known:
                    out.append((None, None, "no_document", False))
                    continue
                start, end, strategy, places = locate(quote or "", text or "", n or 0, bounded, page_hint=hint, pages=[(p["start"], p["number"]) for p in at or ()])
                out.append((start, end, strategy, start is not None and places > 1 and not n))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("doc_id"), batch.column("quote"), *(pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.bool_())))], ["item_id", "doc_id", "quote", "start", "end", "strategy", "ambiguous"])

    joined = anchors.join(own, "doc_id", "left").withColumns({"hint": F.col(hints).cast("int") if hints else F.lit(None).cast("int"), "pages": pages})
    return joined.select("item_id", "doc_id", "quote", "occurrence", "text", "known", "hint", "pages").mapInArrow(frugal(run), "item_id bigint, doc_id bigint, quote string, start int, end int, strategy string, ambiguous boolean")


def resolve_everywhere(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id, start, end, strategy) of quotes(item_id, quote) wherever a document has one, by any strategy, and one row
    not_found for a quote that none has. Each strategy needs the quote's first words, white space aside: one scan finds the
    documents that have them, and only these are looked at."""
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " "))
    heads = quotes.select("item_id", F.array_join(F.slice(F.split(squeeze(F.col("quote")), " "), 1, 3), " ").alias("quote"))
    where = find_quotes(docs.select("doc_id", squeeze(F.col("text")).alias("text")), heads).select("item_id", "doc_id").distinct()
    found = resolve_anchors(where.join(quotes, "item_id").withColumn("occurrence", F.lit(0)), docs, True).where("start is not null").drop("quote", "ambiguous")
    none = quotes.select("item_id").distinct().join(found.select("item_id"), "item_id", "left_anti")
    return found.unionByName(none.select("item_id", F.lit("not_found").alias("strategy")), allowMissingColumns=True)


def resolution_report(resolved: DataFrame) -> DataFrame:
    """(strategy, n) of resolve_anchors(): absent quotes and those of a wrong number apart."""
    return resolved.groupBy("strategy").agg(F.count("*").alias("n"), F.count_if("ambiguous").alias("ambiguous"))


def judge(gold: DataFrame, chunks: DataFrame, policy: str = "coverage") -> DataFrame:
    """(item_id, gold_start, gold_end, grade, chunk_id, value) for each chunk that meets a gold span: an equi-join on
    the document with the overlap as a residual. gold(item_id, doc_id, start, end, grade); policy: coverage, iou
    or containment."""
    g = gold.withColumnsRenamed({"start": "gold_start", "end": "gold_end"})
    both = g.join(chunks.select("doc_id", "chunk_id", "start", "end"), "doc_id").where("start < gold_end and gold_start < end")
    cols = ("start", "end", "gold_start", "gold_end")
    value = {"coverage": sp.coverage_of(*cols), "iou": sp.iou(*cols), "containment": sp.contains(*cols).cast("double")}[policy]
    return both.select("item_id", "doc_id", "gold_start", "gold_end", "grade", "chunk_id", "start", "end", value.alias("value"))


def qrels(gold: DataFrame, chunks: DataFrame, policy: str = "coverage", threshold: float = 0.5) -> DataFrame:
    """(query_id, chunk_id, grade): chunks that count as relevant, with the highest grade of the spans they match; grade 0
    is dropped."""
    ok = F.col("value") >= (1.0 if policy == "containment" else threshold)
    found = judge(gold, chunks, policy).where(ok).groupBy(F.col("item_id").alias("query_id"), "chunk_id").agg(F.max("grade").alias("grade"))
    return found.where("grade > 0")


def gold_report(gold: DataFrame, chunks: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(item_id, doc_id, start, end, best, covered, status) of each gold span: found; split, if chunks cover it
    together only; or why not: no_document, outside or inside of the range that chunks cover."""
    judged = judge(gold, chunks)
    key = ["item_id", "doc_id", "gold_start", "gold_end"]
    best = judged.groupBy(*key).agg(F.max("value").alias("best"))
    parts = judged.select(*key, F.greatest("start", "gold_start").alias("start"), F.least("end", "gold_end").alias("end"))
    covered = sp.total_length(parts, key)
    extent = chunks.groupBy("doc_id").agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
    g = gold.select("item_id", "doc_id", F.col("start").alias("gold_start"), F.col("end").alias("gold_end")).distinct()
    all_ = g.join(best, key, "left").join(covered, key, "left").join(extent, "doc_id", "left")
    status = (
        F.when(F.col("best") >= threshold, "found").when(F.col("total_length") > 0, "split").when(F.col("lo").isNull(), "no_document")
        .when((F.col("gold_end") <= F.col("lo")) | (F.col("gold_start") >= F.col("hi")), "outside").otherwise("inside")
    )
    share = F.coalesce(F.col("total_length"), F.lit(0)) / (F.col("gold_end") - F.col("gold_start"))
    return all_.select("item_id", "doc_id", F.col("gold_start").alias("start"), F.col("gold_end").alias("end"), F.round(F.coalesce("best", F.lit(0.0)), 6).alias("best"), F.round(share, 6).alias("covered"), status.alias("status"))


def character_metrics(gold: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(item_id, char_recall, char_precision, char_f1) from spans(item_id, doc_id, start, end) on both sides, merged; 0
    without gold, or without anything retrieved."""
    keys = ["item_id", "doc_id"]
    shared = sp.intersection_length(gold, retrieved, keys).groupBy("item_id").agg(F.sum("shared_length").alias("shared"))
    g = sp.total_length(gold, keys).groupBy("item_id").agg(F.sum("total_length").alias("g"))
    r = sp.total_length(retrieved, keys).groupBy("item_id").agg(F.sum("total_length").alias("r"))
    all_ = g.join(r, "item_id", "full_outer").join(shared, "item_id", "left").fillna(0, ["g", "r", "shared"])
    recall = F.when(F.col("g") > 0, F.col("shared") / F.col("g")).otherwise(F.lit(0.0))
    precision = F.when(F.col("r") > 0, F.col("shared") / F.col("r")).otherwise(F.lit(0.0))
    f1 = F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(F.lit(0.0))
    return all_.select("item_id", F.round(recall, 6).alias("char_recall"), F.round(precision, 6).alias("char_precision"), F.round(f1, 6).alias("char_f1"))


def retrieved_characters(retrieved: DataFrame) -> DataFrame:
    """(item_id, characters): what spans(item_id, doc_id, start, end) cover together."""
    return sp.total_length(retrieved, ["item_id", "doc_id"]).groupBy("item_id").agg(F.sum("total_length").alias("characters"))


def gold_coverage(gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """(item_id, chunk_id, covered): the share of an item's evidence, merged, that each chunk has."""
    merged = sp.merge_spans(gold.select("item_id", "doc_id", "start", "end"), ["item_id", "doc_id"])
    size = merged.groupBy("item_id").agg(F.sum(F.col("end") - F.col("start")).alias("n"))
    g = merged.withColumnsRenamed({"start": "gs", "end": "ge"})
    each = g.join(chunks.select("doc_id", "chunk_id", "start", "end"), "doc_id").where("start < ge and gs < end")
    by = each.groupBy("item_id", "chunk_id").agg(F.sum(sp.overlap_len("start", "end", "gs", "ge")).alias("o"))
    return by.join(size, "item_id").select("item_id", "chunk_id", F.round(F.col("o") / F.col("n"), 6).alias("covered"))


def items_without_gold(items: DataFrame, gold: DataFrame) -> DataFrame:
    return items.join(gold.select("item_id").distinct(), "item_id", "left_anti")


def gold_extent(gold: DataFrame) -> DataFrame:
    """(item_id, gold_length, documents) of an item's evidence, merged."""
    merged = sp.merge_spans(gold.select("item_id", "doc_id", "start", "end"), ["item_id", "doc_id"])
    return merged.groupBy("item_id").agg(F.sum(F.col("end") - F.col("start")).cast("bigint").alias("gold_length"), F.countDistinct("doc_id").alias("documents"))


def self_check(gold: DataFrame, docs: DataFrame) -> DataFrame:
    """(items, missing_document, out_of_bounds, text_differs): gold(doc_id, start, end, quote) against the documents."""
    j = gold.join(docs.select("doc_id", "text"), "doc_id", "left")
    out = F.col("end") > F.length("text")
    differs = ~out & (F.expr("substring(text, start + 1, end - start)") != F.col("quote"))
    return j.agg(F.count("*").alias("items"), F.count_if(F.col("text").isNull()).alias("missing_document"), F.count_if(out).alias("out_of_bounds"), F.count_if(differs).alias("text_differs"))

