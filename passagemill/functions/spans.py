"""Half-open character spans [start, end) of a document, as columns and as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def length(start, end) -> Column:
    return _c(end) - _c(start)


def overlap_len(s1, e1, s2, e2) -> Column:
    """Characters that two spans of one document share."""
    return F.greatest(F.lit(0), F.least(_c(e1), _c(e2)) - F.greatest(_c(s1), _c(s2)))


def union_len(s1, e1, s2, e2) -> Column:
    return length(s1, e1) + length(s2, e2) - overlap_len(s1, e1, s2, e2)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def iou(s1, e1, s2, e2) -> Column:
    """Overlap over union, 0 for two empty spans."""
    return _ratio(overlap_len(s1, e1, s2, e2), union_len(s1, e1, s2, e2))


def coverage_of(s1, e1, s2, e2) -> Column:
    """The share of the second span that the first covers, 0 if it is empty."""
    return _ratio(overlap_len(s1, e1, s2, e2), length(s2, e2))


def contains(s1, e1, s2, e2) -> Column:
    return (_c(s1) <= _c(s2)) & (_c(e2) <= _c(e1))


def clip(start, end, lo, hi) -> tuple[Column, Column]:
    """The span within [lo, hi); empty at lo or hi if they do not meet."""
    bound = lambda x: F.least(F.greatest(_c(x), _c(lo)), _c(hi))
    return bound(start), bound(end)


def shift(start, end, by) -> tuple[Column, Column]:
    return _c(start) + _c(by), _c(end) + _c(by)


def merge_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping or touching spans of equal keys as one; empty spans are dropped."""
    before = W.partitionBy(*keys).orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(*keys).orderBy("start", "end").rowsBetween(W.unboundedPreceding, 0)
    live = spans.where("end > start").withColumn("new", (F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True))).cast("int"))
    return live.withColumn("island", F.sum("new").over(upto)).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def total_length(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Characters that the spans of equal keys cover."""
    return merge_spans(spans, keys).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("total_length"))


def intersection_length(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Characters that both sets of spans cover, by keys that both have; keys without any have no row."""
    a = merge_spans(left, keys)
    b = merge_spans(right, keys).withColumnsRenamed({"start": "s2", "end": "e2"})
    both = a.join(b, keys).where("s2 < end and start < e2")
    return both.groupBy(*keys).agg(F.sum(overlap_len("start", "end", "s2", "e2")).alias("shared_length"))
