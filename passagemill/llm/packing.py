"""Best-fit packing of documents into sequences of equal capacity, by patterns and non-negative least squares.

Lengths are tokens of the vocabulary. A document longer than the capacity gives full sequences and a remainder; remainders and short documents are
the items to pack. Item lengths are rounded up to ``grid`` steps. A pattern is a multiset of at most
``max_parts`` lengths that fill a sequence exactly. Non-negative least squares fits repeat counts of all
patterns to the histogram of item lengths over the whole table; each group of documents takes its share of
them, rounded down and as far as its own items go, and what is left is packed best fit, longest first.

Only ids and lengths shuffle, into groups of about ``group_docs`` documents that pack independently, so the work is
linear in the input and no task grows with it: rows of one id and length are counted first and then dealt over all groups
one by one, so that an id that a third of the rows have, or none at all, is no larger a group than others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import cut, frugal, pick, release
from .tokenizer import VOCABULARY, encoding

CAPACITY, GRID, MAX_PARTS, GROUP_DOCS = 2048, 128, 4, 50_000
#: Repeats of a row that one row of a sequence stands for while they are dealt.
_DEAL = 1 << 16


@lru_cache(4)
def patterns(grid: int, max_parts: int) -> np.ndarray:
    """All multisets of at most max_parts lengths from 1 to grid with sum grid: counts by length, a row each."""
    found: list[list[int]] = []

    def grow(parts: list[int], left: int, most: int) -> None:
        if left == 0:
            found.append(parts)
        elif len(parts) < max_parts:
            for x in range(min(left, most), (left - 1) // (max_parts - len(parts)), -1):
                grow([*parts, x], left - x, x)

    grow([], grid, grid)
    out = np.zeros((len(found), grid + 1), np.float64)
    for i, parts in enumerate(found):
        np.add.at(out[i], parts, 1)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by Lawson and Hanson's active sets."""
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    scale = np.abs(b).max(initial=0)
    for _ in range(rounds or 3 * a.shape[0]):
        slope = a.T @ (b - a @ x)
        slope[used] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= 1e-9 * scale:
            break
        used[j] = True
        while True:
            at = np.flatnonzero(used)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            low = z <= 1e-12 * scale
            if not low.any():
                x[:] = 0
                x[at] = z
                break
            old = x[at]
            gap = old[low] - z[low]
            step = (old[low] / np.where(gap > 0, gap, 1)).min() if (gap > 0).any() else 0.0
            now = np.maximum(old + min(1.0, max(0.0, step)) * (z - old), 0)
            now[low & (now <= 1e-12 * scale)] = 0
            x[:] = 0
            x[at] = now
            if not (used[at] & (now == 0)).any():  # nothing left the set: rounding alone
                break
            used[at[now == 0]] = False
            if not used.any():
                break
    return x


def fit(histogram: np.ndarray, grid: int, max_parts: int) -> list[tuple[np.ndarray, float]]:
    """Patterns in use and their repeat counts for an item, from item counts by rounded length."""
    total = histogram.sum()
    if not total:
        return []
    every = patterns(grid, max_parts)
    x = nnls(every[:, 1:].T, histogram[1:] / total)
    return [(every[i].astype(np.int64), float(x[i])) for i in np.flatnonzero(x > 0)]


def pack_group(lengths: np.ndarray, capacity: int, grid: int, mix: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """Sequence numbers of items, 1 to capacity long each, given in a fixed order."""
    size = -(-lengths * grid // capacity)
    queues = [np.flatnonzero(size == q)[::-1].tolist() for q in range(grid + 1)]
    have = np.array([len(q) for q in queues])
    bins, at = 0, np.zeros(len(lengths), np.int64)
    for pattern, share in sorted(mix, key=lambda p: -p[1]):
        parts = np.flatnonzero(pattern)
        times = min(int(share * len(lengths)), int((have[parts] // pattern[parts]).min()))
        have -= times * pattern
        for _ in range(times):
            for q in parts:
                for _ in range(pattern[q]):
                    at[queues[q].pop()] = bins
            bins += 1
    room: list[list[int]] = [[] for _ in range(grid + 1)]  # open sequences by what is free
    for q in range(grid, 0, -1):
        for item in reversed(queues[q]):
            free = next((f for f in range(q, grid) if room[f]), grid)
            if free == grid:
                b, bins = bins, bins + 1
            else:
                b = room[free].pop()
            at[item] = b
            if free > q:
                room[free - q].append(b)
    return at


def token_lengths(picked: DataFrame, vocabulary: str | None) -> DataFrame:
    """(id, n) of (id, text): tokens of each text, or characters without a vocabulary; null and empty texts left out."""
    if vocabulary is None:
        return picked.select("id", F.length("text").cast("bigint").alias("n")).where("n > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["id", "n"])

    kind = picked.schema["id"].dataType.simpleString()
    return picked.where("text is not null and text <> ''").mapInArrow(frugal(run), f"id {kind}, n bigint")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, grid: int = GRID, max_parts: int = MAX_PARTS, group_docs: int = GROUP_DOCS, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """(pack, slot, doc_id, start, length, offset): piece [start, start + length) of the document's tokens is in sequence
    pack, as its slot-th piece, from token offset on. vocabulary: where the tokens are, or None for characters.

    Every token of every row is in exactly one piece and no sequence holds more than capacity tokens; no piece is cut but
    those of documents over the capacity. Null and empty texts have no piece, nor has an empty table. Repeated rows are packed
    as often as they occur; rows without an id are packed with a null id. Ties go by id, and the result does not depend on how
    the table is partitioned. Texts count whole, however long. Extra columns, whatever their names, are ignored.
    """
    picked = pick(docs, id=id_col, text=text_col)
    kind = picked.schema["id"].dataType.simpleString()
    lengths = cut(token_lengths(picked, vocabulary))
    items = lengths.where(F.col("n") % capacity > 0)
    size = F.floor(((F.col("n") % capacity) * grid + (capacity - 1)) / F.lit(capacity)).cast("int")
    histogram = np.zeros(grid + 1)
    for r in items.groupBy(size.alias("q")).count().collect():  # at most grid rows
        histogram[r.q] = r["count"]
    mix = fit(histogram, grid, max_parts)
    groups = max(1, -(-lengths.count() // group_docs))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        release()  # what the last group took
        pdf = pdf.sort_values(["n", "id"], ascending=[False, True], kind="stable", ignore_index=True)
        n = pdf["n"].to_numpy()
        full, rest = n // capacity, n % capacity
        has = np.flatnonzero(rest)
        at = pack_group(rest[has], capacity, grid, mix)
        bins = int(at.max()) + 1 if len(at) else 0
        whole = np.repeat(np.arange(len(n)), full)
        nth = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        row = np.concatenate([whole, has])
        out = pd.DataFrame({"pack": np.concatenate([bins + np.arange(len(whole)), at]) + (int(key[0]) << 32), "id": pdf["id"].take(row).array, "start": np.concatenate([nth, full[has]]) * capacity, "length": np.concatenate([np.full(len(whole), capacity), rest[has]])})
        out = out.sort_values(["pack"], kind="stable", ignore_index=True)
        by = out.groupby("pack", sort=False)
        out["slot"] = by.cumcount()
        out["offset"] = by["length"].cumsum() - out["length"]
        return out[["pack", "slot", "id", "start", "length", "offset"]]

    equal = lengths.groupBy("id", "n").agg(F.count("*").alias("rows__"))
    last = F.col("rows__") - 1
    dealt = equal.select("id", "n", "rows__", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / _DEAL).cast("bigint"))).alias("hi"))
    low = F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(_DEAL - 1).cast("bigint"), last - F.col("hi") * _DEAL)))
    each = dealt.select("id", "n", "hi", low.alias("lo"))
    keyed = each.select("id", "n", F.pmod(F.xxhash64(F.col("id").cast("string"), "n", "hi", "lo"), F.lit(groups)).alias("group"))
    packed = keyed.groupBy("group").applyInPandas(run, f"pack bigint, slot int, id {kind}, start bigint, length bigint, offset bigint")
    return packed.withColumnRenamed("id", id_col)
