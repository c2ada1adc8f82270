"""Kernels of the searches: running top-k lists, and sparse products, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..runtime import frugal, pieces

#: Cells of a block of scores, and products of a query's and a row's term, at a time.
CELLS = 1 << 19
HELD = 1 << 17


def best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each query: highest score, then the smallest id."""
    order = np.lexsort((ids, -score, q))
    at = q[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    nth = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    return order[nth < k]


class Keeper:
    """The k best of each of so many queries so far. A later row with the k-th score may still win by its id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.floor, self.held, self.n = k, np.full(queries, -np.inf), [], 0

    def add_block(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: (queries, rows), -inf where there is none."""
        least = self.floor
        if scores.shape[1] > self.k:
            least = np.maximum(least, np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k])
        q, at = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        self.held.append((q, ids[at], scores[q, at]))
        self.n += len(q)
        if self.n > HELD + len(self.floor) * self.k:
            self.compact()

    def compact(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, ids, score = (np.concatenate([h[i] for h in self.held]) for i in range(3))
        at = best(q, ids, score, self.k)
        q, ids, score = q[at], ids[at], score[at]
        full = np.flatnonzero(np.bincount(q, minlength=len(self.floor)) >= self.k)
        last = np.searchsorted(q, full, "right") - 1
        self.floor[full] = score[last]
        self.held, self.n = [(q, ids, score)], len(q)
        return q, ids, score


Postings = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def postings(words: pa.Array, vocabulary: pa.Array) -> Postings:
    """Rows, terms and counts of a list column's known words, and the lengths of all its lists."""
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = pc.index_in(words.flatten(), value_set=vocabulary).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), lengths)
    known = ~np.isnan(codes) if codes.dtype.kind == "f" else np.ones(len(codes), bool)
    keys, n = np.unique(row[known] * max(1, len(vocabulary)) + codes[known].astype(np.int64), return_counts=True)
    return keys // max(1, len(vocabulary)), keys % max(1, len(vocabulary)), n.astype(np.float64), lengths


class Asked:
    """Queries as sparse rows, held by term: what one scan of the texts is matched with."""

    def __init__(self, queries: pa.Array, vocabulary: pa.Array, q: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        order = np.argsort(term, kind="stable")
        self.queries, self.vocabulary = queries, vocabulary
        self.q, self.weight = q[order], weight[order]
        self.first = np.searchsorted(term[order], np.arange(len(vocabulary) + 1))

    def scores(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, rows: int) -> Iterator[tuple[int, np.ndarray]]:
        """Blocks (first row, scores by query and row) of the products with the queries, -inf where no term meets. Rows ascend."""
        many = np.diff(self.first)[term]
        total = np.concatenate([[0], np.cumsum(many)])
        ends = np.searchsorted(row, np.arange(rows + 1))
        width, lo = max(1, CELLS // max(1, len(self.queries))), 0
        while lo < rows:
            hi = min(rows, lo + width, max(lo + 1, int(np.searchsorted(total[ends], total[ends[lo]] + CELLS, "right")) - 1))
            part = slice(ends[lo], ends[hi])
            rep = np.repeat(np.arange(part.start, part.stop), many[part])
            at = np.arange(len(rep)) - np.repeat(total[part] - total[part.start], many[part]) + self.first[term[rep]]
            cell = self.q[at] * (hi - lo) + (row[rep] - lo)
            s = np.bincount(cell, weight[rep] * self.weight[at], minlength=len(self.queries) * (hi - lo)).reshape(-1, hi - lo)
            yield lo, np.where(s != 0, np.round(s, 6), -np.inf)
            lo = hi


def sparse_scan(asked: Asked, weighs: Sequence[Callable[[Postings], np.ndarray]], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass over (id, words) that gives the k best rows of each query, for each way to weigh postings: (run, q, id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keepers = [Keeper(len(asked.queries), k) for _ in weighs]
        for part in (p for batch in batches for p in pieces(batch)):
            found = postings(part.column(1), asked.vocabulary)
            ids = np.asarray(part.column(0).to_pylist(), dtype=object)
            for keeper, weigh in zip(keepers, weighs):
                for lo, block in asked.scores(found[0], found[1], weigh(found), part.num_rows):
                    keeper.add_block(block, ids[lo : lo + block.shape[1]])
        for i, keeper in enumerate(keepers):
            q, ids, score = keeper.compact()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), i, np.int32)), asked.queries.take(pa.array(q)), pa.array(ids.tolist(), pa.string()), pa.array(score)], ["run", "query_id", "chunk_id", "score"])

    return frugal(run)
