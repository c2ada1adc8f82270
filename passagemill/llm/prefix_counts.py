"""Exact token counts of every prefix of a text, by dynamic programming.

The encoding of a piece's prefix is the encoding of a shorter prefix and one more token: of the tokens that end
there, exactly one forms a stable pair with the last token of the shorter prefix (both stay as they are when
the two are encoded together). Going through a piece once thus gives the count of each of its prefixes, in
time linear in its length. Pieces are what the vocabulary's pattern splits a text into; a prefix of the text is
whole pieces and a prefix of the next one, but for white space at its end, which is always one piece.

count[i], of the first i characters, is stored as differences, a byte each. Truncation and budget questions read it and
encode nothing. Character classes come from the tokenizer's own pattern engine. One scan, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

from ._common import code_points, pick
from .tokenizer import VOCABULARY, encoding, ranks

BUDGETS = (256, 2048)
_CHUNK, _CACHE = 1 << 20, 400_000
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@lru_cache(1)
def _matchers() -> list[tiktoken.Encoding]:
    single = {bytes([i]): i for i in range(256)}
    return [tiktoken.Encoding(f"class{i}", pat_str=p, mergeable_ranks=single, special_tokens={}) for i, p in enumerate((r"\p{L}", r"\p{N}", r"\s"))]


def _class_of(c: int) -> int:
    if 0xD800 <= c < 0xE000:
        return OTHER
    return next((k for k, m in zip((LETTER, NUMBER, SPACE), _matchers()) if m.encode_ordinary(chr(c))), OTHER)


@lru_cache(1)
def _plane() -> np.ndarray:
    """Classes of the basic plane: one pass of each matcher finds its members."""
    table = np.zeros(0x10000, np.uint8)
    every = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    for k, m in zip((LETTER, NUMBER, SPACE), _matchers()):
        table[np.frombuffer(bytes(m.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = k
    return table


def classes(points: np.ndarray) -> np.ndarray:
    out = _plane()[np.minimum(points, 0xFFFF)]
    high = np.flatnonzero(points > 0xFFFF)
    if len(high):
        values, inverse = np.unique(points[high], return_inverse=True)
        out[high] = np.array([_class_of(int(v)) for v in values], np.uint8)[inverse]
    return out


def piece_starts(points: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where the pieces of consecutive texts start, as flags."""
    n = len(points)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    last = first[1:]
    first = first[:n]
    space = kind == SPACE
    before, was = np.zeros(n, bool), np.zeros(n, np.uint32)
    before[1:], was[1:] = space[:-1], points[:-1]
    changed = np.ones(n, bool)
    changed[1:] = kind[1:] != kind[:-1]
    ends = np.zeros(n, bool)  # the next character is of the same text and no space
    ends[:-1] = ~space[1:]
    ends &= ~last
    start = first | (~space & ~before & changed) | (~space & before & (was != 0x20)) | (space & ~before) | (space & before & ends)
    for at in np.flatnonzero(start & (points == 0x27)).tolist():
        end = int(offsets[np.searchsorted(offsets, at, "right")])
        follow = "".join(map(chr, points[at + 1 : min(end, at + 3)]))
        size = 1 if follow[:1] in ("s", "t", "m", "d") and follow else 2 if follow in ("re", "ve", "ll") else 0
        if size:
            start[at + 1 : at + 1 + size] = False
            if at + 1 + size < end:
                start[at + 1 + size] = True
    return start


class Counter:
    """Prefix counts with one vocabulary; pieces seen lately are kept."""

    def __init__(self, path: str) -> None:
        self.ranks, self.encoding = ranks(path), encoding(path)
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.suffixes = {t[i:]: -1 for t in self.ranks for i in range(1, len(t))} | self.ranks  # -1: only the end of a token
        self.pairs: dict[int, bool] = {}
        self.kept: dict[str, bytes] = {}

    def stable(self, a: int, b: int) -> bool:
        """Whether a and b stay as they are when the two are encoded together."""
        found = self.encoding._encode_single_piece(self.tokens[a] + self.tokens[b]) == [a, b]
        if len(self.pairs) > 4 * _CACHE:
            self.pairs.clear()
        self.pairs[a << 32 | b] = found
        return found

    def piece(self, data: bytes) -> list[int]:
        """Tokens of each prefix of one piece, by bytes."""
        get, pairs, stable = self.suffixes.get, self.pairs.get, self.stable
        last: list[int] = []
        count: list[int] = []
        for i in range(1, len(data) + 1):
            j = i - 1
            while (token := get(data[j:i])) is not None:
                if token >= 0:
                    if not j:
                        last.append(token)
                        count.append(1)
                        break
                    before = last[j - 1]
                    known = pairs(before << 32 | token)
                    if known or known is None and stable(before, token):
                        last.append(token)
                        count.append(count[j - 1] + 1)
                        break
                j -= 1
                if j < 0:
                    token = None
                    break
            if token is None:
                raise ValueError("the vocabulary doesn't cover all bytes")
        return count

    def chars(self, piece: str) -> np.ndarray:
        """Tokens of each prefix of one piece, by characters."""
        if piece in ("'re", "'ve", "'ll"):  # a shorter prefix of these is two pieces
            return np.array([len(self.encoding.encode_ordinary(piece[:i])) for i in (1, 2, 3)])
        data = piece.encode("utf-8", "replace")
        counts = np.array(self.piece(data), np.int64)
        if len(data) == len(piece):
            return counts
        heads = np.frombuffer(data, np.uint8) & 0xC0 != 0x80
        return counts[np.append(np.flatnonzero(heads)[1:], len(data)) - 1]

    def short(self, piece: str) -> bytes:
        found = self.kept.get(piece)
        if found is None:
            found = self.chars(piece).astype("<u2").tobytes()
            if len(self.kept) >= _CACHE:
                self.kept.clear()
            self.kept[piece] = found
        return found

    def counts(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each character of consecutive texts, the tokens of its text up to and with it."""
        if not len(points):
            return np.zeros(0, np.int64)
        kind = classes(points)
        start = piece_starts(points, offsets, kind)
        at = np.flatnonzero(start)
        ends = np.append(at[1:], len(points))
        text = points.tobytes().decode("utf-32-le", "surrogatepass")
        long_ = np.flatnonzero(ends - at > 4096).tolist()  # their counts may not fit in 16 bits, and aren't kept
        kept, short = self.kept.get, self.short
        pieces = [text[a:b] for a, b in zip(at.tolist(), ends.tolist())]
        for i in long_:
            pieces[i] = ""
        self.kept[""] = b""
        parts = [kept(p) or short(p) for p in pieces]
        if long_:
            wide = {i: self.chars(text[at[i] : ends[i]]) for i in long_}
            inside = np.zeros(len(points), bool)
            for i in long_:
                inside[at[i] : ends[i]] = True
            rel = np.empty(len(points), np.int64)
            rel[~inside] = np.frombuffer(b"".join(parts), "<u2")
            for i, c in wide.items():
                rel[at[i] : ends[i]] = c
        else:
            rel = np.frombuffer(b"".join(parts), "<u2").astype(np.int64)
        done = rel[ends - 1]
        total = np.cumsum(done) - done
        doc = np.searchsorted(offsets, at, "right") - 1
        firsts = np.searchsorted(at, offsets[:-1][np.diff(offsets) > 0])
        base = np.zeros(len(offsets) - 1, np.int64)
        base[np.flatnonzero(np.diff(offsets) > 0)] = total[firsts]
        total = total - base[doc]
        out = rel + np.repeat(total, ends - at)
        space = kind == SPACE
        run = np.flatnonzero(space[:-1] & space[1:])
        if len(run):  # white space of several characters: at the end of a prefix it is one piece
            text_of = np.searchsorted(offsets, run, "right") - 1
            same = run + 1 < offsets[text_of + 1]
            run = run[same]
            breaks = np.flatnonzero(np.diff(run) > 1)
            los, his = run[np.append(0, breaks + 1)] if len(run) else run, run[np.append(breaks, len(run) - 1)] + 2 if len(run) else run
            for lo, hi in zip(los.tolist(), his.tolist()):
                before = out[lo] - rel[lo]  # a run starts a piece
                gap = text[lo:hi]
                out[lo:hi] = before + (np.frombuffer(self.short(gap), "<u2") if hi - lo <= 4096 else self.chars(gap))
        return out


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def encoded(counts: np.ndarray) -> tuple[bytes, int]:
    """Differences of the counts of prefixes 1, 2, ...: little-endian, as many bytes each as the second value says."""
    diff = np.diff(counts, prepend=0)
    width = 1 if not len(diff) or np.abs(diff).max() < 128 else 4
    return diff.astype("<i1" if width == 1 else "<i4").tobytes(), width


def decoded(differences: bytes, width: int) -> np.ndarray:
    """Token counts of the prefixes of 0, 1, 2, ... characters."""
    out = np.zeros(len(differences) // width + 1, np.int64)
    np.cumsum(np.frombuffer(differences, "<i1" if width == 1 else "<i4"), dtype=np.int64, out=out[1:])
    return out


def longest_prefix(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most budget tokens; counts: of prefixes 0, 1, 2, ..."""
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) if len(fits) else 0


def prefix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budgets: Sequence[int] = BUDGETS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens, differences, width, fit_<budget>...) for every row: the tokens of the text, what decoded()
    turns into the exact count of every prefix, and for each budget the longest prefix that it allows.

    The strings of special tokens are ordinary text. A null text has nulls, an empty one 0 tokens and no
    difference. Repeated rows give repeated rows, a null id stays, texts of any length count whole and extra
    columns, whatever their names, are ignored. An empty table gives an empty table.
    """
    picked = pick(docs, id=id_col, text=text_col)
    kind = picked.schema["id"].dataType.simpleString()
    names = [f"fit_{b}" for b in budgets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for batch in batches:
            sizes = np.array([len(t or "") for t in batch.column(1).to_pylist()], np.int64)
            ends, lo = np.cumsum(sizes), 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _CHUNK, "right")))
                part = batch.slice(lo, hi - lo)
                none = part.column(1).is_null().to_numpy(zero_copy_only=False)
                points, offsets = code_points(part.column(1))
                counts = c.counts(points, offsets)
                rows = [counts[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
                stored = [encoded(r) for r in rows]
                fits = []
                for b in budgets:
                    fits.append(pa.array(np.array([len(r) if not len(r) or (r[-1] <= b) else longest_prefix(np.append(0, r), b) for r in rows], np.int32), mask=none))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array([r[-1] if len(r) else 0 for r in rows], np.int64), mask=none), pa.array([None if n else s[0] for n, s in zip(none, stored)], pa.binary()), pa.array(np.array([s[1] for s in stored], np.int32), mask=none), *fits], ["id", "tokens", "differences", "width", *names])
                lo = hi

    found = picked.mapInArrow(run, f"id {kind}, tokens bigint, differences binary, width int" + "".join(f", {n} int" for n in names))
    return found.withColumnRenamed("id", id_col)


def truncate(docs: DataFrame, counted: DataFrame, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, tokens) with each text cut to the longest prefix of at most budget tokens, from stored counts."""

    def cut_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(0, 0) if d is None else (lambda c, n: (n, int(c[n])))(c := decoded(d, w), longest_prefix(c, budget)) for d, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int64())], ["id", "n", "tokens"])

    stored = pick(counted, id=id_col, differences="differences", width="width")
    kind = stored.schema["id"].dataType.simpleString()
    ends = stored.mapInArrow(cut_at, f"id {kind}, n int, tokens bigint")
    return pick(docs, id=id_col, text=text_col).join(ends, "id").select(F.col("id").alias(id_col), F.expr("substring(text, 1, n)").alias(text_col), "tokens")
