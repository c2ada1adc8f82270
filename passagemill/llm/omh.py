"""Near-duplicate detection by order MinHash.

A document is a sequence of words (case and ASCII punctuation aside). Its k-mers are runs of k words,
each labelled by its occurrence number, so that repeats count. One sketch hashes all labelled k-mers of the
whole text, takes the ell smallest and keeps them *in text order*; two documents agree on a sketch only if
they share those k-mers and their order, which makes agreement follow edit similarity, not set overlap.
Documents that agree on any of m sketches are candidates; a banded bit-parallel alignment of the two whole
word sequences verifies each one: near duplicates have 1 - edits / longer length >= threshold.

A text of few words has few k-mers, and scattered edits may leave none. Texts of up to MIDDLE words have sketches of pairs
of words besides; for those of up to SHORT words, keys of their pieces find every pair of them that is near enough.

Plan: one Arrow pass over the texts gives (id, digest of the words, sketches and keys). Equal digests are copies
without a look at the text; one representative of each goes on. Bucket = (sketch number, sketch). Round one
aligns every member of a bucket with the smallest id in it, which joins true groups of any size with
linearly many alignments; round two aligns the pairs of a bucket that are still in different components, so
that nobody's candidate is skipped. Before an alignment, bits and bags of hashed words rule out pairs that cannot be
similar enough; these bounds are never too low, so that they lose nothing. Only ids, lengths, sketches and bags
shuffle, and the texts of the pairs that the bound leaves.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ._common import cut, free_names, frugal, named, pick, sized, utf8
from .components import connected_components

K, ELL, SKETCHES, THRESHOLD = 3, 2, 64, 0.7
#: Texts of so many words at most have sketches of pairs of words too, half as many; SHORT words and fewer, exact keys.
MIDDLE, SHORT = 64, 12
#: Bits of a text that say which of its words' bins are filled.
BITS = 256
SIGNATURE = [f"s{i}" for i in range(BITS // 64)]
#: A bucket counts as hot if so many of a SAMPLED-th of the texts are in it; that decides how it is computed, not what comes out.
HOT, SAMPLED = 64, 64
_SPACE = 0x20
#: ASCII letters in lower case, digits and every byte of other scripts stay; all else separates words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else _SPACE for c in range(256))
_TABLE = np.frombuffer(WORD_BYTES, np.uint8)
_MAX = np.uint64(2**64 - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_CHUNK = 1 << 20


def words_of(text: str) -> list[bytes]:
    """The words of a text, as they are compared."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the rolling base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, _CHUNK)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
                factors = np.full(size, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors))
        return self.up, self.down


_POWERS = _Powers()


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of consecutive texts, and the number of words of each text."""
    n, texts = len(data), len(offsets) - 1
    low = np.full(n + texts, _SPACE, np.uint8)  # a separator after each text
    place = np.arange(n) + np.repeat(np.arange(texts), np.diff(offsets)) if texts else np.zeros(0, np.int64)
    low[place] = _TABLE[data]
    inside = low != _SPACE
    edge = np.diff(inside.astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _POWERS.get(len(low) + 1)
    total = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(low.astype(np.uint64) * up[: len(low)], out=total[1:])
    hashes = _mix((total[end] - total[start]) * down[start])
    firsts = np.searchsorted(start, offsets + np.arange(texts + 1))
    return hashes, np.diff(firsts)


def _labelled(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled k-mer hashes of the texts that have words, one after another, and their numbers.
    A text of fewer than k words is one k-mer."""
    counts = counts[counts > 0]
    ends = np.cumsum(counts)
    starts = ends - counts
    at = np.arange(len(words))
    end_at, start_at = np.repeat(ends, counts), np.repeat(starts, counts)
    kmer = words.copy()
    for j in range(1, k):
        nxt = np.zeros(len(words), np.uint64)
        nxt[:-j] = words[j:]
        nxt[at + j >= end_at] = 0
        kmer = kmer * np.uint64(0x9E3779B97F4A7C15) + nxt
    kmer = _mix(kmer)
    keep = (at == start_at) | (at + k <= end_at)
    kmer, sizes = kmer[keep], np.maximum(1, counts - k + 1)
    doc = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    key = kmer ^ _mix(doc + np.uint64(1))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    occurrence = np.empty(len(key), np.uint64)
    occurrence[order] = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    again = occurrence > 0
    kmer[again] = _mix(kmer[again] + occurrence[again] * np.uint64(0xD6E8FEB86659FD93))
    return kmer, sizes


def order_minhash(kmers: np.ndarray, sizes: np.ndarray, ell: int, m: int) -> np.ndarray:
    """m sketches for each text: the ell smallest hashes of each of m hash functions, in text order, hashed."""
    texts = len(sizes)
    starts = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(texts), sizes)
    rng = np.random.default_rng(20251)
    xor, odd = rng.integers(0, 2**64, m, np.uint64, endpoint=False), rng.integers(0, 2**64, m, np.uint64, endpoint=False) | np.uint64(1)
    out = np.zeros((texts, m), np.uint64)
    place, value = np.empty((texts, ell), np.int64), np.empty((texts, ell), np.uint64)
    for s in range(m):
        hashed = (kmers ^ xor[s]) * odd[s]
        for i in range(ell):
            least = np.minimum.reduceat(hashed, starts)
            hit = np.flatnonzero(hashed == least[doc])[::-1]
            place[doc[hit], i] = hit  # the first place, if there are several
            value[:, i] = kmers[place[:, i]]
            gone = least == _MAX
            value[gone, i], place[gone, i] = 0, len(kmers)
            if i + 1 < ell:
                hashed[place[~gone, i]] = _MAX
        turn = np.argsort(place, axis=1, kind="stable")
        sketch = np.full(texts, s + 1, np.uint64)
        for i in range(ell):
            sketch = _mix(sketch * np.uint64(0x9E3779B97F4A7C15) + np.take_along_axis(value, turn[:, i : i + 1], 1)[:, 0])
        out[:, s] = sketch
    return out


def piece_keys(words: list[int], threshold: float) -> set[int]:
    """Keys of which two texts of up to SHORT words share one if they are as similar as the threshold asks: if e edits
    are allowed, one of e + 1 pieces of the longer text is whole in the other, shifted by what the edits allow."""
    n, out = len(words), set()
    for longer in range(n, SHORT + 1):
        edits, more = int((1 - threshold) * longer + 1e-9), longer - n
        if more > edits:
            continue
        cuts = [i * longer // (edits + 1) for i in range(edits + 2)]
        for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            for at in range(max(0, lo - (edits + more) // 2), min(n - (hi - lo), lo + (edits - more) // 2) + 1):
                out.add(hash((longer, i, *words[at : at + hi - lo])))
    return out


def word_bits(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """BITS bits a text, 64 to a column: which bins its hashed words fall in."""
    out = np.zeros((len(counts), BITS // 64), np.uint64)
    doc, at = np.repeat(np.arange(len(counts)), counts), words >> np.uint64(20)
    np.bitwise_or.at(out, (doc, ((at >> np.uint64(6)) % np.uint64(BITS // 64)).astype(np.int64)), np.uint64(1) << (at & np.uint64(63)))
    return out.view(np.int64)


def _bits_allow(threshold: float) -> Column:
    """False only if the bits of two texts rule the threshold out: a bin that one text fills and the other leaves empty holds
    a word that costs an edit."""
    lone = lambda x, y: reduce(Column.__add__, [F.bit_count(F.col(f"s{i}{x}").bitwiseAND(F.bitwise_not(F.col(f"s{i}{y}")))) for i in range(BITS // 64)])
    return F.greatest(lone("a", "b"), lone("b", "a")) <= F.floor((1 - threshold) * F.greatest("na", "nb") + 1e-9)


def _sketch_batches(k: int, ell: int, m: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            data, offsets = utf8(batch.column(1))
            lo = 0
            while lo < len(ids):  # about a MB of text at a time stays in the cache
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _CHUNK, "right")) - 1)
                part, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                words, counts = word_hashes(part, off)
                has = np.flatnonzero(counts)
                if len(has):
                    sketches = order_minhash(*_labelled(words, counts, k), ell, m)
                    raw = part.tobytes().translate(WORD_BYTES)
                    digests = [hashlib.blake2b(b" ".join(raw[off[i] : off[i + 1]].split()), digest_size=16).digest() for i in has]
                    keys = list(sketches.view(np.int64))
                    few = np.flatnonzero((counts > 0) & (counts <= MIDDLE))
                    if len(few):
                        inner, place = words[np.repeat(counts <= MIDDLE, counts)], np.searchsorted(has, few)
                        pairs = _mix(order_minhash(*_labelled(inner, counts[few], 2), ell, max(1, m // 2)) ^ np.uint64(_BASE)).view(np.int64)
                        for i, own, row in zip(place.tolist(), np.split(inner, np.cumsum(counts[few])[:-1]), pairs):
                            pieces = sorted(piece_keys(own.tolist(), threshold)) if len(own) <= SHORT else []
                            keys[i] = np.concatenate([keys[i], row, np.array(pieces, np.int64)])
                    firsts = np.cumsum([0] + [len(x) for x in keys]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(firsts), pa.array(np.concatenate(keys)))
                    bits = word_bits(words, counts[has])
                    yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).take(pa.array(has)), pa.array(digests, pa.binary()), pa.array(counts[has].astype(np.int32)), lists, *map(pa.array, np.ascontiguousarray(bits.T))], ["id", "digest", "n", "sketches", *SIGNATURE])
                lo = hi

    return run


def banded_distance(a: list, b: list, most: int) -> int:
    """Edits between two sequences, or most + 1 if there are more: Hyyrö's bit-parallel band of 2 * most + 1
    diagonals, in one integer that slides along the diagonal."""
    if len(a) < len(b):
        a, b = b, a
    lo, n, m = 0, len(a), len(b)
    while lo < m and a[lo] == b[lo]:
        lo += 1
    while m > lo and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b = a[lo:n], b[lo:m]
    n, m = len(a), len(b)
    if n - m > most:
        return most + 1
    if m == 0:
        return n
    most_, most = most, min(most, n)
    width = 2 * most + 2
    full = (1 << width) - 1
    masks: dict = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    plus, minus = ((1 << (most + 1)) - 1) << (width - most - 1), 0
    diagonal, flat = 1 << (width - 1), 1 << (width - 2)
    dist, start, limit = most, most + 1 - width, most + m - (n - most)
    for i, w in enumerate(b):
        hit = masks.get(w, 0)
        hit = (hit >> start if start >= 0 else hit << -start) & full
        d0 = ((((hit & plus) + plus) ^ plus) | hit | minus) & full
        hp = minus | (full & ~(d0 | plus))
        hn = d0 & plus
        if i < n - most:
            if not d0 & diagonal:
                dist += 1
        else:
            if hp & flat:
                dist += 1
            elif hn & flat:
                dist -= 1
            flat >>= 1
        if dist > limit:
            return most_ + 1
        d0 >>= 1
        plus = hn | (full & ~(d0 | hp))
        minus = d0 & hp
        start += 1
    return dist if dist <= most else most_ + 1


def edit_similarity(a: list, b: list, threshold: float) -> float:
    """1 - edits / longer length, or 0 below the threshold. A bag of words bounds the edits from below first;
    then the band widens until the alignment fits in it."""
    longest = max(len(a), len(b))
    if not longest:
        return 1.0
    most = int((1 - threshold) * longest + 1e-9)
    if longest - min(len(a), len(b)) > most or longest - sum((Counter(a) & Counter(b)).values()) > most:
        return 0.0
    band = min(most, 8)
    while True:
        d = banded_distance(a, b, band)
        if d <= band:
            return 1 - d / longest
        if band == most:
            return 0.0
        band = min(most, band * 4)


def _verify_batches(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, []
        for batch in batches:
            a, b, ta, tb = (batch.column(i) for i in range(4))
            sims = []
            for i in range(len(a)):
                x = a[i].as_py(), ta[i].as_py()
                if x != last:
                    last, left = x, words_of(x[1])
                sims.append(edit_similarity(left, words_of(tb[i].as_py()), threshold))
            yield pa.RecordBatch.from_arrays([a, b, pa.array(sims, pa.float64())], ["a", "b", "similarity"])

    return run


def bag(hashes: np.ndarray) -> bytes:
    """Counts of the words of a text by hash, in about as many bins as it has words: one byte for the width of a
    count, then the counts. No count saturates."""
    bins = 1 << max(6, int(max(1, len(hashes)) - 1).bit_length())
    counts = np.bincount((hashes & np.uint64(bins - 1)).astype(np.int64), minlength=bins)
    width = 1 if counts.max() < 1 << 8 else 2 if counts.max() < 1 << 16 else 4
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def _counts(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, f"<u{stored[0]}", offset=1).astype(np.int32)


def may_be_similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """False only if the texts of two bags cannot reach the threshold: words that meet in a bin are at least as
    many as words in common, and each of the longer text's other words costs an edit."""
    longest = max(int(a.sum()), int(b.sum()))
    while len(a) > len(b):
        a = a[: len(a) // 2] + a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] + b[len(b) // 2 :]
    return longest - int(np.minimum(a, b).sum()) <= int((1 - threshold) * longest + 1e-9)


def _bag_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _CHUNK, "right")) - 1)
            words, counts = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            bags = [bag(w) for w in np.split(words, np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(bags, pa.binary())], ["id", "bag"])
            lo = hi


def _bound_batches(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, np.zeros(0, np.int32)
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if x != last:
                    last, left = x, _counts(x)
                keep[i] = may_be_similar(left, _counts(y), threshold)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def _of(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts that the pairs, materialised, need."""
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    return texts.join(sized(wanted), "id", "left_semi")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b), materialised, whose texts are as similar as the threshold asks. A bag of hashed words, a
    sixth of a text, bounds the similarity of every pair from above; the texts of those it leaves are aligned."""
    kind = texts.schema["id"].dataType.simpleString()
    bags = cut(_of(pairs, texts).mapInArrow(frugal(_bag_batches), f"id {kind}, bag binary"))
    both = pairs.join(bags.select(F.col("id").alias("b"), F.col("bag").alias("bb")), "b").join(bags.select(F.col("id").alias("a"), F.col("bag").alias("ba")), "a")
    pairs = cut(both.select("a", "b", "ba", "bb").mapInArrow(frugal(_bound_batches(threshold)), f"a {kind}, b {kind}").distinct())
    near = _of(pairs, texts)
    both = pairs.join(near.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(near.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(frugal(_verify_batches(threshold)), f"a {kind}, b {kind}, similarity double").where("similarity > 0")


def _with_hubs(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """(bucket, id, n, hub) of the buckets of rows(bucket, id, n) that several texts are in; hub: the smallest id there.

    One shuffle, and a window over each bucket. A bucket that a large share of the texts is in would be one task's: such are
    found in a sample of the texts, and theirs come from partial aggregates and a join with these few."""
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0)
    hubs = sample.groupBy("bucket").agg(F.count("*").alias("m")).where(F.col("m") >= hot).select("bucket")
    hubs = cut(hubs)
    bucket = W.partitionBy("bucket")
    cold = rows if hubs.isEmpty() else rows.join(sized(hubs), "bucket", "left_anti")
    cold = cold.withColumns({"hub": F.min("id").over(bucket), "last": F.max("id").over(bucket)}).where("hub <> last").select("bucket", "id", "n", "hub")
    if hubs.isEmpty():
        return cold
    warm = rows.join(sized(hubs), "bucket", "left_semi")
    least = cut(warm.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub <> last").select("bucket", "hub"))
    return cold.unionByName(warm.join(sized(least), "bucket").select("bucket", "id", "n", "hub"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, ell: int = ELL, sketches: int = SKETCHES, threshold: float = THRESHOLD, hot: int = HOT) -> DataFrame:
    """(doc_id, duplicate_of): every document that is not the smallest id of its group, and that smallest id.

    Groups are the components of verified pairs and of texts with equal words. Ids are of any type that orders. Null texts, texts without
    a word, and rows without an id are in no group. Repeated rows are one document; an id with several texts is in the groups of each.
    Long texts count whole; extra columns, whatever their names, are ignored; an empty table gives no row.
    """
    texts = pick(docs, id=id_col, text=text_col).where("id is not null and text is not null")
    kind = texts.schema["id"].dataType.simpleString()
    sketched = texts.mapInArrow(frugal(_sketch_batches(k, ell, sketches, threshold)), f"id {kind}, digest binary, n int, sketches array<bigint>, " + ", ".join(f"{s} bigint" for s in SIGNATURE))
    sketched = cut(sketched.groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketches").alias("sketches"), F.collect_set("id").alias("ids"), *[F.first(s).alias(s) for s in SIGNATURE]))
    copies = sketched.where("size(ids) > 1").select(F.col("rep").alias("a"), F.explode("ids").alias("b")).where("a <> b")
    rows = sketched.select(F.col("rep").alias("id"), "n", F.explode("sketches").alias("bucket"))
    rows = cut(_with_hubs(rows, hot))
    star = cut(rows.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
    edges = cut(_verified(star, texts, threshold).select("a", "b"))
    parts = connected_components(edges)
    rows = rows.join(sized(parts), "id", "left").select("bucket", "id", "n", F.coalesce("root", "id").alias("root"))
    rows = cut(rows)
    split = cut(rows.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket"))
    # texts whose lengths differ too much for the threshold do not meet: a bucket is cut into bands of lengths, and only
    # neighbouring ones join
    rows = cut(rows.join(sized(split), "bucket").withColumn("band", F.floor(F.log("n") / float(np.log(1 / threshold)) + 1e-9) if threshold < 1 else F.col("n").cast("bigint")))
    rows = rows.join(sized(cut(sketched.select(F.col("rep").alias("id"), *SIGNATURE).join(sized(cut(rows.select("id").distinct())), "id", "left_semi"))), "id")
    left, right = (rows.select("bucket", "band", *[F.col(c).alias(c + x) for c in ("id", "n", "root", *SIGNATURE)]) for x in "ab")
    right = right.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    cross = left.join(right, ["bucket", "band"]).where("ida < idb and roota <> rootb").where(_bits_allow(threshold))
    cross = cross.where(F.least("na", "nb") >= F.greatest("na", "nb") * (threshold - 1e-9)).select(F.col("ida").alias("a"), F.col("idb").alias("b")).distinct()
    cross = cut(cross.join(star, ["a", "b"], "left_anti"))
    more = _verified(cross, texts, threshold).select("a", "b")
    groups = connected_components(edges.union(more).union(copies))
    return groups.where("id <> root").select(F.col("id").alias("doc_id"), F.col("root").alias("duplicate_of"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, all columns, without those near_duplicates() names; clashing names as in free_names()."""
    gone = cut(near_duplicates(docs, id_col, text_col, **how).select(F.col("doc_id").alias("gone__")))
    docs = free_names(docs)
    return docs.join(sized(gone), docs[named(docs, id_col)] == F.col("gone__"), "left_anti")
