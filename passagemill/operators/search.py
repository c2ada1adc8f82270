"""Indexes and searches: BM25, TF-IDF, dense vectors, compressed vectors, and the fusion of ranked lists.

The query side of a search is a bounded slab: queries go to the tasks in slabs of a checked size, each slab is one pass
over the rows, and a task sends k rows a query, so that neither postings nor pairs of a query and a row shuffle. Scores are
rounded to six places before they are ranked, so that equal scores tie whatever the order of summation; ties go to the
smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import ranking, text as tx
from ..runtime import cut, frugal, pieces

K1, B = 1.5, 0.75
#: What one slab of queries may hold: pairs of a query and a term, and elements of dense vectors.
SLAB_TERMS, SLAB_ELEMENTS = 2_000_000, 8_000_000


def top_k(scored: DataFrame, k: int, id_col: str = "chunk_id", by: str = "score") -> DataFrame:
    """(query_id, id, score, rank): the k best of each query."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(by), F.asc(id_col)))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def slabs(table: DataFrame, id_col: str, size: int, most: int) -> list[DataFrame]:
    """The table in parts of about most of its size units each, by hashed id."""
    n = max(1, -(-size // most))
    return [table.where(F.pmod(F.xxhash64(id_col), F.lit(n)) == i) for i in range(n)] if n > 1 else [table]


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _words(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", tx.words(F.col("text")).alias("w")).where("w is not null")


def _nothing(spark: SparkSession, query: str, id_col: str = "chunk_id", kind: str = "string") -> DataFrame:
    return spark.createDataFrame([], f"query_id {query}, {id_col} {kind}, score double")


def _collected(part: DataFrame) -> tuple[list, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Queries, terms, and the entries (query, term, weight) of a slab of (query_id, term, weight)."""
    rows = part.collect()  # at most SLAB_TERMS entries
    queries: dict = {}
    terms: dict[str, int] = {}
    q = np.array([queries.setdefault(r[0], len(queries)) for r in rows], np.int64)
    t = np.array([terms.setdefault(r[1], len(terms)) for r in rows], np.int64)
    return list(queries), list(terms), q, t, np.array([r[2] for r in rows], np.float64)


def bm25(chunks: DataFrame, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """chunks(chunk_id, text), queries(query_id, text) -> (query_id, chunk_id, score, rank). A term counts as often as
    the query repeats it; chunks without a term of the query are absent.

    Two passes over the texts a slab of queries: one counts the documents that have its terms, the other scores."""
    return top_k(_bm25(chunks, queries, k, [(k1, b)]).drop("run"), k)


def bm25_runs(chunks: DataFrame, queries: DataFrame, k: int, ways: Sequence[tuple[float, float]]) -> list[DataFrame]:
    """bm25() for each (k1, b), all in the two passes of one. What the tasks kept is materialised, k rows a query and task."""
    found = cut(_bm25(chunks, queries, k, ways))
    return [top_k(found.where(F.col("run") == i).drop("run"), k) for i in range(len(ways))]


def _bm25(chunks: DataFrame, queries: DataFrame, k: int, ways: Sequence[tuple[float, float]]) -> DataFrame:
    """(run, query_id, chunk_id, score): what the tasks kept, run by run of the (k1, b) in ways."""
    spark, kind = chunks.sparkSession, queries.schema["query_id"].dataType.simpleString()
    asked = queries.select("query_id", F.explode(tx.words(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").cast("double").alias("weight"))
    words, found = _words(chunks), []
    for part in slabs(asked, "query_id", asked.count(), SLAB_TERMS):
        ids, terms, q, t, weight = _collected(part)
        if not ids:
            continue
        vocabulary = pa.array(terms, pa.string())

        def count(batches: Iterator[pa.RecordBatch], vocabulary: pa.Array = vocabulary) -> Iterator[pa.RecordBatch]:
            df, n, total = np.zeros(len(vocabulary), np.int64), 0, 0
            for part in (p for batch in batches for p in pieces(batch, 0)):
                _, term, _, lengths = ranking.postings(part.column(0), vocabulary)
                df += np.bincount(term, minlength=len(vocabulary))
                n, total = n + len(lengths), total + int(lengths.sum())
            flat = np.concatenate([df, [n, total]])
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], ["i", "n"])

        sums = np.zeros(len(terms) + 2)
        for r in words.select("w").mapInArrow(frugal(count), "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect():  # a row a term
            sums[r["i"]] = r["n"]
        df, n, total = sums[:-2], sums[-2], sums[-1]
        if not n:
            continue
        idf, mean = np.log(1 + (n - df + 0.5) / (df + 0.5)), total / n
        held = spark.sparkContext.broadcast((ranking.Asked(_ids(ids, queries), vocabulary, q, t, weight), idf))

        def scan(batches: Iterator[pa.RecordBatch], held=held, mean: float = mean) -> Iterator[pa.RecordBatch]:
            asked_, idf_ = held.value

            def weigh(k1: float, b: float) -> Callable[[ranking.Postings], np.ndarray]:
                def of(p: ranking.Postings) -> np.ndarray:
                    row, term, f, lengths = p
                    return idf_[term] * f * (k1 + 1) / (f + k1 * (1 - b + b * lengths[row] / (mean or 1)))

                return of

            yield from ranking.sparse_scan(asked_, [weigh(*way) for way in ways], k)(batches)

        found.append(words.mapInArrow(scan, f"run int, query_id {kind}, chunk_id string, score double"))
    return _union(found or [_nothing(spark, kind).select(F.lit(0).alias("run"), "*")])


def _ids(values: list, like: DataFrame) -> pa.Array:
    """Query ids of any type as Arrow takes them."""
    plain = [v.asDict() if hasattr(v, "asDict") else v for v in values]
    return pa.array(plain, to_arrow_type(like.schema["query_id"].dataType))


def tfidf_search(chunks: DataFrame, queries: DataFrame, idf: DataFrame, k: int = 10) -> DataFrame:
    """Top k by the product of TF-IDF rows of chunks(chunk_id, text) and queries(query_id, text); idf: of tfidf_fit(). One pass
    over the texts a slab of queries; the vocabulary is at most as large as tfidf_fit() was told."""
    from .embed import tfidf_rows, tfidf_weights

    spark, kind = chunks.sparkSession, queries.schema["query_id"].dataType.simpleString()
    known = {r["term"]: r["idf"] for r in idf.collect()}  # at most the features of tfidf_fit()
    vocabulary, idfs = pa.array(list(known), pa.string()), np.array(list(known.values()), np.float64)
    place = {t: i for i, t in enumerate(known)}
    asked = tfidf_rows(queries, idf, "query_id").select("query_id", "term", "weight")
    words, found = _words(chunks), []
    for part in slabs(asked, "query_id", asked.count(), SLAB_TERMS):
        ids, terms, q, t, weight = _collected(part)
        if not ids:
            continue
        to = np.array([place[x] for x in terms], np.int64)
        held = spark.sparkContext.broadcast(ranking.Asked(_ids(ids, queries), vocabulary, q, to[t], weight))

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            yield from ranking.sparse_scan(held.value, [lambda p: tfidf_weights(p, idfs)], k)(batches)

        found.append(words.mapInArrow(scan, f"run int, query_id {kind}, chunk_id string, score double").drop("run"))
    return top_k(_union(found or [_nothing(spark, kind)]), k)


def doubles(v: str | Column) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalise(v: str | Column) -> Column:
    """A vector of length one; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(doubles(v), lambda x: F.when(norm > 0, x / norm).otherwise(x))


def matrix(col: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix of doubles."""
    return np.asarray(col.flatten(), np.float64).reshape(len(col), -1)


def scan_topk(rows: DataFrame, queries: DataFrame, k: int, read: Callable[[pa.Array], np.ndarray], score: Callable[[np.ndarray, np.ndarray], np.ndarray], id_col: str = "vec_id", skip_self: bool = False, width: int = 64) -> DataFrame:
    """(query_id, id, score): exact top k of rows(id, payload) for queries(query_id, payload); a task keeps k a query over all
    of its rows. read: a column of payloads as an array; score: a matrix of queries by rows; width: elements of a query."""
    spark = rows.sparkSession
    kind, asks = rows.schema[0].dataType.simpleString(), queries.schema[0].dataType.simpleString()
    found = []
    for part in slabs(queries, queries.columns[0], queries.count() * max(1, width), SLAB_ELEMENTS):
        table = part.toArrow()  # at most SLAB_ELEMENTS elements
        if not table.num_rows:
            continue
        names, payload = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns)
        shared = spark.sparkContext.broadcast((names, read(payload)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            qi = names.to_numpy(zero_copy_only=False)
            keeper = ranking.Keeper(len(qi), k)
            step = max(1, ranking.CELLS // len(qi))
            for part in (p for batch in batches for p in (pieces(batch) if batch.num_rows else ())):
                ids = part.column(0).to_numpy(zero_copy_only=False)
                x = read(part.column(1))
                for lo in range(0, len(ids), step):
                    s = np.round(score(q, x[lo : lo + step]), 6) + 0.0
                    if skip_self:
                        s[qi[:, None] == ids[lo : lo + step]] = -np.inf
                    keeper.add_block(s, ids[lo : lo + step])
            at, ids, s = keeper.compact()
            yield pa.RecordBatch.from_arrays([names.take(pa.array(at)), pa.array(ids), pa.array(s)], ["query_id", id_col, "score"])

        found.append(rows.mapInArrow(frugal(run), f"query_id {asks}, {id_col} {kind}, score double"))
    return _union(found or [_nothing(spark, asks, id_col, kind)])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


SCORES: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "cosine": lambda q, x: unit(q) @ unit(x).T,
    "dot": lambda q, x: q @ x.T,
    "l2": lambda q, x: -((q**2).sum(1)[:, None] + (x**2).sum(1) - 2 * (q @ x.T)),
}


def dimensions(vectors: DataFrame) -> int:
    return vectors.agg(F.max(F.size("embedding"))).first()[0] or 0


def dense(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", id_col: str = "vec_id", skip_self: bool = True, query_col: str | None = None) -> DataFrame:
    """Exact search: (query_id, id, score, rank). metric: cosine, dot or l2 (negated). Null and empty vectors are nothing's
    neighbour; a vector of another dimension than the first raises."""
    if metric not in SCORES:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(SCORES)}")
    asked = queries.where("size(embedding) > 0").select(F.col(query_col or id_col).alias("query_id"), doubles("embedding").alias("v"))
    rows = vectors.where("size(embedding) > 0").select(id_col, doubles("embedding").alias("v"))
    return top_k(scan_topk(rows, asked, k, matrix, SCORES[metric], id_col, skip_self, dimensions(queries)), k, id_col)


def rrf(lists: list[DataFrame], k: int = 10, c: int = 60, id_col: str = "chunk_id") -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (c + rank) over the lists that have the id."""
    parts = [x.select("query_id", id_col, (F.lit(1.0) / (F.lit(float(c)) + F.col("rank"))).alias("s")) for x in lists]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return top_k(both.groupBy("query_id", id_col).agg(F.round(F.sum("s"), 6).alias("score")), k, id_col)


def min_max(hits: DataFrame) -> DataFrame:
    """Scores of each query from 0 to 1; a flat list is 1 throughout."""
    w = W.partitionBy("query_id")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return hits.withColumn("score", F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(F.lit(1.0)))


def weighted(dense_hits: DataFrame, sparse_hits: DataFrame, k: int = 10, alpha: float = 0.5, id_col: str = "chunk_id") -> DataFrame:
    """alpha * dense + (1 - alpha) * sparse, each normalised by query; what a list lacks counts 0."""
    a = min_max(dense_hits).select("query_id", id_col, F.col("score").alias("a"))
    b = min_max(sparse_hits).select("query_id", id_col, F.col("score").alias("b"))
    both = a.join(b, ["query_id", id_col], "full_outer")
    score = alpha * F.coalesce("a", F.lit(0.0)) + (1.0 - alpha) * F.coalesce("b", F.lit(0.0))
    return top_k(both.select("query_id", id_col, F.round(score, 6).alias("score")), k, id_col)


def _elements(vectors: DataFrame) -> DataFrame:
    return vectors.select("vec_id", F.posexplode(doubles("embedding")).alias("dim", "x"))


def scalar_quantise(vectors: DataFrame) -> DataFrame:
    """(vec_id, codes): each dimension's range in 255 equal steps; a constant dimension has the range 1."""
    e = _elements(vectors)
    ranges = e.groupBy("dim").agg(F.min("x").alias("lo"), (F.max("x") - F.min("x")).alias("span"))
    step = F.when(F.col("span") > 0, F.col("span")).otherwise(F.lit(1.0)) / 255.0
    code = F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.rint((F.col("x") - F.col("lo")) / step))).cast("int")
    coded = e.join(F.broadcast(ranges), "dim").select("vec_id", F.struct("dim", code.alias("c")).alias("p"))
    return coded.groupBy("vec_id").agg(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["c"]).alias("codes"))


def means(vectors: DataFrame) -> np.ndarray:
    """The mean of each dimension, to nine places."""
    rows = vectors.select(F.posexplode(doubles("embedding")).alias("dim", "x")).groupBy("dim").agg(F.round(F.avg("x"), 9).alias("mean")).collect()  # a row a dimension
    return np.array([r["mean"] for r in sorted(rows)], np.float64)


def pack_bits(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Whether each element is above its dimension's mean, 64 to a word."""
    bits = np.packbits(x > mean, axis=1)
    return np.ascontiguousarray(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))).view(np.uint64)


def hamming(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bits that differ between each row of q and each of x."""
    out = np.zeros((len(q), len(x)), np.int64)
    for w in range(q.shape[1]):
        out += np.bitwise_count(q[:, w, None] ^ x[:, w])
    return out


def words_of(col: pa.Array) -> np.ndarray:
    """A column of equally long binary codes as a matrix of 64-bit words."""
    return np.frombuffer(b"".join(col.to_pylist()), np.uint64).reshape(len(col), -1)


def binary_codes(vectors: DataFrame, mean: np.ndarray, id_col: str = "vec_id") -> DataFrame:
    """(id, code): a bit a dimension, packed; one pass."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                packed = pack_bits(matrix(batch.column(1)), mean)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in packed], pa.binary())], [id_col, "code"])

    return vectors.where("size(embedding) > 0").select(id_col, doubles("embedding")).mapInArrow(run, f"{id_col} {kind}, code binary")


def rescored(hits: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", query_col: str | None = None) -> DataFrame:
    """A shortlist ranked again by the original product."""
    q = queries.select(F.col(query_col or id_col).alias("query_id"), F.col("embedding").alias("qe"))
    again = hits.select("query_id", id_col).join(q, "query_id").join(vectors.select(id_col, "embedding"), id_col)
    return top_k(again.select("query_id", id_col, F.round(dot("qe", "embedding"), 6).alias("score")), k, id_col)


def binary_search(vectors: DataFrame, queries: DataFrame, k: int = 10, rescore: int = 0, id_col: str = "vec_id", skip_self: bool = True, query_col: str | None = None) -> DataFrame:
    """Top k by bits that agree (score: bits that differ, negated); with rescore, the best so many are ranked again by the
    original product. What is scanned is a bit a dimension."""
    mean = means(vectors)
    codes, asked = binary_codes(vectors, mean, id_col), binary_codes(queries, mean, query_col or id_col)
    near = scan_topk(codes, asked, max(k, rescore), words_of, lambda q, x: -hamming(q, x).astype(np.float64), id_col, skip_self, len(mean) // 64 + 1)
    near = top_k(near, max(k, rescore), id_col)
    return rescored(near, vectors, queries, k, id_col, query_col) if rescore else near


def recall_against(approximate: DataFrame, exact: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """(recall): the mean share of each query's exact list that the other list has."""
    hit = exact.select("query_id", id_col).join(approximate.select("query_id", id_col, F.lit(1).alias("hit")), ["query_id", id_col], "left")
    each = hit.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("r"))
    return each.agg(F.round(F.avg("r"), 6).alias("recall"))


def adjacent_cosine(vectors: DataFrame, group: str, order: str) -> DataFrame:
    """(order column, cosine): each vector and the next of its group."""
    w = W.partitionBy(group).orderBy(order)
    unit = vectors.withColumn("u", normalise("embedding"))
    return unit.withColumn("v", F.lead("u").over(w)).where("v is not null").select(group, order, F.round(dot("u", "v"), 6).alias("cosine"))


def embedding_quality(vectors: DataFrame) -> DataFrame:
    """(n, anisotropy, participation): the mean cosine of all pairs, from the sum of unit vectors, and the effective
    number of dimensions, tr(C)^2 / tr(C C) of the covariance. One pass; no pair is formed."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, m, u = 0, None, None, None
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), np.float64)
            if not len(x):
                continue
            unit = x / np.where((r := np.linalg.norm(x, axis=1, keepdims=True)) > 0, r, 1)
            n += len(x)
            s = x.sum(0) + (0 if s is None else s)
            m = x.T @ x + (0 if m is None else m)
            u = unit.sum(0) + (0 if u is None else u)
        if n:
            flat = np.concatenate([[n], s, u, m.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "x"])

    parts = vectors.select(doubles("embedding").alias("v")).where("size(v) > 0").mapInArrow(moments, "i bigint, x double").groupBy("i").agg(F.sum("x").alias("x"))

    def finish(pdf):
        import pandas as pd

        flat = pdf.sort_values("i")["x"].to_numpy()
        d = int((-2 + np.sqrt(4 + 4 * (len(flat) - 1))) / 2)
        n, s, u, m = flat[0], flat[1 : d + 1], flat[d + 1 : 2 * d + 1], flat[2 * d + 1 :].reshape(d, d)
        c = m / n - np.outer(s / n, s / n)
        pairs = (u @ u - n) / (n * (n - 1)) if n > 1 else 0.0
        return pd.DataFrame([(int(n), round(float(pairs), 6), round(float(np.trace(c) ** 2 / max((c * c).sum(), 1e-300)), 6))], columns=["n", "anisotropy", "participation"])

    return parts.groupBy().applyInPandas(lambda pdf: finish(pdf), "n bigint, anisotropy double, participation double")


def _moments(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, sums of unit vectors, sums of the vectors, and of their products: one pass, d * d numbers from each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, parts = 0, None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                u = unit(x)
                now = np.concatenate([u.sum(0), x.sum(0), (x.T @ x).ravel()])
                n, parts = n + len(x), now if parts is None else parts + now
        if n:
            flat = np.concatenate([[n], parts])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "x"])

    rows = vectors.where("size(embedding) > 0").select(doubles("embedding").alias("v")).mapInArrow(run, "i bigint, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()  # d * d + 2 * d + 1 numbers
    flat = np.array([r["x"] for r in rows])
    d = int(round((-2 + np.sqrt(4 + 4 * max(0, len(flat) - 1))) / 2))
    return (int(flat[0]), flat[1 : d + 1], flat[d + 1 : 2 * d + 1], flat[2 * d + 1 :].reshape(d, d)) if len(flat) else (0, np.zeros(0), np.zeros(0), np.zeros((0, 0)))


def quality_report(chunks: DataFrame, every: int = 50, near: float = 0.99, alike: float = 0.75, least_pairs: int = 10) -> dict[str, float | None]:
    """What vectors say of chunks(chunk_id bigint, doc_id, start, text, embedding): anisotropy, the mean cosine of chunks of
    different documents, exact from sums; separation, how much closer neighbours in a document are, and redundancy, the
    reverse, both None with fewer than least_pairs neighbours; participation, the effective dimensions; collapsed, the share of
    the chunks whose id every divides whose nearest neighbour of all is as good as equal though its words are others; and score, a
    mean from 0 to 1 in which separation, held against 0.25, counts twice."""
    n, total, s, m = _moments(chunks)
    if n < 4:
        raise ValueError(f"{n} chunks are too few")

    def within(group: pa.Table) -> pa.Table:
        """A document's chunks, of which it has as many as its text is long."""
        group = group.sort_by("start")
        u = unit(matrix(pa.concat_arrays(group["v"].chunks)))
        return pa.table({"n": [len(u)], "sq": [float(((u.sum(0)) ** 2).sum())], "adjacent": [float((u[1:] * u[:-1]).sum())], "pairs": [len(u) - 1]})

    by = chunks.where("size(embedding) > 0").select("doc_id", "start", doubles("embedding").alias("v")).groupBy("doc_id").applyInArrow(within, "n bigint, sq double, adjacent double, pairs bigint")
    r = by.agg(F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum("sq").alias("sq"), F.sum("adjacent").alias("adjacent"), F.sum("pairs").alias("pairs")).first()
    across = n * n - r["nn"]
    anisotropy = float((total @ total - r["sq"]) / across) if across else float((total @ total - n) / (n * (n - 1)))
    coherence = r["adjacent"] / r["pairs"] if r["pairs"] >= least_pairs else None
    c = m / n - np.outer(s / n, s / n)
    participation = float(np.trace(c) ** 2 / max((c * c).sum(), 1e-300)) if np.trace(c) > 0 else 0.0
    asked = chunks.where(F.pmod(F.col("chunk_id"), F.lit(every)) == 0)
    nearest = dense(chunks, asked, 1, id_col="chunk_id").where(F.col("score") >= near)
    bags = chunks.select("chunk_id", F.array_distinct(tx.words(F.col("text"))).alias("w"))
    both = nearest.join(bags, "chunk_id").join(bags.select(F.col("chunk_id").alias("query_id"), F.col("w").alias("x")), "query_id")
    same = F.when(F.size(F.array_union("w", "x")) > 0, F.size(F.array_intersect("w", "x")) / F.size(F.array_union("w", "x"))).otherwise(F.lit(1.0))
    collapsed = both.where(same < alike).count() / max(1, asked.count())
    clamp = lambda x: min(1.0, max(0.0, x))
    parts = [clamp(1 - anisotropy), clamp(4 * participation / len(total)), clamp(1 - collapsed)]
    if coherence is not None:
        parts += [clamp((coherence - anisotropy) / 0.25)] * 2
    return {"chunks": n, "anisotropy": anisotropy, "separation": None if coherence is None else coherence - anisotropy, "redundancy": None if coherence is None else anisotropy - coherence, "participation": participation, "collapsed": collapsed, "score": sum(parts) / len(parts)}
