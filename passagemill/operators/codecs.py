"""Product codes, inverted lists and the linear adapter of dense vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window as W, functions as F

from . import search
from ..functions import ranking
from ..runtime import cut
from .search import dense, doubles, matrix, scan_topk, top_k

#: Queries whose exact neighbours decide how deep the compressed searches look.
SAMPLE = 256
#: Vectors of a list that one task searches.
PART = 65_536


def _kmeans(vectors: DataFrame, k: int, iterations: int, seed: int) -> np.ndarray:
    """Centroids of all vectors(v); one is their mean."""
    if k < 2:
        rows = vectors.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x")).collect()  # a row a dimension
        return np.array([[r["x"] for r in sorted(rows)]])
    fitted = KMeans(k=k, maxIter=iterations, seed=seed, featuresCol="f").fit(vectors.select(array_to_vector("v").alias("f")))
    return np.array(fitted.clusterCenters())


def product_fit(vectors: DataFrame, subspaces: int = 8, centroids: int = 256, iterations: int = 12, seed: int = 0) -> np.ndarray:
    """(subspaces, centroids, d / subspaces): k-means over all vectors in each part of the dimensions. Centroids are as many
    as the vectors at most."""
    d = vectors.agg(F.max(F.size("embedding"))).first()[0]
    if d % subspaces:
        raise ValueError(f"{d} dimensions do not divide into {subspaces} parts")
    width = d // subspaces
    part = [_kmeans(vectors.select(F.slice(doubles("embedding"), 1 + s * width, width).alias("v")), centroids, iterations, seed) for s in range(subspaces)]
    most = max(len(p) for p in part)
    return np.stack([np.concatenate([p, np.full((most - len(p), width), np.inf)]) for p in part])


def _sample(queries: DataFrame, id_col: str = "vec_id") -> tuple[DataFrame, bool]:
    """The queries with the smallest hashed ids, and whether these are all."""
    return queries.orderBy(F.xxhash64(id_col), F.col(id_col).cast("string")).limit(SAMPLE), queries.count() <= SAMPLE


def _least(needs: pd.DataFrame, recall: float, whole: bool) -> int | None:
    """needs(query_id, need: the depth at which an exact neighbour is found) -> the least depth of that mean recall, less
    three standard errors unless the queries are all there are; None if no depth has it."""
    for depth in sorted(needs["need"].replace(np.inf, np.nan).dropna().unique()):
        each = (needs["need"] <= depth).groupby(needs["query_id"]).mean()
        error = 0.0 if whole or len(each) < 2 else 3 * float(each.std()) / len(each) ** 0.5
        if each.mean() - error >= recall:
            return int(depth)
    return None


def product_depth(vectors: DataFrame, queries: DataFrame, codebook: np.ndarray, k: int = 10, recall: float = 0.9) -> int:
    """The shortlist that product_search() has to rescore for this recall of the exact product, by sampled queries."""
    n, (asked, whole) = vectors.count(), _sample(queries)
    exact = dense(vectors, asked, k, "dot").select("query_id", "vec_id").toPandas()  # k rows a sampled query
    deep = max(k, 512)
    while len(exact) and deep < n:
        ranks = product_search(vectors, asked, codebook, deep).select("query_id", "vec_id", "rank").toPandas()
        needs = exact.merge(ranks, "left", ["query_id", "vec_id"]).rename(columns={"rank": "need"})
        found = _least(needs.fillna({"need": np.inf}), recall, whole)
        if found is not None:
            return max(k, found)
        deep *= 4
    return max(k, n)


def product_codes(vectors: DataFrame, codebook: np.ndarray, id_col: str = "vec_id") -> DataFrame:
    """(id, code): the nearest centroid in each part of the dimensions, a byte or two each."""
    subspaces, most, width = codebook.shape
    shared = vectors.sparkSession.sparkContext.broadcast(codebook)
    small = np.uint8 if most <= 256 else np.uint16
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                x = matrix(part.column(1)).reshape(part.num_rows, subspaces, width)
                near = np.stack([((x[:, i, None] - book[None, i]) ** 2).sum(-1).argmin(1) for i in range(subspaces)], 1).astype(small)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in near], pa.binary())], [id_col, "code"])

    return vectors.where("size(embedding) > 0").select(id_col, doubles("embedding")).mapInArrow(run, f"{id_col} {kind}, code binary")


def _doubles_of(queries: DataFrame, query_col: str) -> DataFrame:
    """(query_id, code): vectors as the bytes of their doubles."""
    kind = queries.schema[query_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in matrix(batch.column(1))], pa.binary())], ["query_id", "code"])

    return queries.where("size(embedding) > 0").select(F.col(query_col).alias("query_id"), doubles("embedding")).mapInArrow(run, f"query_id {kind}, code binary")


def _coded_search(codes: DataFrame, queries: DataFrame, depth: int, kind: type, width: int, score: Callable[[np.ndarray, np.ndarray], np.ndarray], id_col: str, skip_self: bool, query_col: str | None) -> DataFrame:
    """Top depth of codes of so many elements each, for queries that stay as they are."""
    code_bytes, d = width * np.dtype(kind).itemsize, search.dimensions(queries)

    def read(col: pa.Array) -> np.ndarray:
        flat = b"".join(col.to_pylist())
        return np.frombuffer(flat, kind if len(flat) == len(col) * code_bytes else np.float64).reshape(len(col), -1)

    if code_bytes == 8 * d:
        raise ValueError("codes are as wide as the vectors")
    asked = _doubles_of(queries, query_col or id_col)
    return top_k(scan_topk(codes, asked, depth, read, score, id_col, skip_self, d), depth, id_col)


def product_search(vectors: DataFrame, queries: DataFrame, codebook: np.ndarray, k: int = 10, rescore: int = 0, id_col: str = "vec_id", skip_self: bool = True, query_col: str | None = None) -> DataFrame:
    """(query_id, id, score, rank): top k by the product of the query and a vector's nearest centroids, from tables of the
    products of each query's parts with all centroids; with rescore, the best so many are ranked again by the original product."""
    subspaces, most, width = codebook.shape
    book = np.where(np.isfinite(codebook), codebook, 0)

    def score(q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        parts = q.reshape(len(q), subspaces, width)
        out = np.zeros((len(q), len(codes)))
        for i in range(subspaces):
            out += (parts[:, i] @ book[i].T)[:, codes[:, i]]
        return out

    near = _coded_search(product_codes(vectors, codebook, id_col), queries, max(k, rescore), np.uint8 if most <= 256 else np.uint16, subspaces, score, id_col, skip_self, query_col)
    return search.rescored(near, vectors, queries, k, id_col, query_col) if rescore else near


def scalar_fit(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The least element of each dimension, and the step of 255 to the largest; a constant dimension has the range 1."""
    e = vectors.select(F.posexplode(doubles("embedding")).alias("dim", "x"))
    rows = sorted(e.groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect())  # a row a dimension
    lo, hi = np.array([r["lo"] for r in rows], np.float64), np.array([r["hi"] for r in rows], np.float64)
    return lo, np.where(hi > lo, hi - lo, 1.0) / 255.0


def scalar_search(vectors: DataFrame, queries: DataFrame, fitted: tuple[np.ndarray, np.ndarray], k: int = 10, rescore: int = 0, id_col: str = "vec_id", skip_self: bool = True, query_col: str | None = None) -> DataFrame:
    """Top k by the product of the query and a vector's codes of a byte a dimension; rescore as in product_search()."""
    lo, step = fitted
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = np.clip(np.rint((matrix(batch.column(1)) - lo) / step), 0, 255).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in codes], pa.binary())], [id_col, "code"])

    codes = vectors.where("size(embedding) > 0").select(id_col, doubles("embedding")).mapInArrow(run, f"{id_col} {kind}, code binary")
    near = _coded_search(codes, queries, max(k, rescore), np.uint8, len(lo), lambda q, c: q @ (c * step + lo).T, id_col, skip_self, query_col)
    return search.rescored(near, vectors, queries, k, id_col, query_col) if rescore else near


CODECS = ("none", "scalar", "product", "binary")


def quantized_search(vectors: DataFrame, queries: DataFrame, codec: str = "scalar", k: int = 10, rescore: int = 0, subspaces: int = 8, id_col: str = "vec_id", skip_self: bool = True, query_col: str | None = None) -> DataFrame:
    """Fit the codec to all vectors, search their codes; rescore: how many of the best are ranked again by the original product."""
    same = {"id_col": id_col, "skip_self": skip_self, "query_col": query_col}
    if codec == "none":
        return dense(vectors, queries, k, "dot", **same)
    if codec == "scalar":
        return scalar_search(vectors, queries, scalar_fit(vectors), k, rescore, **same)
    if codec == "product":
        return product_search(vectors, queries, product_fit(vectors, subspaces), k, rescore, **same)
    if codec == "binary":
        return search.binary_search(vectors, queries, k, rescore, **same)
    raise ValueError(f"unknown codec {codec!r}; known: {', '.join(CODECS)}")


def ivf_search(vectors: DataFrame, queries: DataFrame, k: int = 10, lists: int = 100, probes: int = 8, seed: int = 0, recall: float = 0.9, id_col: str = "vec_id", skip_self: bool = True, query_col: str | None = None) -> DataFrame:
    """Top k by cosine among the probes nearest inverted lists, or more, as sampled queries need for the recall. Lists are
    at most one for 39 vectors. A query meets a list once, and a list is searched where it lies; AQE splits no group, so that
    lists of more than PART vectors are dealt over several tasks."""
    unit = vectors.where("size(embedding) > 0").select(F.col(id_col).alias("id"), search.normalise("embedding").alias("v"))
    asks = queries.where("size(embedding) > 0").select(F.col(query_col or id_col).alias("id"), search.normalise("embedding").alias("v"))
    n = vectors.count()
    centres = _kmeans(unit, max(1, min(lists, n // 39)), 12, seed)
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def order(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.argsort(((c**2).sum(1) - 2 * (x @ c.T)), axis=1, kind="stable")

    def needed() -> int:
        """Probes that the sampled queries need to meet the lists of their exact neighbours."""
        asked, whole = _sample(asks, "id")
        mine = asked.toPandas()  # at most SAMPLE rows
        exact = scan_topk(unit, asked, k, matrix, lambda q, x: q @ x.T, "id", skip_self, centres.shape[1])
        exact = top_k(exact, k, "id").select("query_id", "id").toPandas()
        if not len(exact):
            return probes
        near = unit.join(F.broadcast(vectors.sparkSession.createDataFrame(exact[["id"]].drop_duplicates(), unit.select("id").schema)), "id", "left_semi").toPandas()
        home = dict(zip(near["id"], order(np.array(near["v"].tolist()), centres)[:, 0]))
        turn = dict(zip(map(str, mine["id"]), np.argsort(order(np.array(mine["v"].tolist()), centres), axis=1)))
        exact["need"] = [1.0 + turn[str(q)][home[v]] for q, v in zip(exact["query_id"], exact["id"])]
        exact["query_id"] = exact["query_id"].map(str)
        return _least(exact, recall, whole) or len(centres)

    most = min(max(probes, needed()), len(centres))

    def nearest(most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = shared.value
            for batch in batches:
                at = order(matrix(batch.column(1)), c)[:, :most] if batch.num_rows else np.zeros((0, 1), np.int64)
                rows = pa.array(np.repeat(np.arange(len(at)), at.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at.ravel())], ["id", "v", "list"])

        return run

    kinds = [f"id {t.schema['id'].dataType.simpleString()}, v array<double>, list bigint" for t in (unit, asks)]
    held, asked = unit.mapInArrow(nearest(1), kinds[0]), asks.mapInArrow(nearest(most), kinds[1])
    sizes = cut(held.groupBy("list").agg(F.ceil(F.count("*") / F.lit(PART)).cast("int").alias("parts")))  # a row a list
    held = held.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
    asked = asked.join(F.broadcast(sizes), "list").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1))).drop("parts")

    def within(asked: pa.Table, held: pa.Table) -> pa.Table:
        """The k best of a part of a list for each query that probes it."""
        schema = pa.schema([("query_id", asked.schema.field("id").type), (id_col, held.schema.field("id").type), ("score", pa.float64())])
        if not asked.num_rows or not held.num_rows:
            return schema.empty_table()
        names, ids = (t["id"].combine_chunks() for t in (asked, held))
        names, ids = (pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in (names, ids))
        qi, xi = names.to_numpy(zero_copy_only=False), ids.to_numpy(zero_copy_only=False)
        q, x = (np.asarray(t["v"].combine_chunks().flatten()).reshape(t.num_rows, -1) for t in (asked, held))
        keeper = ranking.Keeper(len(q), k)
        for lo in range(0, len(x), max(1, ranking.CELLS // len(q))):
            hi = lo + max(1, ranking.CELLS // len(q))
            s = np.round(q @ x[lo:hi].T, 6) + 0.0
            if skip_self:
                s[qi[:, None] == xi[lo:hi]] = -np.inf
            keeper.add_block(s, xi[lo:hi])
        at, found, s = keeper.compact()
        return pa.Table.from_arrays([names.take(pa.array(at)), pa.array(found, held.schema.field("id").type), pa.array(s)], schema=schema)

    kind = f"query_id {asks.schema['id'].dataType.simpleString()}, {id_col} {unit.schema['id'].dataType.simpleString()}, score double"
    found = asked.groupBy("list", "part").cogroup(held.groupBy("list", "part")).applyInArrow(within, kind)
    return top_k(found, k, id_col)


def compression(vectors: DataFrame, codec: str, subspaces: int = 8) -> DataFrame:
    """(vectors, exact_bytes, coded_bytes, ratio)."""
    d = F.max(F.size("embedding"))
    each = {"none": d * 4, "scalar": d, "binary": F.ceil(d / 8), "product": F.lit(subspaces)}[codec]
    out = vectors.agg(F.count("*").alias("vectors"), (F.count("*") * d * 4).alias("exact_bytes"), (F.count("*") * each).cast("bigint").alias("coded_bytes"))
    return out.withColumn("ratio", F.round(F.try_divide("exact_bytes", "coded_bytes"), 6))


def mine_triplets(qrels: DataFrame, run: DataFrame, negatives: int = 3) -> DataFrame:
    """(query_id, positive, negatives): the first relevant hit of each query and the first few that are not."""
    marked = run.join(qrels.where("grade > 0").select("query_id", "chunk_id", F.lit(1).alias("rel")), ["query_id", "chunk_id"], "left")
    nth = F.row_number().over(W.partitionBy("query_id", F.col("rel").isNull()).orderBy("rank"))
    kept = marked.withColumn("nth", nth).where((F.col("rel").isNotNull() & (F.col("nth") == 1)) | (F.col("rel").isNull() & (F.col("nth") <= negatives)))
    by = kept.groupBy("query_id").agg(F.max(F.when(F.col("rel") == 1, F.col("chunk_id"))).alias("positive"), F.transform(F.sort_array(F.collect_list(F.when(F.col("rel").isNull(), F.struct("rank", "chunk_id")))), lambda x: x["chunk_id"]).alias("negatives"))
    return by.where("positive is not null and size(negatives) > 0")


def adapter_fit(triples: DataFrame, ridge: float = 1.0, negative_weight: float = 0.5) -> np.ndarray:
    """triples(q, pos, neg: arrays of double; neg the mean of the negatives) -> the matrix w that takes a query towards
    pos - negative_weight * neg, by ridge regression from the identity. One pass sums d x d moments."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q, p, n = (np.asarray(c.flatten()).reshape(batch.num_rows, -1) for c in batch.columns)
                flat = np.stack([(q.T @ q).ravel(), (q.T @ (p - negative_weight * n - q)).ravel()], 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["i", "g", "r"])

    parts = triples.select(*[doubles(c) for c in ("q", "pos", "neg")]).mapInArrow(moments, "i bigint, g double, r double")
    rows: pd.DataFrame = parts.groupBy("i").agg(F.sum("g").alias("g"), F.sum("r").alias("r")).toPandas().sort_values("i")
    d = int(round(len(rows) ** 0.5))
    g, r = rows["g"].to_numpy().reshape(d, d), rows["r"].to_numpy().reshape(d, d)
    return np.eye(d) + np.linalg.solve(g + ridge * np.eye(d), r)


def adapter_apply(vectors: DataFrame, matrix: np.ndarray, strength: float = 1.0) -> DataFrame:
    """vectors(id, embedding) moved by a share of what the adapter asks for, of length one."""
    shared = vectors.sparkSession.sparkContext.broadcast((1 - strength) * np.eye(len(matrix)) + strength * matrix)
    id_col = vectors.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1) @ shared.value
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
            firsts = pa.array(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32)[: len(x) + 1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(firsts, pa.array(x.ravel()))], [id_col, "embedding"])

    kind = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(id_col, doubles("embedding")).mapInArrow(run, f"{id_col} {kind}, embedding array<double>")
