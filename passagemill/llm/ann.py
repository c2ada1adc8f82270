"""Approximate nearest neighbours by an adaptive dimension scan of probed lists.

Vectors are rotated by a random orthogonal matrix, so that any first t of d dimensions are a random sample of the
distance, and assigned to k-means lists. A list stores its vectors in column blocks. To search a list, a query takes
one block of dimensions after another: a candidate whose partial distance, scaled by d / t, exceeds the
query's k-th best distance by more than the hypothesis test allows, (1 + epsilon / sqrt(t)) ** 2, is abandoned.

Every vector is indexed. Queries are the vectors whose id is divisible by ``every``, against all. A query's own list comes
first and gives its k-th best distance, with which it goes on to the next nearest lists, so that most candidates there are
abandoned after the first dimensions. How many lists are probed follows from the data: the exact neighbours of ``sample``
vectors among all tell how many of the nearest lists hold the share ``target`` of them. Lists are cut into blocks of at
most ``block`` vectors, and neighbouring blocks share a bin; a query goes once to each bin that it probes, and a task holds
one bin, never a table. Centroids come from all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ._common import cut, pick, sized

K, TARGET, SAMPLE, EPSILON, ITERATIONS, SEED, EVERY = 10, 0.98, 256, 2.1, 6, 7, 50
#: Vectors in a block and in a bin, and queries that one task runs against a bin.
BLOCK, BIN, SLICE, STEP = 4096, 16_384, 100_000, 16


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _matrix(col: pa.Array, d: int) -> np.ndarray:
    return np.asarray(col.flatten(), np.float32).reshape(len(col), d)


def _lists(x: np.ndarray) -> pa.ListArray:
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, max(d, 1), dtype=np.int32)[: n + 1]), pa.array(np.ascontiguousarray(x, np.float32).ravel()))


def _nearest(x: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """The probes nearest centroids of each row, nearest first."""
    out = np.empty((len(x), probes), np.int64)
    norms = (centroids**2).sum(1)
    for lo in range(0, len(x), 2048):
        far = norms - 2 * (x[lo : lo + 2048] @ centroids.T)
        if probes < len(centroids):
            near = np.argpartition(far, probes - 1, axis=1)[:, :probes]
        else:
            near = np.broadcast_to(np.arange(len(centroids)), far.shape)
        out[lo : lo + 2048] = np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable"), 1)
    return out


def centroids_of(vectors: DataFrame, d: int, lists: int, iterations: int = ITERATIONS) -> np.ndarray:
    """k-means over all vectors (id, v): each round is one scan that sends one partial sum a list and batch."""
    start = vectors.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(lists).select("v").collect()
    c = np.array([r.v for r in start], np.float32)
    for _ in range(iterations):
        shared = vectors.sparkSession.sparkContext.broadcast(c)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = shared.value
            total, count = np.zeros(c.shape, np.float64), np.zeros(len(c), np.int64)
            for batch in batches:
                x = _matrix(batch.column(0), d)
                at = _nearest(x, c, 1)[:, 0]
                order = np.argsort(at, kind="stable")
                which, first = np.unique(at[order], return_index=True)
                total[which] += np.add.reduceat(x[order].astype(np.float64), first, axis=0) if len(x) else 0
                count += np.bincount(at, minlength=len(c))
            some = np.flatnonzero(count)
            sums_ = pa.ListArray.from_arrays(pa.array(np.arange(0, len(some) * d + 1, d, dtype=np.int32)), pa.array(total[some].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), sums_], ["list", "n", "total"])

        parts = vectors.select("v").mapInArrow(sums, "list bigint, n bigint, total array<double>")

        def merged(group: pa.Table) -> pa.Table:
            n = group["n"].to_numpy().sum()
            mean = np.asarray(group["total"].combine_chunks().flatten()).reshape(group.num_rows, d).sum(0) / n
            return pa.table({"list": group["list"].slice(0, 1), "mean": pa.array([mean.tolist()], pa.list_(pa.float64()))})

        c = c.copy()
        for r in parts.groupBy("list").applyInArrow(merged, "list bigint, mean array<double>").collect():  # a row a list
            c[r["list"]] = r["mean"]
    return c


def scan(queries: np.ndarray, limit: np.ndarray, block: np.ndarray, epsilon: float = EPSILON, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, candidate, squared distance) that no test abandons. limit: squared k-th best distances so far;
    block: candidates by column, (dimensions, candidates)."""
    d, n = block.shape
    keep_q, keep_c, keep_d = [], [], []
    norms = [(block[t : t + step] ** 2).sum(0) for t in range(0, d, step)]
    for lo in range(0, len(queries), 256):
        q, r = queries[lo : lo + 256], limit[lo : lo + 256]
        first = q[:, :step]
        part = np.maximum((first**2).sum(1)[:, None] + norms[0] - 2 * (first @ block[:step]), 0)
        t = min(step, d)
        iq, ic = np.nonzero(part * (d / t) <= (r * (1 + epsilon / np.sqrt(t)) ** 2)[:, None] if t < d else part <= r[:, None])
        dist = part[iq, ic]
        while t < d and len(iq):
            end = min(d, t + step)
            if 4 * len(iq) > len(q) * n:  # most are left: a dense product is faster
                here = q[:, t:end]
                more = np.maximum((here**2).sum(1)[:, None] + norms[t // step] - 2 * (here @ block[t:end]), 0)[iq, ic]
            else:
                more = ((q[iq, t:end] - block[t:end, ic].T) ** 2).sum(1)
            dist, t = dist + more, end
            ok = dist * (d / t) <= r[iq] * ((1 + epsilon / np.sqrt(t)) ** 2 if t < d else 1)
            iq, ic, dist = iq[ok], ic[ok], dist[ok]
        exact = ((q[iq] - block[:, ic].T) ** 2).sum(1) if len(iq) else dist
        keep_q.append(iq + lo), keep_c.append(ic), keep_d.append(exact)
    return (np.concatenate(keep_q), np.concatenate(keep_c), np.concatenate(keep_d)) if keep_q else (np.zeros(0, np.int64),) * 3


def _best(q: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each query, by distance and id."""
    order = np.lexsort((ids, dist, q))
    q = q[order]
    new = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < k]


def _limits(queries: np.ndarray, own: np.ndarray, block: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """A squared distance within which each query has k candidates of other ids, from an even sample of the block; none: infinity."""
    if len(ids) <= k:
        return np.full(len(queries), np.inf, np.float32)
    some = np.linspace(0, len(ids) - 1, min(len(ids), 32 * k)).astype(np.int64)
    x = block[:, some].T
    out = np.empty(len(queries), np.float32)
    for lo in range(0, len(queries), 1024):
        q = queries[lo : lo + 1024]
        far = np.maximum((q**2).sum(1)[:, None] + (x**2).sum(1) - 2 * (q @ x.T), 0)
        far[own[lo : lo + 1024, None] == ids[some]] = np.inf
        out[lo : lo + 1024] = np.partition(far, min(k, len(some)) - 1, axis=1)[:, min(k, len(some)) - 1]
    return out * np.float32(1.0001) + np.float32(1e-6)


def _table(**columns: np.ndarray) -> pa.Table:
    return pa.table({n: pa.array(c) for n, c in columns.items()})


def probes_for(placed: DataFrame, d: int, centroids: np.ndarray, k: int, target: float, sample: int) -> int:
    """How many of the nearest lists hold the share target of the exact neighbours of sample queries (those with
    the smallest hashed ids) among all vectors (id, v, list)."""
    chosen = placed.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(sample).select("id", "v").collect()
    ids, x = np.array([r.id for r in chosen]), np.array([r.v for r in chosen], np.float32)
    shared = placed.sparkSession.sparkContext.broadcast((ids, x))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = shared.value
        for batch in batches:
            other, v = batch.column(0).to_numpy(), _matrix(batch.column(1), d)
            far = (q**2).sum(1)[:, None] + (v**2).sum(1) - 2 * (q @ v.T)
            far[own[:, None] == other] = np.inf
            most = min(k, len(other))
            at = np.argpartition(far, most - 1, axis=1)[:, :most]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(own)), most)), pa.array(other[at].ravel()), pa.array(batch.column(2).to_numpy()[at].ravel()), pa.array(np.take_along_axis(far, at, 1).ravel().astype(np.float64))], ["q", "id", "list", "far"])

    rows = placed.select("id", "v", "list").mapInArrow(nearest, "q bigint, id bigint, list bigint, far double")
    true = rows.withColumn("nth", F.row_number().over(W.partitionBy("q").orderBy("far", "id"))).where(F.col("nth") <= k).select("q", "list", "far").collect()
    order = _nearest(x, centroids, len(centroids))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(centroids)), order.shape), 1)
    ranks = np.sort([place[r.q, r.list] for r in true if r.far < np.inf])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))) - 1)]) + 1 if len(ranks) else 1


def nearest_neighbours(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, target: float = TARGET, sample: int = SAMPLE, epsilon: float = EPSILON, iterations: int = ITERATIONS, lists: int | None = None, block: int = BLOCK, bin_size: int = BIN, slice_size: int = SLICE, every: int = EVERY) -> DataFrame:
    """(vec_id, neighbour, rank, distance): for every vector whose id is divisible by ``every`` the k nearest other ids found
    among all vectors, by Euclidean distance.

    Vectors are those of the commonest dimension (the larger if two tie); rows with a null id, or one that is no whole
    number, a null, empty or shorter vector, or one with a null, NaN or infinite element have no neighbours and are none. Repeated rows of
    one id are one vector, the smallest if they differ. Equal vectors of different ids are neighbours at distance 0.
    Ties go to the smaller id. Extra columns, whatever their names, are ignored; an empty table gives no row.
    lists: the square root of the number of vectors by default.
    """
    spark = vectors.sparkSession
    raw = pick(vectors, id=id_col, v=vector_col).select(F.col("id").try_cast("bigint").alias("id"), F.col("v").cast("array<float>").alias("v"))
    sound = raw.where("id is not null and size(v) > 0").where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    sound = cut(sound.groupBy("id", F.size("v").alias("d")).agg(F.min("v").alias("v")))
    sizes = sound.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], "vec_id bigint, neighbour bigint, rank int, distance double")
    d, n = sizes["d"], sizes["count"]
    turn = spark.sparkContext.broadcast(rotation(d))

    def rotated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(_matrix(batch.column(1), d) @ turn.value)], ["id", "v"])

    turned = cut(sound.where(F.col("d") == d).select("id", "v").mapInArrow(rotated, "id bigint, v array<float>"))
    lists = max(1, min(n, lists or round(n**0.5)))
    centroids = centroids_of(turned, d, lists, iterations)
    # neighbouring lists next to each other: along the centroids' main axis
    centred = centroids - centroids.mean(0)
    axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
    centroids = centroids[np.argsort(centred @ axis, kind="stable")]
    shared = spark.sparkContext.broadcast(centroids)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _nearest(_matrix(batch.column(1), d), shared.value, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at)], ["id", "v", "list"])

    placed = cut(turned.mapInArrow(assigned, "id bigint, v array<float>, list bigint"))
    probes = probes_for(placed, d, centroids, k, target, sample)
    counts = np.zeros(lists, np.int64)
    for r in placed.groupBy("list").count().collect():  # a row a list
        counts[r["list"]] = r["count"]
    parts = np.maximum(1, -(-counts // block))
    first = np.cumsum(parts) - parts  # the first block of each list
    filled = np.cumsum(np.repeat(counts / parts, parts))
    bins = spark.sparkContext.broadcast((parts, first, (filled / bin_size).astype(np.int64)))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, first, bin_of = bins.value
        for batch in batches:
            at, ids = batch.column(2).to_numpy(), batch.column(0).to_numpy()
            own = first[at] + (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts[at]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own), pa.array(bin_of[own])], ["id", "v", "block", "bin"])

    dealt_ = cut(placed.mapInArrow(dealt, "id bigint, v array<float>, block bigint, bin bigint"))

    def home(group: pa.Table) -> pa.Table:
        """The queries of a block against it: neighbours, and with each query its k-th best distance here."""
        ids = group["id"].to_numpy()
        v = _matrix(group["v"].combine_chunks(), d)
        cols = np.ascontiguousarray(v.T)
        asked = np.flatnonzero(ids % every == 0)
        own, x = ids[asked], v[asked]
        q, c, dist = scan(x, _limits(x, own, cols, ids, k), cols, epsilon)
        other = own[q] != ids[c]
        q, c, dist = q[other], c[other], dist[other]
        best = _best(q, ids[c], dist, k)
        q, c, dist = q[best], c[best], dist[best]
        kth = np.full(len(own), np.inf, np.float32)
        found = np.bincount(q, minlength=len(own))
        full = found >= k
        kth[full] = dist[(np.cumsum(found) - 1)[full]] * np.float32(1.0001) + np.float32(1e-6)
        firsts = pa.array(np.concatenate([[0], np.cumsum(found)]).astype(np.int32))
        group = group.take(pa.array(asked))
        return pa.table({"id": group["id"], "v": group["v"], "block": group["block"], "limit": pa.array(kth), "near": pa.ListArray.from_arrays(firsts, pa.array(ids[c])), "far": pa.ListArray.from_arrays(firsts, pa.array(dist.astype(np.float64)))})

    began = cut(dealt_.groupBy("block").applyInArrow(home, "id bigint, v array<float>, block bigint, limit float, near array<bigint>, far array<double>"))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each bin that a query probes, with the blocks there."""
        parts, first, bin_of = bins.value
        for batch in batches:
            near = _nearest(_matrix(batch.column(1), d), shared.value, probes)
            own = batch.column(2).to_numpy()
            width = parts[near]
            row = np.repeat(np.repeat(np.arange(len(own)), probes), width.ravel())
            last = np.cumsum(width.ravel())
            to = np.repeat(first[near].ravel(), width.ravel()) + np.arange(len(row)) - np.repeat(last - width.ravel(), width.ravel())
            row, to = row[to != own[row]], to[to != own[row]]
            order = np.lexsort((to, row))
            row, to = row[order], to[order]
            key = bin_of[to]
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])]) if len(row) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            blocks = pa.ListArray.from_arrays(pa.array(np.append(at, len(row)).astype(np.int32)), pa.array(to))
            rows = pa.array(row[at])
            yield pa.RecordBatch.from_arrays([pa.array(key[at]), batch.column(0).take(rows), batch.column(1).take(rows), batch.column(3).take(rows), blocks], ["bin", "id", "v", "limit", "blocks"])

    queries = began.select("id", "v", "block", "limit").mapInArrow(asked, "bin bigint, id bigint, v array<float>, limit float, blocks array<bigint>")
    slices = queries.groupBy("bin").agg(F.ceil(F.count("*") / F.lit(slice_size)).cast("int").alias("slices"))
    slices = cut(slices)  # a row a bin
    queries = queries.join(sized(slices), "bin").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices").cast("bigint"))).drop("slices")
    held = dealt_.select("bin", "block", "id", "v").join(sized(slices), "bin").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices").cast("bigint") - 1))).drop("slices")

    def away(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """The queries that probe blocks of a bin, against them, with limits that tighten from block to block."""
        if not left.num_rows or not right.num_rows:
            return _table(id=np.zeros(0, np.int64), neighbour=np.zeros(0, np.int64), distance=np.zeros(0))
        own, x, limit = left["id"].to_numpy(), _matrix(left["v"].combine_chunks(), d), left["limit"].to_numpy().copy()
        blocks = left["blocks"].combine_chunks()
        row = np.repeat(np.arange(len(own)), np.diff(blocks.offsets.to_numpy()))
        to = blocks.flatten().to_numpy()
        order = np.argsort(to, kind="stable")
        row, to = row[order], to[order]
        which = right["block"].to_numpy()
        ids, v = right["id"].to_numpy(), _matrix(right["v"].combine_chunks(), d)
        sort = np.argsort(which, kind="stable")
        which, ids, v = which[sort], ids[sort], v[sort]
        top_d, top_i = np.full((len(own), k), np.inf), np.full((len(own), k), -1, np.int64)
        for b in np.unique(to):
            lo, hi = np.searchsorted(which, [b, b + 1])
            if lo == hi:
                continue
            mine = row[slice(*np.searchsorted(to, [b, b + 1]))]
            cols, there = np.ascontiguousarray(v[lo:hi].T), ids[lo:hi]
            bound = limit[mine]
            if np.isinf(bound).any():
                bound = np.minimum(bound, _limits(x[mine], own[mine], cols, there, k))
            q, c, dist = scan(x[mine], bound, cols, epsilon)
            other = own[mine[q]] != there[c]
            q, c, dist = mine[q[other]], c[other], dist[other]
            if not len(q):
                continue
            some = np.unique(q)
            all_q = np.concatenate([q, np.repeat(some, k)])
            all_i, all_d = np.concatenate([there[c], top_i[some].ravel()]), np.concatenate([dist, top_d[some].ravel()])
            best = _best(all_q, all_i, all_d, k)
            top_i[some], top_d[some] = all_i[best].reshape(-1, k), all_d[best].reshape(-1, k)
            limit[some] = np.minimum(limit[some], top_d[some, k - 1].astype(np.float32) * np.float32(1.0001) + np.float32(1e-6))
        q, at = np.nonzero(top_d < np.inf)
        return _table(id=own[q], neighbour=top_i[q, at], distance=top_d[q, at])

    more = queries.groupBy("bin", "slice").cogroup(held.groupBy("bin", "slice")).applyInArrow(away, "id bigint, neighbour bigint, distance double")
    here = began.select("id", F.explode(F.arrays_zip("near", "far")).alias("p")).select("id", F.col("p.near").alias("neighbour"), F.col("p.far").alias("distance"))
    best = here.unionByName(more).withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy("distance", "neighbour"))).where(F.col("rank") <= k)
    return best.select(F.col("id").alias("vec_id"), "neighbour", "rank", F.sqrt("distance").alias("distance"))
