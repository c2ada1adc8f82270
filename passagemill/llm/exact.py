"""Exact deduplication by a tree merge of sorted digest runs.

Every task starts with runs of (digest, smallest id), sorted by digest. Partition numbers and digests are written in base
``fan_in``, two by default; in round r each partition exchanges with the partition whose number differs in digit r only (with
fan_in - 1 of them in a larger base): it keeps the part of its run whose digests have its own digit there and gets the like
part of the other's. A part travels whole, still sorted, and what a partition holds is merged as runs, not sorted again;
each merge keeps the smallest id of a digest. After log(partitions) rounds a digest is in one partition only, so that the
binomial tree has as many roots as partitions and no task holds more than its share. Entries count as equal only if SHA-256,
an independent 64-bit hash and the length all agree: that verification runs in each merge. Texts never shuffle: runs hold
digests and ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ._common import BROADCAST_IDS, cut, free_names, frugal, named, pick, release, sized

FAN_IN = 2
#: What makes two texts equal.
PROOF = ("digest", "check", "n")
#: Entries of a part that travels as one row.
_PART = 1 << 17


def _proof(text: Column) -> list[Column]:
    return [F.unhex(F.sha2(text, 256)).alias("digest"), F.xxhash64(text).alias("check"), F.octet_length(text).alias("n")]


def _digests(run: pa.Table) -> np.ndarray:
    """The 32 bytes of each digest as one numpy string, which compares like them."""
    col = run["digest"].combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.binary())
    if not len(col):
        return np.zeros(0, "S32")
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, 32).view("S32")[:, 0]


def _one_each(run: pa.Table) -> pa.Table:
    """A run sorted by digest with one entry a text: the smallest id, the rows that have it, and all rows."""
    digests = _digests(run)
    new = np.concatenate([[True], digests[1:] != digests[:-1]]) if len(digests) else np.zeros(0, bool)
    if new.all():
        return run
    group = np.cumsum(new)
    many = np.bincount(group)[group] > 1
    ties = run.filter(pa.array(many)).combine_chunks()
    keys = pa.table({"g": pa.array(group[many]), "check": ties["check"], "n": ties["n"], "id": ties["id"]})
    order = pc.sort_indices(keys, [(k, "ascending") for k in keys.column_names], null_placement="at_end")
    ties, g = ties.take(order), group[many][order.to_numpy()]
    check, n, ids = ties["check"].to_numpy(), ties["n"].to_numpy(), ties["id"]
    first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (check[1:] != check[:-1]) | (n[1:] != n[:-1])]))
    least = ids.take(pa.array(np.repeat(first, np.diff(np.append(first, len(g))))))
    same = pc.or_(pc.fill_null(pc.equal(ids, least), False), pc.and_(pc.is_null(ids), pc.is_null(least))).to_numpy()
    kept = ties.take(pa.array(first))
    kept = kept.set_column(kept.column_names.index("copies"), "copies", pa.array(np.add.reduceat(ties["copies"].to_numpy() * same, first)))
    kept = kept.set_column(kept.column_names.index("rows"), "rows", pa.array(np.add.reduceat(ties["rows"].to_numpy(), first)))
    return merge([run.filter(pa.array(~many)), kept.cast(run.schema)], False)


def merge(runs: list[pa.Table], verify: bool = True) -> pa.Table:
    """Sorted runs as one. A stable sort of text that lies in sorted runs is a merge of them: it finds the runs and
    merges them pairwise by galloping. verify: keep one entry of each text."""
    together = pa.concat_tables(runs).combine_chunks()
    merged = together.take(pa.array(np.argsort(_digests(together), kind="stable")))
    return _one_each(merged) if verify else merged


def merge_runs(entries: DataFrame, fan_in: int = FAN_IN, partitions: int | None = None) -> DataFrame:
    """entries(digest, check, n, id, copies) -> one entry a distinct text, with the smallest id, the number of
    rows that have this id, and rows: how many rows the text has. A null id is larger than all others."""
    spark = entries.sparkSession
    rounds, size = 1, fan_in
    while size < (partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))):
        rounds, size = rounds + 1, size * fan_in
    parts = "at bigint, part binary"

    def dealt(run: pa.Table, at: int, r: int) -> Iterator[pa.RecordBatch]:
        """The parts of partition at's run, each for the partition that it goes to in round r."""
        head = np.ascontiguousarray(_digests(run)).view(np.uint8).reshape(-1, 32)[:, :8]
        digit = np.ascontiguousarray(head).view(">u8")[:, 0] // np.uint64(fan_in**r) % np.uint64(fan_in)
        own = at // fan_in**r % fan_in
        for d in range(fan_in):
            part = run.filter(pa.array(digit == d))
            for lo in range(0, part.num_rows, _PART):
                sink = pa.BufferOutputStream()
                piece = part.slice(lo, _PART).combine_chunks()
                with pa.ipc.new_stream(sink, piece.schema) as out:
                    out.write_table(piece)
                yield pa.RecordBatch.from_arrays([pa.array([at + (d - own) * fan_in**r], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["at", "part"])

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() % size
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 8 * _PART:
                yield from dealt(sorted_run(pa.Table.from_batches(held)), at, 0)
                held, n = [], 0
        if n:
            yield from dealt(sorted_run(pa.Table.from_batches(held)), at, 0)

    def sorted_run(table: pa.Table) -> pa.Table:
        return _one_each(table.take(pa.array(np.argsort(_digests(table), kind="stable"))))

    def merged(group: pa.Table) -> pa.Table:
        release()  # what the last group took
        return merge([pa.ipc.open_stream(p.as_buffer()).read_all() for p in group["part"]])

    def exchange(r: int):
        def run(group: pa.Table) -> pa.Table:
            out = list(dealt(merged(group), group["at"][0].as_py(), r))
            return pa.Table.from_batches(out, pa.schema([("at", pa.int64()), ("part", pa.binary())]))

        return run

    columns = ("digest", "check", "n", "id", "copies", "rows")
    start = entries.withColumn("rows", F.col("copies")).select(*columns)
    runs = start.mapInArrow(frugal(begin), parts)
    for r in range(1, rounds):
        runs = runs.groupBy("at").applyInArrow(exchange(r), parts)
    return runs.groupBy("at").applyInArrow(merged, start.schema)


def _runs(docs: DataFrame, id_col: str, text_col: str, fan_in: int) -> tuple[DataFrame, DataFrame]:
    """(id, proof) of every text, materialised, and the merged runs of texts that several rows have."""
    entries = cut(pick(docs, id=id_col, text=text_col).where("text is not null").select("id", *_proof(F.col("text"))))
    return entries, cut(merge_runs(entries.withColumn("copies", F.lit(1).cast("bigint")), fan_in).where("rows > 1"))


def _losers(entries: DataFrame, merged: DataFrame) -> DataFrame:
    kept = merged.select(*PROOF, F.col("id").alias("keeper"))
    return entries.join(sized(kept, BROADCAST_IDS // 8), list(PROOF)).where(~F.col("id").eqNullSafe(F.col("keeper")))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, duplicate_of): each id whose text a smaller id has too, and the smallest id with that text.

    Empty texts equal each other; null texts equal nothing. A null id counts as the largest and is reported
    as null. Repeated rows of one id are one document here; an id with several texts has a row for each that
    is a duplicate. Extra columns, whatever their names, are ignored; an empty table gives no row.
    """
    entries, merged = _runs(docs, id_col, text_col, fan_in)
    return _losers(entries, merged).select(F.col("id").alias("doc_id"), F.col("keeper").alias("duplicate_of")).distinct()


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """The rows of docs, all columns, one for each distinct text: that of the smallest id, and if that id
    repeats with this text, one of those rows. Null texts stay. Clashing names as in free_names()."""
    entries, merged = _runs(docs, id_col, text_col, fan_in)
    docs = free_names(docs, "gone__", "check__", "nth__")
    key, text = docs[named(docs, id_col)], docs[named(docs, text_col)]
    lost = cut(_losers(entries, merged).select(F.col("id").alias("gone__"), F.col("check").alias("check__")).distinct())
    kept = docs.join(sized(lost), key.eqNullSafe(F.col("gone__")) & (F.xxhash64(text) == F.col("check__")) & text.isNotNull(), "left_anti")
    again = cut(merged.where("copies > 1").select(F.col("id").alias("gone__"), F.col("check").alias("check__")))
    if again.isEmpty():
        return kept
    same = key.eqNullSafe(F.col("gone__")) & (F.xxhash64(text) == F.col("check__")) & text.isNotNull()
    once = kept.join(sized(again), same, "left_semi").withColumn("nth__", F.row_number().over(W.partitionBy(named(docs, id_col), F.xxhash64(named(docs, text_col))).orderBy(F.lit(0)))).where("nth__ = 1").drop("nth__")
    return kept.join(sized(again), same, "left_anti").unionByName(once)


ORACLE_SQL = """
SELECT DISTINCT d.doc_id, k.keeper AS duplicate_of
FROM documents d JOIN (SELECT text, min(doc_id) AS keeper FROM documents WHERE text IS NOT NULL GROUP BY text) k ON d.text = k.text
WHERE d.doc_id IS DISTINCT FROM k.keeper
"""
