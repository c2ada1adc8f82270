"""Session helpers."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

_shipped: set[str] = set()

#: Bytes of texts that a kernel takes from an Arrow batch at a time, and gives back in one, whatever a batch holds.
PIECE = 1 << 20
#: Rows of at most this many ids (8 bytes each) are broadcast; beyond it the join shuffles.
BROADCAST_IDS = 2_000_000

Batches = Iterator[pa.RecordBatch]


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that functions that run there
    can import it wherever the driver found it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    to = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{root.name}.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(to)
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. A temporary one takes its place only where driver and
    executors are one machine; on a cluster executors could not read it, and its lack is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in shared_folder(), and cut its lineage there: what several parts of a plan read is made once, and a
    lost executor costs a read, not a recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def few(ids: DataFrame, limit: int = BROADCAST_IDS) -> bool:
    """Whether a materialised table has at most limit rows (it counts one more than the limit at most)."""
    return ids.limit(limit + 1).count() <= limit


def sized(ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """ids with a broadcast hint if it is small by count, as it is otherwise. ids: materialised."""
    return F.broadcast(ids) if few(ids, limit) else ids


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of at most so many bytes together, or of one text."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def pieces(batch: pa.RecordBatch, column: int | str = 1, most: int | None = None) -> Batches:
    """A batch in consecutive parts of at most so many bytes (PIECE) of a column of texts or of lists, or of one row; an element of
    a list counts 8."""
    col = batch.column(column)
    listed = pa.types.is_list(col.type) or pa.types.is_large_list(col.type)
    size = pc.fill_null(pc.list_value_length(col) if listed else pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(size * (8 if listed else 1) + 8)])
    for lo, hi in slices(offsets, most or PIECE):
        yield batch.slice(lo, hi - lo)


@lru_cache(1)
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc


def release() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def frugal(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, which gives freed memory back to the system after each batch: Python workers stay for the next stage, and
    their free memory would count against the executor."""

    def lean(batches: Batches) -> Batches:
        for batch in run(batches):
            yield batch
            del batch
            release()

    return lean
