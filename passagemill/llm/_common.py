"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import BROADCAST_IDS, cut, few, frugal, release, sized, slices  # noqa: F401


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, under our names. Of columns with one name (case aside) the first counts,
    so tables with clashing names do not make a reference ambiguous."""
    low = [c.lower() for c in df.columns]
    plain = df.toDF(*[f"c{i}_" for i in range(len(low))])
    return plain.select(*[plain[f"c{low.index(name.lower())}_"].alias(alias) for alias, name in wanted.items()])


def free_names(df: DataFrame, *taken: str) -> DataFrame:
    """The same rows with unique column names, none of them in taken: a clashing input column gets the
    prefix ``input_`` as often as it takes."""
    seen, names = {t.lower() for t in taken}, []
    for c in df.columns:
        while c.lower() in seen:
            c = f"input_{c}"
        seen.add(c.lower())
        names.append(c)
    return df.toDF(*names)


def named(df: DataFrame, name: str) -> str:
    """The spelling that the first column called so (case aside) has in df."""
    return next(c for c in df.columns if c.lower() == name.lower())


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without a copy; null counts as empty."""
    if col.null_count:
        col = col.fill_null("")
    if pa.types.is_large_string(col.type):
        offsets = np.frombuffer(col.buffers()[1], np.int64)
    else:
        offsets = np.frombuffer(col.buffers()[1], np.int32)
    offsets = offsets[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def code_points(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points and offsets of a string column; null counts as empty."""
    texts = [t or "" for t in col.to_pylist()]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets
