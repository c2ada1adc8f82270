"""Token ids as Arrow files of fixed-size lists.

Each document is tokenized whole and cut into sequences of ``length`` ids, the last one padded. Sequences are stored
as an Arrow IPC file of record batches with two fixed-size-list columns, ids and mask (1: a token, 0: padding),
beside the document and the place of the sequence in it. As every batch but the last has the same number of
equal rows and nothing is compressed, sequence i lies at a computable place: reader() maps the file and
hands out numpy views of it without a copy.

One scan, no shuffle. A task emits each file as one binary value of bounded size, so that files appear only with
the commit of the table that holds them, also if a task is retried or runs twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import pick
from .tokenizer import VOCABULARY, encoding

LENGTH, BATCH_ROWS, FILE_ROWS = 512, 256, 4096


def schema(length: int, id_type: pa.DataType | None = None) -> pa.Schema:
    """Of the files. 16 bits hold any id of a vocabulary of up to 65,536."""
    return pa.schema([pa.field("doc_id", id_type or pa.int64()), pa.field("part", pa.int32()), pa.field("ids", pa.list_(pa.uint16(), length)), pa.field("mask", pa.list_(pa.uint8(), length))])


def cut_into(tokens: list[list[int]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Padded sequences, masks, and for each the document (position in tokens) and its number there."""
    n = np.array([len(t) for t in tokens], np.int64)
    parts = -(-n // length)
    doc = np.repeat(np.arange(len(n)), parts)
    first = np.cumsum(parts) - parts
    part = np.arange(len(doc)) - first[doc]
    flat = np.concatenate([np.asarray(t, np.uint16) for t in tokens]) if tokens else np.zeros(0, np.uint16)
    at = np.repeat(first * length - (np.cumsum(n) - n), n) + np.arange(len(flat))
    ids, mask = np.zeros(len(doc) * length, np.uint16), np.zeros(len(doc) * length, np.uint8)
    ids[at], mask[at] = flat, 1
    return ids, mask, doc, part.astype(np.int32)


def _batches(length: int, batch_rows: int, file_rows: int, vocabulary: str, id_type: pa.DataType = pa.int64()):
    kind = schema(length, id_type)

    def as_file(rows: list[tuple]) -> pa.RecordBatch:
        """Equal batches, but the last."""
        columns = [np.concatenate([r[i] for r in rows]) for i in range(3)]
        docs = pa.concat_arrays([r[3] for r in rows])
        n = len(docs)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_file(sink, kind) as out:
            for lo in range(0, n, batch_rows):
                hi = min(n, lo + batch_rows)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(columns[i][lo * length : hi * length]), length) for i in (0, 1)]
                out.write_batch(pa.RecordBatch.from_arrays([docs.slice(lo, hi - lo), pa.array(columns[2][lo:hi]), *lists], schema=kind))
        payload = sink.getvalue().to_pybytes()
        distinct = docs.unique()
        return pa.RecordBatch.from_arrays([pa.array([distinct.to_pylist()], pa.list_(id_type)), pa.array([n], pa.int64()), pa.array([int(columns[1].sum(dtype=np.int64))], pa.int64()), pa.array([payload], pa.binary())], ["doc_ids", "sequences", "tokens", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        held: list[tuple] = []
        count = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                ids = batch.column(0).slice(lo, 256)
                tokens = [enc.encode_ordinary(t) if t else [] for t in batch.column(1).slice(lo, 256).to_pylist()]
                seq, mask, doc, part = cut_into(tokens, length)
                docs = ids.take(pa.array(doc))
                done = 0
                while count + len(doc) - done >= file_rows:
                    take = file_rows - count
                    hi = done + take
                    held.append((seq[done * length : hi * length], mask[done * length : hi * length], part[done:hi], docs.slice(done, take)))
                    yield as_file(held)
                    held, count, done = [], 0, hi
                if done < len(doc):
                    held.append((seq[done * length :], mask[done * length :], part[done:], docs.slice(done)))
                    count += len(doc) - done
        if held:
            yield as_file(held)

    return run


def token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, batch_rows: int = BATCH_ROWS, file_rows: int = FILE_ROWS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_ids, sequences, tokens, payload): Arrow IPC files of at most file_rows sequences with the documents
    that have tokens in them, and what they hold.

    Null and empty texts have no sequence. Repeated rows are stored as often as they occur; a row without an
    id is stored with a null id. Integer ids are stored as 64 bits, all others as strings. Long texts are cut across sequences and, if need be, files, never truncated. The
    strings of special tokens are ordinary text. Extra columns, whatever their names, are ignored; an empty
    table gives no row.
    """
    picked = pick(docs, id=id_col, text=text_col)
    whole = picked.schema["id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    kind = "bigint" if whole else "string"
    picked = picked.select(picked["id"].cast(kind).alias("id"), "text")
    return picked.mapInArrow(_batches(length, batch_rows, file_rows, vocabulary, pa.int64() if whole else pa.string()), f"doc_ids array<{kind}>, sequences bigint, tokens bigint, payload binary")


def write_files(files: DataFrame, path: str) -> int:
    """Commit a token_files() table as Parquet and unpack it into path/*.arrow, and say how many files that makes. A file is
    named by the part of the committed table that holds it and its number there, which a retried task gives it again, so
    that equal files stay apart and a rename leaves no half file. path: a folder that all executors share."""
    import os

    files.write.mode("overwrite").parquet(f"{path}/table")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = []
            for payload, part, at in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = payload.as_buffer()
                name = f"{part}-{at:06d}.arrow"
                tmp = f"{path}/.{name}.{os.getpid()}"
                Path(tmp).write_bytes(data)
                os.replace(tmp, f"{path}/{name}")
                names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(names)], ["name"])

    stored = files.sparkSession.read.parquet(f"{path}/table")
    part = F.regexp_replace("_metadata.file_name", r"^part-(\d+)-.*?(c\d+)?\.[^/]*parquet$", "$1$2")
    rows = stored.select("payload", part.alias("part"), F.col("_metadata.row_index").alias("at"))
    return rows.mapInArrow(run, "name string").count()


class Reader:
    """Random access to the sequences of one file; ids and masks are views of the mapped memory."""

    def __init__(self, source: str | Path | bytes) -> None:
        self.file = pa.ipc.open_file(pa.memory_map(str(source)) if isinstance(source, (str, Path)) else pa.BufferReader(source))
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 0
        last = self.file.get_batch(self.file.num_record_batches - 1).num_rows if self.rows else 0
        self.n = self.rows * (self.file.num_record_batches - 1) + last if self.rows else 0

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> tuple[int | None, int, np.ndarray, np.ndarray]:
        """(doc_id, part, ids, mask) of sequence i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        batch, row = self.file.get_batch(i // self.rows), i % self.rows
        length = batch.schema.field("ids").type.list_size
        ids, mask = (batch.column(c).values.slice((batch.column(c).offset + row) * length, length).to_numpy(zero_copy_only=True) for c in ("ids", "mask"))
        return batch.column("doc_id")[row].as_py(), batch.column("part")[row].as_py(), ids, mask
