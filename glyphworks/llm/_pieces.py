"""Shared plumbing of the text operators.

Documents are dealt into *pieces* by a hash of their id.  A piece is a few
megabytes of whole texts, so any group that a Python kernel sees is bounded by
the size of a piece (or of one document, if that is larger).  Kernels that must
compare all pieces with each other send packed byte blobs to *buckets* (by a
hash of the compared value) and get one packed answer back for each blob, in
the order in which the blob was written.  Both hashes are uniform, so neither a
hot source nor a hot group of copies lands in one task.
"""

from __future__ import annotations

import gc
import math
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of input for each piece and bucket, so that neither grows with the input.
PIECE_BYTES, BUCKET_BYTES = 8 << 20, 12 << 20
BLOB_SCHEMA = "piece int, bucket int, kind int, blob binary"
_BLOB_ARROW = pa.schema([("piece", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])


def shuffle_width(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def planned_bytes(df: DataFrame) -> int:
    """Size of the scanned input as the optimizer sees it, but no more than all that is read; 0 if it has no idea."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    read = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    size = min(int(str(plan.stats().sizeInBytes())), read)
    return size if size < 1 << 60 else 0


def piece_count(df: DataFrame) -> int:
    """A piece for each shuffle partition, or more if pieces would get large."""
    return max(shuffle_width(df), math.ceil(planned_bytes(df) / PIECE_BYTES))


def bucket_count(df: DataFrame) -> int:
    """By bytes, and some for a small input: every piece sends a blob to every bucket."""
    return max(min(8, shuffle_width(df)), math.ceil(planned_bytes(df) / BUCKET_BYTES))


def grouped(df: DataFrame, by: str, many: int):
    """df by piece or bucket, each in the partition of its own number: hashing the numbers would put several into one."""
    return df.repartitionById(many, by).groupBy(by)


def in_pieces(docs: DataFrame, pieces: int, *more) -> DataFrame:
    """(piece, doc_id, text as bytes); a null text is an empty one."""
    return docs.select(
        F.pmod(F.xxhash64(F.col("doc_id"), F.octet_length("text")), F.lit(pieces)).cast("int").alias("piece"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"),
        *more,
    )


def texts_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary Arrow column in one array, and n+1 offsets into it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def ids_of(column) -> np.ndarray:
    """Document ids; a null id counts as larger than every other."""
    return column.combine_chunks().fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


def blobs(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    """rows: (piece, bucket, kind, blob)."""
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(_BLOB_ARROW)], schema=_BLOB_ARROW)


def rows_of(table: pa.Table, *by: str) -> list[tuple]:
    """(piece, bucket, kind, blob) in the order of by."""
    if by and table.num_rows:
        table = table.sort_by([(k, "ascending") for k in by])
    return list(zip(*(table.column(k).to_pylist() for k in ("piece", "bucket", "kind", "blob")), strict=True))


def kept_in_worker() -> dict:
    """What operators keep in a Python worker between their tasks."""
    return sys.modules.setdefault("_glyphworks_worker", types.ModuleType("_glyphworks_worker")).__dict__.setdefault("kept", {})


def clear_worker() -> None:
    """Drops what another operator has kept in this worker."""
    if kept_in_worker():
        kept_in_worker().clear()
        gc.collect()
        give_back()


def give_back() -> None:
    """Returns what this worker has freed to the system, so that a worker between tasks holds little."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer of 64-bit hashes (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cuts(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indexes of the given runs, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - at, lengths)


def thinned(df: DataFrame, key, want: int) -> DataFrame:
    """About twice the wanted rows by a hash, or all if there are few, so that a limit gathers no more than that from all tasks together."""
    step = df.count() // (2 * want)
    return df.where(F.pmod(key, F.lit(step)) == 0) if step > 1 else df
