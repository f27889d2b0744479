"""Exchanges of packed arrays: what a task sends to a bucket is one row of binary columns.

Sorting, folding and looking up by 64-bit hashes is done with numpy on either side, so that
Spark moves a few large rows for millions of small ones.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def u64(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64) if isinstance(column, pa.Array) else column.to_numpy().view(np.uint64)


def starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """First positions of runs of equal rows."""
    n = len(sorted_columns[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, first) if len(first) else x[:0]


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Position of each key, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1, np.int64)
    x = np.searchsorted(sorted_keys, keys)
    x[x == len(sorted_keys)] = 0
    return np.where(sorted_keys[x] == keys, x, -1)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of hashes: sorted keys have sorted buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def pack(bucket: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """(bucket, a binary column for each array): one row a bucket, rows in their order."""
    if np.any(bucket[1:] < bucket[:-1]):
        o = np.argsort(bucket, kind="stable")
        bucket, columns = bucket[o], [c[o] for c in columns]
    first = starts(bucket)
    edge = np.append(first, len(bucket))
    packed = []
    for c in columns:
        c = np.ascontiguousarray(c)
        offsets = pa.py_buffer((edge * c.itemsize).astype(np.int32))
        packed.append(pa.Array.from_buffers(pa.binary(), len(first), [None, offsets, pa.py_buffer(c)]))
    return pa.record_batch([pa.array(bucket[first].astype(np.int32)), *packed], ["bucket", *names])


def unpack(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def relax() -> None:
    """Gives freed memory back to the system: idle workers of other stages share the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def packed(table: DataFrame, columns: dict[str, str], buckets: int, rows: int = 1 << 20) -> DataFrame:
    """The table's ``columns`` (name -> numpy type; ``key`` first) packed by bucket of the key."""

    def run(it):
        held, n = [], 0

        def emit():
            cols = [np.concatenate([h[k] for h in held]).astype(t) for k, t in enumerate(columns.values())]
            o = np.argsort(cols[0])
            return pack(bucket_of(cols[0][o], buckets), [c[o] for c in cols], list(columns))

        for b in it:
            held.append([u64(b.column(0)), *(c.to_numpy(zero_copy_only=False) for c in b.columns[1:])])
            n += len(b)
            if n >= rows:
                yield emit()
                held, n = [], 0
        if n:
            yield emit()

    return table.select(*columns).mapInArrow(run, "bucket int, " + ", ".join(f"{c} binary" for c in columns))
