"""Small DataFrame helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_BYTES = 4 << 20  # text behind one bucket of fingerprints
BROADCAST_ROWS = 100_000  # largest table, in rows of a few numbers, that is sent to every task


def row_key(id_col: str, text_col: str) -> Column:
    """64-bit name of a row. Rows with equal id and text share it, and get equal results."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def text_volume(docs: DataFrame, text_col: str) -> int:
    """Bytes of all texts, by one aggregate over one column."""
    return docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0


def bucket_count(docs: DataFrame, text_col: str, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets for fingerprints, in proportion to the text, so that one stays small at any size."""
    return max(4, math.ceil(text_volume(docs, text_col) / bucket_bytes))


def thin(rows: DataFrame, hashed: Column, wanted: int, margin: int = 4) -> DataFrame:
    """About `margin * wanted` rows, those with the smallest hashes, or all if there are no more: so that a later choice
    of `wanted` rows in hash order moves no more than that, however many rows there are."""
    n = rows.count()
    if n <= margin * wanted:
        return rows
    return rows.filter(F.pmod(hashed, F.lit(1 << 40)) < int((1 << 40) * margin * wanted / n))


def attach(df: DataFrame, table: DataFrame, keys: list[str], limit: int = BROADCAST_ROWS) -> DataFrame:
    """Left join with a table that has one row per key. The table is sent to every task only if it is
    counted first and has at most `limit` rows; else both sides are shuffled, and adaptive execution splits a hot key.
    `table` should be checkpointed, as it is read twice."""
    few = table.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(table) if few else table, keys, "left")


SLICE_BYTES = 4 << 20  # text that a task turns into Python objects at once


def lean(fn, column: str = "_text", limit: int = SLICE_BYTES):
    """A function over batches that sees them in pieces of about `limit` bytes of one column, and gives the memory of its
    process back when its task ends: workers outlive tasks and queries."""

    def pieces(batches):
        for batch in batches:
            size = batch.column(column).cast(pa.large_binary())
            ends = np.frombuffer(size.buffers()[1], np.int64)[size.offset : size.offset + len(size) + 1]
            i = 0
            while i < len(batch):
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + limit, side="right")) - 1)
                yield batch.slice(i, j - i)
                i = j

    def run(batches):
        try:
            yield from fn(pieces(batches))
        finally:
            give_back()

    return run


def lean_group(fn):
    """A function of a group's table that gives the memory of its process back when it has ended."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return fn(table)
        finally:
            give_back()

    return run


def give_back():
    """Returns what this process no longer uses to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def pack(codes: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each 64-bit code."""
    return np.ascontiguousarray(codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()


def runs(sorted_codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    n = len(sorted_codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], sorted_codes[1:] != sorted_codes[:-1]]))
    return start, np.diff(np.append(start, n))


def joined(chunks: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(chunks) if chunks else np.zeros(0, dtype)
