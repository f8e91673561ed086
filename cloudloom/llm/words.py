"""Words of Arrow text columns as NumPy arrays, and hashes of words and word windows.

A batch of texts becomes flat arrays: byte offsets of every word, the first word of every text and a
64-bit hash per word. Nothing is done per word in Python, so a task costs a few nanoseconds a byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = bytes([0x20, *range(0x09, 0x0E)])  # fixed: what separates words
SLICE_BYTES = 1 << 21  # texts are hashed in slices of about this size
_BASE = np.uint64(0x9E3779B97F4A7C15)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is. Plain `lower` does the same on ASCII text, only faster."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


class Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base = np.uint64(base)
        self.inverse = np.uint64(pow(int(base), -1, 1 << 64))
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            grow = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]))
            self.up, self.down = grow(self.base), grow(self.inverse)
        return self.up[:n], self.down[:n]


_BYTES = Powers(0xD1342543DE82EF95)
_WORDS = Powers(0xA0761D6478BD642F)


@dataclass
class Words:
    """`data`: bytes of all texts; `start`, `end`: byte range of each word; `first`: index of the first
    word of each text, with the number of words at the end; `code`: hash of each word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    code: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def place(self) -> np.ndarray:
        """Position of each word within its text."""
        return np.arange(len(self.code)) - np.repeat(self.first[:-1], self.counts)


def _separators(punctuation: bool) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(SPACES)] = True
    if punctuation:
        out[[c for c in range(128) if not chr(c).isalnum()]] = True
    return out


_PLAIN, _PUNCT = _separators(False), _separators(True)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column, and the offset of each (null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(first row, bytes, offsets) of runs of texts of about `limit` bytes; a longer text is a run of its own."""
    data, offsets = text_bytes(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, punctuation: bool = False) -> Words:
    """Words of texts laid end to end. `punctuation`: ASCII characters but letters and digits separate words too."""
    if lower:
        data = _LOWER[data]
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~(_PUNCT if punctuation else _PLAIN)[data]
    opens = inside[1:-1] & ~inside[:-2]
    closes = inside[1:-1] & ~inside[2:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    opens[cut] = inside[1:-1][cut]  # a word never spans two texts
    closes[cut - 1] = inside[1:-1][cut - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(start, offsets)
    up, down = _BYTES.get(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * up[:n], out=sums[1:])
    code = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    return Words(data, start, end, first, code)


def window_codes(code: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` words of one array; runs over two texts are the caller's to drop."""
    n = len(code)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = _WORDS.get(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(code * up[:n], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[: n - size + 1])


def window_starts(words: Words, size: int) -> np.ndarray:
    """Indices of the words at which a window of `size` words of one text starts."""
    left = np.repeat(words.first[1:], words.counts) - np.arange(len(words.code))
    return np.flatnonzero(left >= size)
