"""Numpy views of Arrow string batches, rolling hashes and window minima used inside Spark tasks.

Everything here works on one bounded slice of a partition: whole documents are concatenated as UTF-8 bytes, with
``offsets`` marking where each begins, so that one vector operation serves many documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of text handled by one vector operation; a worker's temporary arrays are about 100 times this.
SLICE_BYTES = 1 << 20

#: Bytes of rows that Spark hands to a Python worker at once; its own default holds 64 MB on both sides.
BATCH_BYTES = "4m"

_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK64 = (1 << 64) - 1


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    def run(x: int) -> np.ndarray:
        out = np.full(n, x, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(base), run(pow(base, -1, 1 << 64))


def powers(n: int, base: int = _MULTIPLIER) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    size = 1 << max(16, int(n).bit_length())
    up, down = _powers(size, base)
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit value over all of it (in place on a fresh array)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class PrefixHash:
    """Polynomial hashes, modulo 2**64, of any slice of a sequence of integers, after one pass over it."""

    def __init__(self, values: np.ndarray, base: int = _MULTIPLIER):
        n = len(values)
        up, self._down = powers(n + 1, base)
        self._sums = np.zeros(n + 1, dtype=np.uint64)
        terms = values.astype(np.uint64)
        terms += np.uint64(1)
        terms *= up[:n]
        np.cumsum(terms, out=self._sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._down[start])

    def grams(self, k: int) -> np.ndarray:
        """The hash of each run of k values."""
        n = len(self._sums) - k
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix((self._sums[k:] - self._sums[:-k]) * self._down[:n])


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of ``width`` values, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def runs(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after another."""
    total = int(counts.sum())
    starts = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) - np.repeat(starts, counts)


def bounded_batches(spark: SparkSession) -> None:
    """Keep what passes between Spark and a worker small, for this session from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    at = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches so that a slice holds ``limit`` bytes of text, or one longer row: (rows, bytes, offsets)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        data, offs = string_buffers(column)
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
            to = min(to, n)
            yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """The words of a slice, split at ASCII white space: first and last byte, document and hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hashed: bool = True):
        docs = len(offsets) - 1
        space = _SPACE[data]
        n = len(data)
        first = ~space
        inner = offsets[1:-1]
        inner = inner[inner < n]
        last = first.copy()
        if n:
            first[1:] &= space[:-1] | False
            last[:-1] &= space[1:]
        # a document's edge also ends a word
        live = ~space
        if len(inner):
            edge = np.unique(inner)
            edge = edge[edge > 0]
            first[edge] = live[edge]
            last[edge - 1] = live[edge - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.counts = np.bincount(self.doc, minlength=docs) if docs else np.zeros(0, np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)
        if hashed:
            self.hash = hash_spans(data, self.start, self.end)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each pair; ``start`` is in order. Works a bounded piece at a time."""
    out = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        base = int(start[at])
        to = max(at + 1, int(np.searchsorted(start, base + SLICE_BYTES, side="left")))
        stop = int(end[at:to].max())
        out[at:to] = PrefixHash(data[base:stop]).slices(start[at:to] - base, end[at:to] - base)
        at = to
    return out


def unused(name: str, columns: list[str]) -> str:
    """A column name like ``name`` that none of the columns has, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
