"""Exact removal of repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte is removed if a string of ``length`` bytes that covers it also starts earlier: in a document with a smaller
doc_id, or earlier in the same one. Strings never cross documents, and are judged on the input.

Blocks of text that share a seed (see ``seeds``) meet in one shard, each different text once: a block equal byte for byte
to an earlier one goes whole. A shard concatenates its blocks, sorts the suffixes to ``length`` bytes, and takes the
Burrows-Wheeler transform. From the empty string's interval it extends strings by
one byte to the left, breadth first: all intervals of strings of one length at a time. The end of a new interval is a
border between suffixes whose common prefix is one byte shorter than the string; a border that an earlier level set is
not set again and its interval not followed. So common prefixes are found by increasing value, each once, and the
search stops at ``length``: neighbours without a border then share at least ``length`` bytes.

Nulls and empty texts have no bytes and keep none. A row without doc_id is returned as it is and matches nothing.
Rows that repeat a doc_id are taken as one document given twice: what is removed from one is removed from all. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import string_buffers
from .seeds import chunked, picked, repeated_spans, span_mask, with_spans

LENGTH = 100
SEED = 24
#: A seed with more different blocks than this is cut again by seeds four bytes shorter than the whole.
CROWD = 2_000
_SEPARATOR = 0xFF  # in no UTF-8 text
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``text`` in the order of their first ``depth`` bytes (at least), by prefix doubling."""
    n = len(text)
    pad = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, dtype=np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | pad[j : j + n]
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n, dtype=bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.empty(n, dtype=np.int64)
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = first
    have = 8
    while have < depth:
        last = np.append(new[1:], True)
        tied = np.flatnonzero(~(new & last))  # places in order, in groups of equal suffixes
        if not len(tied):
            break
        who = order[tied]
        after = who + have
        behind = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        pair = (rank[who].astype(np.uint64) << np.uint64(32)) | behind.astype(np.uint64)
        by = np.argsort(pair)
        order[tied], pair = who[by], pair[by]
        fresh = np.ones(len(pair), dtype=bool)
        fresh[1:] = pair[1:] != pair[:-1]
        new[tied] = fresh
        # a group's rank is the place where it begins
        rank[order[tied]] = np.maximum.accumulate(np.where(fresh, tied, 0))
        have *= 2
    return order


def prefix_borders(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """True where a suffix and the one before it share fewer than ``depth`` bytes, by backward extension of intervals."""
    n = len(text)
    bwt = text[order - 1]
    by_byte = np.argsort(bwt, kind="stable").astype(np.int32)  # from a suffix to the one that begins a byte later
    step = np.empty(n, dtype=np.int32)  # and the other way
    step[by_byte] = np.arange(n, dtype=np.int32)
    first = np.sort(bwt)
    new_byte = np.ones(n + 1, dtype=bool)
    new_byte[1:n] = first[1:] != first[:-1]
    border = np.zeros(n + 1, dtype=bool)
    border[0] = border[n] = True
    owner = np.full(n + 2, -1, dtype=np.int32)
    left, right = np.array([0]), np.array([n])
    for _ in range(depth):
        size = right - left
        total = int(size.sum())
        if not total:
            break
        ids = np.arange(len(left), dtype=np.int32)
        if total * 4 > n:  # most suffixes are in some interval: take them in their order after the step
            gaps = np.empty(2 * len(left) + 1, dtype=np.int64)
            gaps[1::2], gaps[0], gaps[2:-1:2], gaps[-1] = size, left[0], left[1:] - right[:-1], n - right[-1]
            names = np.full(2 * len(left) + 1, -1, dtype=np.int32)
            names[1::2] = ids
            of = np.repeat(names, gaps)[by_byte]
            starts = new_byte[:n].copy()
            starts[1:] |= of[1:] != of[:-1]
            left = np.flatnonzero(starts)
            right = np.append(left[1:], n)
            held = of[left] >= 0
            left, right = left[held], right[held]
        else:
            of = np.repeat(ids, size)
            here = np.arange(total) - np.repeat(np.cumsum(size) - size - left, size)
            there = step[here]
            owner[there + 1] = of
            begins = new_byte[there] | (owner[there] != of)
            ends = new_byte[there + 1] | (owner[there + 2] != of)
            owner[there + 1] = -1
            left, right = np.sort(there[begins]), np.sort(there[ends]) + 1
        fresh = ~border[right]
        left, right = left[fresh], right[fresh]
        border[right] = True
    return border[:n]


def repeats_in_shard(length: int):
    """solve() for ``seeds.shard_reader``: what repeats among a shard's blocks."""

    def solve(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, offs = string_buffers(table["body"])
        size = np.diff(offs)
        rows = len(size)
        # blocks side by side, each ended by a separator
        text = np.full(len(data) + rows, _SEPARATOR, dtype=np.uint8)
        begin = offs[:-1] + np.arange(rows)
        spot = np.arange(len(data)) + np.repeat(np.arange(rows), size)
        text[spot] = data
        order = sorted_suffixes(text, length)
        group = np.cumsum(prefix_borders(text, order, length)) - 1
        row = np.repeat(np.arange(rows), size + 1)[order]
        off = order - begin[row]
        whole = off + length <= size[row]
        row, off, group = row[whole], off[whole], group[whole]
        met = np.bincount(group, minlength=1)
        again = met[group] > 1
        row, off, group = row[again], off[again], group[again]
        doc, place = table["doc_id"].to_numpy()[row], table["pos"].to_numpy()[row] + off
        by = np.lexsort((place, doc, group))
        row, off, group, doc, place = row[by], off[by], group[by], doc[by], place[by]
        new = np.append(True, group[1:] != group[:-1])[: len(group)]
        first = np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))
        later = (doc != doc[first]) | (place != place[first])
        return joined(row[later], off[later], length)

    return solve


def joined(row: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``length`` at ``start``, joined to spans where they follow one another: (row, from, to)."""
    by = np.lexsort((start, row))
    row, start = row[by], start[by]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] > start[:-1] + 1)
    b = np.flatnonzero(new)
    last = np.append(b[1:], len(row)) - 1
    return row[b], start[b], start[last] + length if len(b) else start[b]


def byte_units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, offs


def byte_bodies(data, offs, doc, pos, size) -> tuple[np.ndarray, np.ndarray]:
    first = offs[doc] + pos
    return picked(data, first, first + size)


def cut_bytes(rows: pa.RecordBatch, data: np.ndarray, offs: np.ndarray, spans: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    gone = span_mask(rows.column(1).to_numpy(), spans, offs)
    edge = gone.copy()
    edge[1:] &= ~gone[:-1]
    starts = offs[:-1][offs[:-1] < len(gone)]
    edge[starts] = gone[starts]
    sums, begun = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(edge)])
    removed = sums[offs[1:]] - sums[offs[:-1]]
    ends = (offs - sums[offs]).astype(np.int32)
    kept = pa.Array.from_buffers(pa.binary(), len(removed), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data[~gone].tobytes())])
    return pa.RecordBatch.from_arrays([rows.column(1), pa.array(np.diff(offs)), pa.array(removed), pa.array(begun[offs[1:]] - begun[offs[:-1]]), kept], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _parts(documents: DataFrame, length: int, seed: int | None, longer_seed: int | None, crowd: int) -> tuple[DataFrame, int, DataFrame]:
    seed = seed or max(1, min(SEED, length // 3))
    longer_seed = longer_seed or max(seed, length - 4)
    docs, chunks, bits = chunked(documents)
    spans = repeated_spans(docs, chunks, bits, byte_units, byte_bodies, repeats_in_shard(length), window=length, seed=seed, longer_seed=longer_seed, crowd=crowd, own_document=False)
    return docs, chunks, spans


def removal_spans(documents: DataFrame, length: int = LENGTH, *, seed: int | None = None, longer_seed: int | None = None, crowd: int = CROWD) -> DataFrame:
    """doc_id, s, e: the byte spans to remove (they may overlap), for documents that have any."""
    return _parts(documents, length, seed, longer_seed, crowd)[2]


def suffix_dedup(documents: DataFrame, length: int = LENGTH, *, seed: int | None = None, longer_seed: int | None = None, crowd: int = CROWD) -> DataFrame:
    """One row per document, with the bytes that stay: RESULT. See the module's docstring for the rule and the edge cases."""
    docs, chunks, spans = _parts(documents, length, seed, longer_seed, crowd)
    return with_spans(docs, chunks, spans, cut_bytes, RESULT)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
ORACLES: dict[str, str] = {}
