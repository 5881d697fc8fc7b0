"""Removal of lines that many documents share, with two Bloom filters ahead of the exact count.

A line's key is the line without ASCII white space at both ends and with A-Z lower-cased. Keys of at least
``min_length`` code points that at least ``min_docs`` documents hold lose all their lines but those of the largest
doc_id that holds them. Other lines stay, joined by line feeds.

A first pass puts the hashes of each document's keys into two Bloom filters: one for keys met, one for keys met again.
Each task fills filters of its own; they are merged by block, where a bit set in the first filter of two tasks is set
in the second. Their size follows the input's and stops at ``FILTER_BITS_AT_MOST``, the bound of what is broadcast.
A second pass shuffles only keys that the second filter knows: equal hashes are confirmed on the key itself, documents
counted and the largest chosen. A filter that is too full only lets more keys through to that exact step, so results do
not depend on its size.

Nulls and empty texts are one empty line, which is too short to be a key. A row without doc_id keeps all its lines and
counts for none. Rows that repeat a doc_id are one document given twice: they count once and lose the same lines. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise
from .arrays import bounded_batches, hash_spans, runs, slices, unused

MIN_LENGTH, MIN_DOCS = 20, 3
#: The most bits of one filter (16 MB), and the bits of a block of it.
FILTER_BITS_AT_MOST = 1 << 27
BLOCK_BITS = 1 << 15
#: Bytes of stored input for each filter bit.
BYTES_PER_BIT = 8
RESULT = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Lines:
    """The lines of a slice of documents, and their keys: low-cased bytes, first and last byte, hash (0: too short)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, min_length: int):
        breaks = np.flatnonzero(data == 0x0A)
        docs = len(offs) - 1
        self.counts = np.bincount(np.searchsorted(offs, breaks, side="right") - 1, minlength=docs) + 1
        self.offs = np.concatenate([[0], np.cumsum(self.counts)])
        self.start = np.sort(np.concatenate([offs[:-1], breaks + 1]), kind="stable")
        self.end = np.sort(np.concatenate([offs[1:], breaks]), kind="stable")
        self.doc = np.repeat(np.arange(docs), self.counts)
        self.low = _LOWER[data]
        # strip: the first and last byte of each line that is no white space
        solid = np.flatnonzero(~_SPACE[data])
        a, b = np.searchsorted(solid, self.start), np.searchsorted(solid, self.end)
        some = b > a
        self.first, self.last = self.start.copy(), self.start.copy()
        self.first[some], self.last[some] = solid[a[some]], solid[b[some] - 1] + 1
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        self.long = points[self.last] - points[self.first] >= min_length
        self.hash = np.zeros(len(self.start), dtype=np.uint64)
        at = np.flatnonzero(self.long)
        if len(at):
            self.hash[at] = np.maximum(hash_spans(self.low, self.first[at], self.last[at]), 1)

    def once_per_doc(self) -> np.ndarray:
        """One line for each document and key hash."""
        at = np.flatnonzero(self.long)
        order = np.lexsort((self.hash[at], self.doc[at]))
        at = at[order]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (self.hash[at][1:] != self.hash[at][:-1]) | (self.doc[at][1:] != self.doc[at][:-1])
        return at[new]


def filter_bits(stored_bytes: int) -> int:
    """The size of a filter, a power of two."""
    return min(FILTER_BITS_AT_MOST, max(BLOCK_BITS * 8, 1 << int(max(stored_bytes // BYTES_PER_BIT, 1)).bit_length()))


def _bits(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a hash: both in the block that its high bits name."""
    blocks = np.uint64(bits // BLOCK_BITS)
    block = (hashes >> np.uint64(40)) % blocks * np.uint64(BLOCK_BITS)
    inside = np.uint64(BLOCK_BITS - 1)
    return (block + (hashes & inside)).astype(np.int64), (block + ((hashes >> np.uint64(20)) & inside)).astype(np.int64)


def _holds(table: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    a, b = _bits(hashes, bits)
    return ((table[a >> 3] >> (a & 7)) & (table[b >> 3] >> (b & 7)) & 1).astype(bool)


def _set(table: np.ndarray, hashes: np.ndarray, bits: int) -> None:
    for at in _bits(hashes, bits):
        np.bitwise_or.at(table, at >> 3, (1 << (at & 7)).astype(np.uint8))


def fill_filters(bits: int, min_length: int):
    """mapInArrow: documents to the blocks of this task's two filters."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, again = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for _, data, offs in slices(batches):
            lines = Lines(data, offs, min_length)
            hashes = np.sort(lines.hash[lines.once_per_doc()])
            new = np.ones(len(hashes), dtype=bool)
            new[1:] = hashes[1:] != hashes[:-1]
            _set(again, np.unique(hashes[~new]), bits)
            hashes = hashes[new]
            _set(again, hashes[_holds(met, hashes, bits)], bits)
            _set(met, hashes, bits)
        size = BLOCK_BITS // 8
        used = np.flatnonzero(met.reshape(-1, size).any(axis=1))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([met[i * size : i * size + size].tobytes() for i in used], pa.binary()), pa.array([again[i * size : i * size + size].tobytes() for i in used], pa.binary())], names=["block", "met", "again"])

    return run


def merge_filters(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over rows sorted by block: one row for each block, with its second filter."""
    block, met, again = None, None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([again.tobytes()], pa.binary())], names=["block", "again"])

    for batch in batches:
        for k, m, a in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            m, a = np.frombuffer(m, np.uint8), np.frombuffer(a, np.uint8)
            if k != block:
                if block is not None:
                    yield out()
                block, met, again = k, m.copy(), a.copy()
            else:
                again |= a | (met & m)
                met |= m
    if block is not None:
        yield out()


def repeat_filter(docs: DataFrame, min_length: int, bits: int) -> np.ndarray:
    """The filter of keys met in two documents or more: ``bits`` bits, whatever the input."""
    parts = docs.select("text").mapInArrow(fill_filters(bits, min_length), "block int, met binary, again binary")
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge_filters, "block int, again binary")
    table = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():
        table[row.block * (BLOCK_BITS // 8) : (row.block + 1) * (BLOCK_BITS // 8)] = np.frombuffer(row.again, np.uint8)
    return table


def suspects(shared, bits: int, min_length: int):
    """mapInArrow: (doc_id, text) to the keys of each document that the filter knows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint8)
        for rows, data, offs in slices(batches):
            lines = Lines(data, offs, min_length)
            at = lines.once_per_doc()
            at = at[_holds(table, lines.hash[at], bits)]
            size = lines.last[at] - lines.first[at]
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            keys = lines.low[np.repeat(lines.first[at], size) + runs(size)]
            ids = rows.column(0).to_numpy(zero_copy_only=False)[lines.doc[at]].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(lines.hash[at].view(np.int64)), pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(keys.tobytes())])], names=["doc_id", "hash", "key"])

    return run


def dropped_keys(docs: DataFrame, min_length: int, min_docs: int, bits: int) -> DataFrame:
    """doc_id and the keys that it loses, each with its hash, for documents that lose any."""
    spark = docs.sparkSession
    bounded_batches(spark)
    named = docs.filter("doc_id IS NOT NULL").select("doc_id", "text")
    shared = spark.sparkContext.broadcast(repeat_filter(named, min_length, bits).tobytes())
    found = named.mapInArrow(suspects(shared, bits, min_length), "doc_id long, hash long, key binary").withColumn("digest", F.sha2("key", 256))
    # a digest stands for the key from here on: the text of a key moves once, inside its task, to be hashed whole
    found = found.select("doc_id", "hash", F.unhex(F.substring("digest", 1, 32)).alias("digest"))
    # both sides are tables: then a small one is broadcast, and beyond that Spark can split the task of a very common line
    per_doc = materialise(found.groupBy("digest", "doc_id").agg(F.first("hash").alias("hash")), "line-keys")
    common = per_doc.groupBy("digest").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper")).filter(F.col("docs") >= min_docs)
    common = materialise(common.select("digest", "keeper"), "common-lines")
    lost = per_doc.join(common, "digest").filter("doc_id <> keeper")
    return lost.groupBy("doc_id").agg(F.collect_list(F.struct("hash", "digest")).alias("lost"))


def dropped_lines(lists: pa.Array, data: np.ndarray, offs: np.ndarray, min_length: int) -> tuple[Lines, np.ndarray]:
    """The lines of a slice, and which of them go by the lists of lost keys."""
    lines = Lines(data, offs, min_length)
    lists = lists.fill_null([]) if lists.null_count else lists
    counts = np.diff(np.asarray(lists.offsets))
    gone = np.zeros(len(lines.start), dtype=bool)
    if not counts.sum():
        return lines, gone
    flat = lists.flatten()
    hashes, digests = flat.field(0).to_numpy(zero_copy_only=False).view(np.uint64), flat.field(1)
    lost: dict[tuple[int, int], list[bytes]] = {}
    for d, h, g in zip(np.repeat(np.arange(len(lists)), counts).tolist(), hashes.tolist(), digests.to_pylist(), strict=True):
        lost.setdefault((d, h), []).append(g)
    for i in np.flatnonzero(lines.long & (counts[lines.doc] > 0)).tolist():
        known = lost.get((int(lines.doc[i]), int(lines.hash[i])))
        if known and hashlib.sha256(lines.low[lines.first[i] : lines.last[i]]).digest()[:16] in known:
            gone[i] = True
    return lines, gone


def _kept(lines: Lines, gone: np.ndarray, data: np.ndarray, offs: np.ndarray, i: int, any_gone: int) -> bytes:
    if not any_gone:
        return data[offs[i] : offs[i + 1]].tobytes()
    at = np.arange(lines.offs[i], lines.offs[i + 1])[~gone[lines.offs[i] : lines.offs[i + 1]]]
    return b"\n".join(data[lines.start[k] : lines.end[k]].tobytes() for k in at)


def cut_lines(min_length: int, result: bool, keep: list[str]):
    """mapInArrow: documents with their lost keys in the last column to RESULT, or to themselves with the shorter text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in slices(batches):
            lines, gone = dropped_lines(rows.column(rows.num_columns - 1), data, offs, min_length)
            dropped = np.add.reduceat(gone.astype(np.int64), lines.offs[:-1])
            texts = [_kept(lines, gone, data, offs, i, k) for i, k in enumerate(dropped.tolist())]
            if result:
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(lines.counts.astype(np.int64)), pa.array(dropped), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])
            else:
                null = rows.column(rows.schema.get_field_index("text")).is_null()
                text = pa.array([None if n else t.decode() for t, n in zip(texts, null.to_pylist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([text if k == "text" else rows.column(rows.schema.get_field_index(k)) for k in keep], names=keep)

    return run


def _stored_bytes(df: DataFrame) -> int:
    """The optimiser's figure for the size of df, from its files' sizes."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(size, FILTER_BITS_AT_MOST * BYTES_PER_BIT)


def line_dedup(documents: DataFrame, min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS, bits: int | None = None) -> DataFrame:
    """One row per document: RESULT. See the module's docstring for the rule and the edge cases."""
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    lost = dropped_keys(docs, min_length, min_docs, bits or filter_bits(_stored_bytes(documents)))
    return docs.join(lost.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "lost").mapInArrow(cut_lines(min_length, True, []), RESULT)


def drop_common_lines(documents: DataFrame, min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS, bits: int | None = None) -> DataFrame:
    """The documents, with all their columns, without the lines that ``line_dedup`` drops."""
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    lost = dropped_keys(docs, min_length, min_docs, bits or filter_bits(_stored_bytes(documents)))
    own, gone = unused("doc_id", documents.columns), unused("lost", documents.columns)
    lost = lost.select(F.col("doc_id").alias(own), F.col("lost").alias(gone))
    joined = documents.join(lost.hint("shuffle_hash"), documents["doc_id"] == lost[own], "left").select(*documents.columns, gone)
    return joined.mapInArrow(cut_lines(min_length, False, documents.columns), documents.schema)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_line_dedup": op3_line_dedup}
ORACLES = {
    "op3_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i)
), keyed AS (
  SELECT doc_id, i, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT k.doc_id, k.i, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
}
