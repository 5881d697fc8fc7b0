"""Near-duplicate groups by SimHash fingerprints linked with BK-trees.

A text's words (runs without ASCII white space, A-Z lower-cased) give shingles of ``shingle`` words, repeats included; a
fingerprint bit is set if it is set in over half the shingles' XXH64 values (seed 42). A text of fewer words is one
shingle; one without words has fingerprint zero. Fingerprints link at ``radius`` or fewer differing bits, and a
document's component is named by the smallest doc_id that it reaches.

Only distinct fingerprints are compared. Two that differ in ``radius`` bits agree in at least one of ``radius + 1``
bands of bits, so each fingerprint is dealt to one bucket for each band. A bucket of more than ``CROWD`` fingerprints
is dealt again by the bands of its other bits. In a bucket the fingerprints form a BK-tree: a child hangs under its
parent by their integer distance, and a search follows only edges within the radius of its own distance. The trees stay
in the tasks that hold the buckets, since their size grows with the input and so they can't be broadcast; searches for
all fingerprints of a bucket go through its tree together, level by level. A bucket gives each fingerprint's link to the
least of its cluster, at most one row for each, and the clusters of all buckets are joined by rounds of star contraction
on tables in the shared folder.

Null texts have no words. A row without doc_id gets a fingerprint but no component, and links nothing. Rows that
repeat a doc_id are nodes of their own that share a name. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import Words, bounded_batches, runs, slices, unused
from ..storage import materialise

SHINGLE, RADIUS = 3, 2
XX_SEED = 42
#: The most fingerprints of a bucket that is not dealt again.
CROWD = 4096
ROUNDS_AT_MOST = 60

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxh64(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = XX_SEED) -> np.ndarray:
    """XXH64 of data[start : start + size] for each pair, step by step for all of them at once."""
    with np.errstate(over="ignore"):
        seed64 = np.uint64(seed)
        pad = np.concatenate([data, np.zeros(8, np.uint8)])
        # every eight bytes as one little-endian number
        word = np.zeros(len(data) + 1, dtype=np.uint64)
        for j in range(8):
            word |= pad[j : j + len(word)].astype(np.uint64) << np.uint64(8 * j)
        at = start.astype(np.int64)
        left = size.astype(np.int64)
        acc = np.full(len(start), seed64 + _P5, dtype=np.uint64)
        long = np.flatnonzero(left >= 32)
        if len(long):
            lanes = [np.full(len(long), v, dtype=np.uint64) for v in (seed64 + _P1 + _P2, seed64 + _P2, seed64, seed64 - _P1)]
            live, where = np.arange(len(long)), at[long]
            stripes = left[long] // 32
            for k in range(int(stripes.max())):
                live = live[stripes[live] > k]
                for i in range(4):
                    lanes[i][live] = _turn(lanes[i][live] + word[where[live] + 32 * k + 8 * i] * _P2, 31) * _P1
            mixed = _turn(lanes[0], 1) + _turn(lanes[1], 7) + _turn(lanes[2], 12) + _turn(lanes[3], 18)
            for lane in lanes:
                mixed = (mixed ^ (_turn(lane * _P2, 31) * _P1)) * _P1 + _P4
            acc[long] = mixed
            at[long] += 32 * stripes
            left[long] -= 32 * stripes
        acc += size.astype(np.uint64)
        for step, test in ((8, 8), (8, 8), (8, 8), (4, 4), (1, 1), (1, 1), (1, 1)):
            go = np.flatnonzero(left >= test)
            if not len(go):
                continue
            w, a = word[at[go]], acc[go]
            if step == 8:
                a = _turn(a ^ (_turn(w * _P2, 31) * _P1), 27) * _P1 + _P4
            elif step == 4:
                a = _turn(a ^ ((w & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
            else:
                a = _turn(a ^ ((w & np.uint64(0xFF)) * _P5), 11) * _P1
            acc[go] = a
            at[go] += step
            left[go] -= step
        acc ^= acc >> np.uint64(33)
        acc *= _P2
        acc ^= acc >> np.uint64(29)
        acc *= _P3
        acc ^= acc >> np.uint64(32)
        return acc


def fingerprints(data: np.ndarray, offs: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each document of a slice."""
    words = Words(data, offs, hashed=False)
    docs = len(offs) - 1
    if not len(words.start):
        return np.zeros(docs, np.uint64)
    size = words.end - words.start
    # lower-cased words, each followed by a space
    ends = np.cumsum(size + 1)
    text = np.full(int(ends[-1]), 0x20, dtype=np.uint8)
    begin = ends - size - 1
    text[np.repeat(begin, size) + runs(size)] = _LOWER[data[np.repeat(words.start, size) + runs(size)]]
    stop = begin + size
    count = np.where(words.counts >= shingle, words.counts - shingle + 1, np.minimum(words.counts, 1))
    first = np.repeat(words.offsets[:-1], count) + runs(count)
    last = np.minimum(first + shingle - 1, np.repeat(words.offsets[1:], count) - 1)
    h = xxh64(text, begin[first], stop[last] - begin[first])
    out = np.zeros(docs, dtype=np.uint64)
    some = np.flatnonzero(count)
    edge = np.concatenate([[0], np.cumsum(count[some])])[:-1]
    for bit in range(64):
        set_in = np.add.reduceat((h >> np.uint64(bit)) & np.uint64(1), edge)
        out[some] |= (2 * set_in > count[some].astype(np.uint64)).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprint_rows(shingle: int):
    """mapInArrow: (doc_id, text) to (doc_id, fp)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in slices(batches, limit=1 << 19):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fingerprints(data, offs, shingle).view(np.int64))], names=["doc_id", "fp"])

    return run


def bands(parts: int, bits: list[int]) -> list[list[int]]:
    """The given bit places in ``parts`` groups of nearly equal size."""
    return [bits[len(bits) * i // parts : len(bits) * (i + 1) // parts] for i in range(parts)]


def _pick(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), dtype=np.uint64)
    for i, bit in enumerate(bits):
        out |= ((fp >> np.uint64(bit)) & np.uint64(1)) << np.uint64(i)
    return out


def bucket_rows(radius: int):
    """mapInArrow: distinct fingerprints to (fp, band, bucket); band also names the deeper band, if any."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for i, bits in enumerate(bands(radius + 1, list(range(64)))):
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(np.full(len(fp), i, np.int32)), pa.array(_pick(fp, bits).view(np.int64))], names=["fp", "band", "bucket"])

    return run


def deeper_rows(radius: int):
    """mapInArrow: rows of crowded buckets to rows of the buckets below them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = bands(radius + 1, list(range(64)))
        for batch in batches:
            fps, of = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for i, bits in enumerate(top):
                fp = fps[of == i]
                rest = [b for b in range(64) if b not in set(bits)]
                for j, below in enumerate(bands(radius + 1, rest)):
                    key = _pick(fp, bits + below)
                    yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(np.full(len(fp), (i + 1) * 100 + j, np.int32)), pa.array(key.view(np.int64))], names=["fp", "band", "bucket"])

    return run


class Trees:
    """BK-trees, one for each bucket, side by side in arrays. Nodes are in the order given, buckets together."""

    def __init__(self, fp: np.ndarray, root: np.ndarray):
        """root: each node's root, the first node of its bucket."""
        self.fp, self.root = fp, root
        n = len(fp)
        self.parent, self.edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        # all nodes go down together; of those that reach a free place the first takes it, the others go on under it
        going, under = np.flatnonzero(root != np.arange(n)), root[root != np.arange(n)]
        keys = np.zeros(0, np.int64)
        owner = np.zeros(0, np.int64)
        while len(going):
            d = np.bitwise_count(fp[going] ^ fp[under]).astype(np.int64)
            place = under * 128 + d
            order = np.lexsort((going, place))
            new = np.ones(len(order), dtype=bool)
            new[1:] = place[order][1:] != place[order][:-1]
            winner = order[new]
            self.parent[going[winner]], self.edge[going[winner]] = under[winner], d[winner]
            keys = np.concatenate([keys, place[winner]])
            owner = np.concatenate([owner, going[winner]])
            lead = winner[np.cumsum(new) - 1]
            rest = order[~new]
            below = going[lead[~new]]
            going, under = going[rest], below
        by = np.argsort(keys)
        self.keys, self.child = keys[by], owner[by]

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of nodes within the radius, the tree walked for all nodes at once, a bounded number at a time."""
        n = len(self.fp)
        step = 1 << 15
        for a in range(0, n, step):
            stack = [(q := np.arange(a, min(a + step, n)), self.root[q])]
            while stack:
                q, node = stack.pop()
                if len(q) > 1 << 20:
                    half = len(q) // 2
                    stack += [(q[half:], node[half:]), (q[:half], node[:half])]
                    continue
                d = np.bitwise_count(self.fp[q] ^ self.fp[node]).astype(np.int64)
                near = (d <= radius) & (node < q)
                if near.any():
                    yield q[near], node[near]
                lo = np.searchsorted(self.keys, node * 128 + np.maximum(d - radius, 0))
                hi = np.searchsorted(self.keys, node * 128 + np.minimum(d + radius, 127), side="right")
                many = hi - lo
                if many.any():
                    stack.append((np.repeat(q, many), self.child[np.repeat(lo, many) + runs(many)]))


def clusters(n: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least node that each of n nodes reaches over the pairs."""
    least = np.arange(n)

    def tops(x: np.ndarray) -> np.ndarray:
        while True:
            up = least[x]
            if np.array_equal(up, x):
                return x
            x = up

    for a, b in pairs:
        while len(a):
            ra, rb = tops(a), tops(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            if len(a):
                np.minimum.at(least, np.maximum(ra, rb), np.minimum(ra, rb))
    return tops(np.arange(n))


def bucket_links(radius: int):
    """mapInArrow over rows sorted by (band, bucket): each fingerprint and the least of its cluster in the bucket."""

    def solved(table: pa.Table) -> pa.RecordBatch:
        band, bucket = table["band"].to_numpy(), table["bucket"].to_numpy()
        fp = table["fp"].to_numpy().view(np.uint64)
        new = np.ones(len(fp), dtype=bool)
        new[1:] = (band[1:] != band[:-1]) | (bucket[1:] != bucket[:-1])
        root = np.maximum.accumulate(np.where(new, np.arange(len(fp)), 0))
        least = clusters(len(fp), Trees(fp, root).links(radius))
        tied = np.flatnonzero(least != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[tied].view(np.int64)), pa.array(fp[least[tied]].view(np.int64))], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < 1 << 17:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            band, bucket = table["band"].to_numpy(), table["bucket"].to_numpy()
            edge = np.flatnonzero((band[1:] != band[:-1]) | (bucket[1:] != bucket[:-1])) + 1
            if not len(edge):
                held = table.to_batches()
                continue
            cut = int(edge[-1])
            yield solved(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
            rows = table.num_rows - cut
        if held:
            yield solved(pa.Table.from_batches(held).combine_chunks())

    return run


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``fp`` that join just those within ``radius`` of one another."""
    schema = "fp long, band int, bucket long"
    buckets = fps.mapInArrow(bucket_rows(radius), schema)
    size = buckets.groupBy("band", "bucket").agg(F.count("*").alias("held")).filter("held > 1")
    shared = buckets.join(size, ["band", "bucket"]).select("fp", "band", "bucket", "held")
    shared = materialise(shared, "simhash-buckets")
    few = shared.filter(F.col("held") <= crowd).select("fp", "band", "bucket")
    many = shared.filter(F.col("held") > crowd).select("fp", "band", "bucket").mapInArrow(deeper_rows(radius), schema)
    return few.unionByName(many).repartition("band", "bucket").sortWithinPartitions("band", "bucket", "fp").mapInArrow(bucket_links(radius), "a long, b long")


def star_components(links: DataFrame) -> DataFrame:
    """node and component (its least reachable node) for every node of the links (a, b), by alternating star contraction.

    A round ties every node's larger neighbours to its least one, then every node and its smaller neighbours to the
    least; it ends when every node hangs under the least of its component. Each round's table is in the shared folder.
    """
    edges = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    for _ in range(ROUNDS_AT_MOST):
        both = edges.union(edges.select("b", "a")).toDF("n", "m")
        low = both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
        large = both.filter("m > n").join(low, "n").select(F.col("m").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        after = materialise(small, "components")
        settled = after.count() == edges.count() and after.exceptAll(edges).isEmpty()
        edges = after
        if settled:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def simhash_components(documents: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    bounded_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    marked = materialise(docs.mapInArrow(fingerprint_rows(shingle), "doc_id long, fp long"), "simhash")
    least = marked.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = star_components(fingerprint_links(least.select("fp"), radius, crowd))
    named = least.join(found, least["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    # a table: small, it is broadcast; else Spark can split the task of a fingerprint that very many documents have
    of_fp = materialise(named.join(smallest, "component").select("fp", "component_id"), "simhash-names")
    out = marked.join(of_fp, "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_first_of_group(documents: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The documents, with all their columns, that are the smallest of their group; rows without doc_id stay."""
    named = simhash_components(documents, shingle, radius)
    own = unused("doc_id", documents.columns)
    later = named.filter("doc_id <> component_id").select(F.col("doc_id").alias(own)).distinct()
    return documents.join(later, documents["doc_id"] == later[own], "left_anti")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_simhash": op7_simhash}
ORACLES: dict[str, str] = {}
