"""Exact cosine search, in blocks of vectors and queries."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import few, materialise
from .ranking import top

BLOCK = 4096
#: Queries multiplied with a block at once.
QUERIES = 256


def _matrix(column: pa.Array) -> np.ndarray:
    width = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size > 0, size, 1)


def _nearest(key: np.ndarray, m: np.ndarray, have: np.ndarray, against: np.ndarray, k: int) -> pa.RecordBatch:
    near = m @ against
    near = np.floor(near * 1e6 + 0.500001) / 1e6
    near[key[:, None] == have[None]] = -2
    take = min(k, len(have))
    order = np.lexsort((np.broadcast_to(have, near.shape), -near), axis=1)[:, :take]
    q = np.repeat(np.arange(len(key)), take)
    flat = order.ravel()
    keep = near[q, flat] > -2
    return pa.RecordBatch.from_arrays([pa.array(key[q][keep]), pa.array(have[flat][keep]), pa.array(near[q, flat][keep])], names=["query_id", "vec_id", "cosine"])


def _search(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, vectors = None, [], []
        for batch in batches:
            blocks, asked = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.diff(blocks * 2 + asked)) + 1
            for a, b in zip([0, *edges], [*edges, len(blocks)], strict=True):
                if a == b:
                    continue
                if blocks[a] != block:
                    block, ids, vectors = blocks[a], [], []
                part = batch.slice(a, b - a)
                key, m = part.column(2).to_numpy(), _unit(_matrix(part.column(3)))
                if not asked[a]:
                    ids.append(key)
                    vectors.append(m)
                    continue
                if not ids:
                    continue
                have, against = np.concatenate(ids), np.concatenate(vectors).T
                for some in range(0, len(key), QUERIES):
                    yield _nearest(key[some : some + QUERIES], m[some : some + QUERIES], have, against, k)

    return run


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, cosine (six digits): each query's k nearest others, ties to the smaller id.

    Both: vec_id, embedding. Every query is sent to every block of about ``block`` vectors; blocks' lists are merged.
    Vectors must be of one length; nulls are left out.
    """
    vectors, queries = (v.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")) for v in (vectors, queries))
    blocks = max(1, -(-vectors.count() // block))
    dealt = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asked"), "vec_id", "embedding")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asked"), "vec_id", "embedding")
    found = dealt.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "asked").mapInArrow(_search(k), "query_id long, vec_id long, cosine double")
    return top(found, ["query_id"], [F.desc("cosine"), F.col("vec_id")], k)


def top_by_group(vectors: DataFrame, queries: DataFrame, by: str, k: int, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, cosine (six digits): each query's k nearest vectors of its own group, ties to the smaller id.

    Both: vec_id, embedding (of one length, not null) and ``by``. Ids of vectors are in the order of groups and no query
    has a vector's id. A group is cut into blocks of about ``block`` vectors, which its queries visit one after another,
    so a task holds a block and k rows of a query, whatever the size of a group or the number of its queries.
    """
    sizes = few(materialise(vectors.groupBy(by).agg(F.min("vec_id").alias("first"), F.ceil(F.count("*") / block).alias("blocks")), "blocks"))
    # a group has at least as many ids as blocks, so that numbers from its first id on are its own
    dealt = vectors.join(sizes, by).select((F.col("first") + F.pmod(F.xxhash64("vec_id"), "blocks")).alias("block"), F.lit(0).alias("asked"), "vec_id", "embedding")
    asked = queries.join(sizes, by).select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1)).alias("block"), F.lit(1).alias("asked"), "vec_id", "embedding")
    found = dealt.unionByName(asked).repartition("block").sortWithinPartitions("block", "asked").mapInArrow(_search(k), "query_id long, vec_id long, cosine double")
    return top(found, ["query_id"], [F.desc("cosine"), F.col("vec_id")], k)
