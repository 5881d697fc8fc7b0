"""Exact top-k inner products by MaxScore.

A component x becomes the integer floor(scale * x). Each dimension and sign is a term: its postings are the vectors
whose component has that sign, with the component's size as impact. Where the query's component has the same sign the
term adds to the score, at most the query's weight times the term's largest impact in a block; where the sign differs it
only takes away, so its bound is zero and it is never essential.

Vectors are dealt to shards and every query visits every shard, a block of ``VECTORS`` at a time. Each query's terms are
ordered by bound, and its own essential ones in a block are the fewest such that the bounds of all others add up to less
than the query's k-th best score so far. Only the postings of essential terms are traversed: a vector in none of them
can't compete and is not touched. The others are probed a few dimensions at a time, and a vector is left as soon as the
bounds of what is not yet probed can't lift it to the k-th score. Shards' lists are merged by score, ties to the smaller id.

Vectors that are null or hold null or non-finite components take no part, nor do rows without an id. Any finite
component counts: sums that floating point can't hold exactly are made of whole numbers of any size, and a score of the
answer that no long can hold is an error. Rows that repeat an id are rows of their own: each is a candidate, and each
asks if its id does. Missing dimensions of shorter vectors count as zero. With fewer than k other vectors all are
returned; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import materialise

K, SCALE, EVERY = 20, 64, 20
#: Vectors of a shard at least and at most, vectors of a block and queries at once, and dimensions probed at once.
SHARD_FROM, SHARD_TO, VECTORS, QUERIES_AT_ONCE, PROBE = 8192, 65536, 2048, 64, 16
_EXACT = 1 << 53
RESULT = "ask long, query_id long, vec long, vec_id long, score long"


def takes_part(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def integers(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), in floating point where that is exact for products too, else as whole numbers of any size."""
    with np.errstate(over="ignore"):
        scaled = np.floor(flat * scale)
    if len(flat) == 0 or np.abs(scaled).max() < 1 << 20:
        return scaled
    return np.array([int(np.floor(x * scale)) if abs(x) < _EXACT else int(x) * scale for x in flat.tolist()], dtype=object)


def matrix(column: pa.Array, width: int, scale: int) -> np.ndarray:
    offs = np.asarray(column.offsets)
    counts = np.diff(offs)
    flat = integers(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), scale)
    out = np.zeros((len(counts), width), dtype=flat.dtype)
    out[np.repeat(np.arange(len(counts)), counts), np.arange(len(flat)) - np.repeat(offs[:-1] - offs[0], counts)] = flat
    return out


class Block:
    """Postings of some vectors: a row of impacts for each dimension and sign, zero where a vector is not in the list.

    Lists of a vector's signs are long, about half of the vectors each, so that whole rows are their shortest form and
    the lists of many queries' essential terms are traversed by one product of matrices.
    """

    def __init__(self, vectors: np.ndarray):
        self.by_dimension = np.ascontiguousarray(vectors.T)
        self.postings = np.concatenate([np.maximum(vectors.T, 0), np.maximum(-vectors.T, 0)])
        self.largest = self.postings.max(axis=1, initial=0)
        self.holds = (self.postings > 0).astype(np.float32)


class Shard:
    """The vectors of a shard in the order of their ids, in blocks."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((rows, ids))
        self.ids, self.rows, self.vectors = ids[order], rows[order], vectors[order]
        self.blocks: dict[type, list[Block]] = {}

    def cut(self, queries: np.ndarray) -> tuple[np.ndarray, list[Block]]:
        """Queries and blocks in a type in which every sum of their products is exact."""
        most = [int(np.abs(x).max(initial=0)) for x in (queries, self.vectors)]
        top = most[0] * most[1] * max(queries.shape[1], 1)
        kind = np.float32 if top < 1 << 24 else np.float64 if top < _EXACT else object
        whole = lambda x: x.astype(kind) if kind is not object or x.dtype == object else x.astype(np.int64).astype(object)
        if kind not in self.blocks:
            self.blocks[kind] = [Block(whole(self.vectors[a : a + VECTORS])) for a in range(0, len(self.ids), VECTORS)]
        return whole(queries), self.blocks[kind]

    def search(self, own: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row in queries, place in the shard, score) of each query's k best rows but its own."""
        n_queries, width = queries.shape
        queries, blocks = self.cut(queries)
        weights = np.concatenate([np.maximum(queries, 0), np.maximum(-queries, 0)], axis=1)
        at = np.arange(n_queries)[:, None]
        best = [(queries[:0, 0], np.zeros(0, np.int64))] * n_queries  # scores and places, best first
        least = np.zeros(n_queries, dtype=queries.dtype)  # the k-th best scores so far,
        full = np.zeros(n_queries, dtype=bool)  # of queries that have k
        for number, block in enumerate(blocks):
            bound = weights * block.largest
            bound = bound[:, :width] + bound[:, width:]  # a dimension has one sign in a query
            order = np.argsort(-bound, axis=1, kind="stable")
            rest = np.zeros((n_queries, width + 1), dtype=queries.dtype)  # the bounds of a query's terms from the m-th on
            rest[:, :-1] = np.cumsum(bound[at, order][:, ::-1], axis=1)[:, ::-1]
            many = np.where(full, (rest[:, :-1] >= least[:, None]).sum(axis=1), width)
            essential = np.zeros((n_queries, width), dtype=bool)
            essential[at, order] = np.arange(width) < many[:, None]
            terms = np.concatenate([essential, essential], axis=1) & (weights > 0)
            used = np.flatnonzero(terms.any(axis=0))
            score = np.where(terms, weights, 0)[:, used] @ block.postings[used]
            met = terms[:, used].astype(np.float32) @ block.holds[used] > 0
            # a score of zero or less is reached without any posting
            live = (met | (least <= 0)[:, None]) & (score + rest[np.arange(n_queries), many][:, None] >= least[:, None])
            live |= ~full[:, None]
            live &= self.rows[None, number * VECTORS : (number + 1) * VECTORS] != own[:, None]
            for i in np.flatnonzero(live.any(axis=1)).tolist():
                v = np.flatnonzero(live[i])
                s = self._probed(block, queries[i], order[i], rest[i], int(many[i]), v, score[i, v], least[i] if full[i] else None)
                scores = np.concatenate([best[i][0], s[1]])
                places = np.concatenate([best[i][1], s[0] + number * VECTORS])
                best[i] = scores, places = _best(scores, places, k)
                if len(scores) == k:
                    least[i], full[i] = scores[-1], True
        sizes = [len(x[0]) for x in best]
        return np.repeat(np.arange(n_queries), sizes), np.concatenate([x[1] for x in best]), np.concatenate([x[0] for x in best])

    @staticmethod
    def _probed(block: Block, query, order, rest, many: int, v: np.ndarray, s: np.ndarray, least) -> tuple[np.ndarray, np.ndarray]:
        """The vectors that still compete when all dimensions are probed, and their scores."""
        for a in range(0, len(query), PROBE):
            dims = order[a : a + PROBE]
            add = block.by_dimension[np.ix_(dims, v)] * query[dims, None]
            if a < many:  # of a traversed term only what it takes away is new
                add[: many - a] = np.minimum(add[: many - a], 0)
            s = s + add.sum(axis=0)
            if least is not None:
                able = s + rest[max(many, a + len(dims))] >= least
                v, s = v[able], s[able]
        return v, s


def _best(scores: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best scores; of equal ones those at the first places, which are in the order of ids."""
    if scores.dtype == object:
        first = np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], places[i]))[:k], dtype=np.int64)
        return scores[first], places[first]
    if len(scores) > k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, places = scores[keep], places[keep]
    first = np.lexsort((places, -scores))[:k]
    return scores[first], places[first]


def search_shards(k: int, scale: int):
    """mapInArrow over rows sorted by (shard, is_query): a shard's vectors come first, then its queries."""

    def answers(shard: Shard, part: pa.RecordBatch) -> pa.RecordBatch:
        rows, ids, asked = part.column(2).to_numpy(), part.column(3).to_numpy(), matrix(part.column(4), part.column(5)[0].as_py(), scale)
        q, places, scores = shard.search(rows, asked, k)
        # whole numbers that no long holds are an error here
        scores = pa.array(scores.tolist(), pa.int64()) if scores.dtype == object else pa.array(scores.astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(rows[q]), pa.array(ids[q]), pa.array(shard.rows[places]), pa.array(shard.ids[places]), scores], names=["ask", "query_id", "vec", "vec_id", "score"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, shard = None, [], None
        for batch in batches:
            keys = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                number, is_query = divmod(int(keys[a]), 2)
                if number != current:
                    current, held, shard = number, [], None
                part = batch.slice(a, b - a)
                if not is_query:
                    held.append(part)
                    continue
                if shard is None and held:
                    table = pa.Table.from_batches(held).combine_chunks()
                    shard = Shard(table["vec_id"].to_numpy(), table["vec"].to_numpy(), matrix(table["embedding"].combine_chunks(), table["width"][0].as_py(), scale))
                    held = []
                if shard is not None:
                    for a in range(0, part.num_rows, QUERIES_AT_ONCE):
                        yield answers(shard, part.slice(a, QUERIES_AT_ONCE))

    return run


def top_k(embeddings: DataFrame, queries: Column, k: int = K, scale: int = SCALE, shard: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``queries`` (a condition on vec_id) picks, its k best others."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding")).filter(F.col("vec_id").isNotNull() & takes_part(F.col("embedding")))
    rows = rows.select(F.monotonically_increasing_id().alias("vec"), "vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = materialise(rows, "vectors")  # the numbers of rows are in this table, the same for every use of it
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    shard = shard or min(max(size["n"] // 64, SHARD_FROM), SHARD_TO)
    shards, width = max(1, -(-size["n"] // shard)), max(1, size["width"] or 0)
    wide = F.lit(width).alias("width")
    dealt = rows.select(F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("is_query"), "vec", "vec_id", "embedding", wide)
    asked = rows.filter(queries).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("is_query"), "vec", "vec_id", "embedding", wide)
    found = dealt.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "is_query").mapInArrow(search_shards(k, scale), RESULT)
    rank = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id", "vec"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % EVERY == 0)


QUERIES = {"op6_topk": op6_topk}
ORACLES = {
    "op6_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 20
"""
}
