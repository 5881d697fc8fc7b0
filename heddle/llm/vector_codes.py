"""Vectors as short codes: a small codebook for each part of the vector, found by k-means over metric trees of the parts.

Components become integers (floor of 4096 times the component), so that sums, means and ties are exact and do not depend
on the order of rows. A vector is cut into ``PARTS`` equal parts; each part position has a codebook of ``ENTRIES`` entries.

Each chunk of ``CHUNK`` vectors builds one tree for each part position, once, middle-out (an anchors hierarchy): about
sqrt(n) anchors are set one after another at the point farthest from its anchor, and take over the points that are nearer
to them; points within half the distance of two anchors are passed over by the triangle inequality. Anchors are then
joined in pairs of the smallest enclosing balls up to a root, and split below by anchors of their own. A ball caches
centre, radius, count and sum of its points.

In a round, balls inherit a list of candidate entries from the ball above, and drop each entry that another one beats over
the whole ball (a linear bound over centre and radius, with room for rounding). A ball with one candidate left is wholly
owned: its cached sum and count go to the entry. Only leaves that stay undecided compare their points, in exact integers,
with the candidates left. Codebooks (a few hundred numbers) go to tasks; sums come back through a Spark aggregation of as
many numbers. The trees are a table in the shared folder, read once a round.

Vectors that are null or hold null or non-finite components are dropped, as are empty ones and those whose length is not
that of the smallest vec_id or no multiple of ``PARTS``. A component of 2**15 or more in size fails the job, since its
squared distances need not fit. vec_id null is encoded, but comes last when entries are chosen. Repeated rows are points
of their own. With fewer vectors than entries there are fewer entries. Extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise
from .arrays import bounded_batches, runs

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of a chunk, and points below which a ball is not split.
CHUNK, LEAF = 4096, 64
LIMIT = 1 << 15
#: Distinct labels whose sums are broadcast at most; more are joined by a shuffle.
BROADCAST_LABELS = 100_000
TREES = "trees binary"
RESULT = "vec_id long, label long, code string, error long"


def anchors(points: np.ndarray, most: int) -> tuple[np.ndarray, int]:
    """The anchor of each point, and how many anchors there are."""
    n = len(points)
    owner = np.zeros(n, dtype=np.int64)
    pivots = [points[0]]
    near = ((points - points[0]) ** 2).sum(axis=1)
    while len(pivots) < most:
        far = int(near.argmax())
        if near[far] <= 0:
            break
        pivot = points[far]
        apart = ((np.stack(pivots) - pivot) ** 2).sum(axis=1)
        # only points farther from their anchor than half of the way to the new one can change over
        asked = np.flatnonzero(near * 4 > apart[owner])
        d = ((points[asked] - pivot) ** 2).sum(axis=1)
        won = d < near[asked]
        owner[asked[won]] = len(pivots)
        near[asked[won]] = d[won]
        pivots.append(pivot)
    return owner, len(pivots)


class _Ball:
    __slots__ = ("centre", "radius", "sum", "count", "points", "inside")

    def __init__(self, points: np.ndarray | None, total: np.ndarray, count: int, radius: float, inside: list[_Ball]):
        self.points, self.sum, self.count, self.centre, self.radius, self.inside = points, total, count, total / count, radius, inside


def _around(values: np.ndarray, at: np.ndarray) -> _Ball:
    mine = values[at]
    total = mine.sum(axis=0)
    radius = np.sqrt((((mine - total / len(at)) ** 2).sum(axis=1)).max())
    return _Ball(at, total, len(at), float(radius), [])


def _groups(owner: np.ndarray, n: int) -> list[np.ndarray]:
    order = np.argsort(owner, kind="stable")
    return np.split(order, np.cumsum(np.bincount(owner, minlength=n))[:-1])


def _joined(balls: list[_Ball]) -> _Ball:
    """One tree of all balls: the two with the smallest enclosing ball are joined, until one is left."""
    balls = list(balls)
    centre = np.stack([b.centre for b in balls])
    radius = np.array([b.radius for b in balls])
    cost = (np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(axis=2)) + radius[:, None] + radius[None]) / 2
    np.fill_diagonal(cost, np.inf)
    for _ in range(len(balls) - 1):
        i, j = divmod(int(cost.argmin()), len(balls))
        a, b = balls[i], balls[j]
        both = _Ball(None, a.sum + b.sum, a.count + b.count, 0.0, [a, b])
        both.radius = max(float(np.linalg.norm(both.centre - x.centre)) + x.radius for x in (a, b))
        balls[i], centre[i], radius[i] = both, both.centre, both.radius
        cost[j], cost[:, j] = np.inf, np.inf
        radius[j] = np.inf
        row = (np.sqrt(((centre - both.centre) ** 2).sum(axis=1)) + both.radius + radius) / 2
        row[i] = np.inf
        cost[i], cost[:, i] = row, row
        root = both
    return root if len(balls) > 1 else balls[0]


def tree(values: np.ndarray) -> _Ball:
    """The anchors hierarchy of integer points, as a tree of balls."""
    rough = values.astype(np.float64)
    owner, n = anchors(rough, int(np.ceil(np.sqrt(len(values)))))
    balls = []
    for at in _groups(owner, n):
        ball = _around(values, at)
        if len(at) > LEAF and ball.radius > 0:
            inner, m = anchors(rough[at], int(np.ceil(np.sqrt(len(at)))))
            ball.inside = [_around(values, at[g]) for g in _groups(inner, m)]
        balls.append(ball)
    return _joined(balls)


class Forest:
    """The trees of a chunk as arrays over all balls of all parts; a ball's points and the balls in it lie together."""

    def __init__(self, values: np.ndarray):
        """values: vectors by components, as integers."""
        n, dim = values.shape
        self.n, self.width = n, dim // PARTS
        nodes: list[tuple[int, _Ball]] = []
        self.order = np.empty((PARTS, n), dtype=np.int32)
        start: dict[int, int] = {}
        for part in range(PARTS):
            root = tree(values[:, part * self.width : (part + 1) * self.width])
            nodes.append((part, root))
            stack, at = [root], 0
            while stack:  # in the order of a walk, each ball's points are one run
                ball = stack.pop()
                start[id(ball)] = part * n + at
                if ball.inside:
                    stack += reversed(ball.inside)
                else:
                    self.order[part, at : at + ball.count] = ball.points
                    at += ball.count
        first, size, i = [], [], 0
        while i < len(nodes):
            part, ball = nodes[i]
            first.append(len(nodes))
            size.append(len(ball.inside))
            nodes += [(part, b) for b in ball.inside]
            i += 1
        self.part = np.array([p for p, _ in nodes], dtype=np.int16)
        self.centre = np.stack([b.centre for _, b in nodes])
        self.radius = np.array([b.radius for _, b in nodes]) * (1 + 1e-9) + 1e-6
        self.sum = np.stack([b.sum for _, b in nodes])
        self.count = np.array([b.count for _, b in nodes], dtype=np.int64)
        self.start = np.array([start[id(b)] for _, b in nodes], dtype=np.int64)
        self.first, self.size = np.array(first, dtype=np.int32), np.array(size, dtype=np.int32)
        self.points = np.concatenate([values[self.order[p], p * self.width : (p + 1) * self.width] for p in range(PARTS)]).astype(np.int32)

    def owners(self, books: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """Wholly owned balls as (balls, their entries, None), undecided leaves' points as (points, their entries, parts)."""
        rough = books.astype(np.float64)
        norm = (rough**2).sum(axis=2)
        apart = np.sqrt(((rough[:, :, None] - rough[:, None]) ** 2).sum(axis=3))
        front = np.arange(PARTS)
        allowed = np.ones((PARTS, books.shape[1]), dtype=bool)
        loose: list[tuple[np.ndarray, np.ndarray]] = []
        while len(front):
            part = self.part[front]
            dots = np.einsum("mw,mkw->mk", self.centre[front], rough[part])
            reach = np.where(allowed, norm[part] - 2 * dots, np.inf)
            best = reach.argmin(axis=1)
            row = np.arange(len(front))
            lead = reach[row, best]
            spread = 2 * self.radius[front][:, None] * apart[part, best]
            size = norm[part] + norm[part, best][:, None] + 2 * np.abs(dots) + 2 * np.abs(dots[row, best])[:, None] + spread
            beaten = lead[:, None] - (norm[part] - 2 * dots) + spread < -1e-9 * size
            allowed = allowed & ~beaten
            allowed[row, best] = True
            owned = allowed.sum(axis=1) == 1
            yield front[owned], best[owned], None
            leaf = ~owned & (self.size[front] == 0)
            if leaf.any():
                loose.append((front[leaf], allowed[leaf]))
            inner = ~owned & ~leaf
            down = front[inner]
            times = self.size[down]
            front = np.repeat(self.first[down], times) + runs(times)
            allowed = np.repeat(allowed[inner], times, axis=0)
        if not loose:
            return
        balls, allowed = np.concatenate([b for b, _ in loose]), np.concatenate([a for _, a in loose])
        exact = (books**2).sum(axis=2)
        for part in range(PARTS):
            mine = np.flatnonzero(self.part[balls] == part)
            count = self.count[balls[mine]]
            at = np.repeat(self.start[balls[mine]], count) + runs(count)
            score = exact[part] - 2 * (self.points[at].astype(np.int64) @ books[part].T)
            score[~np.repeat(allowed[mine], count, axis=0)] = np.iinfo(np.int64).max
            yield at, score.argmin(axis=1), np.full(len(at), part)

    def sums(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum and count of each entry's points."""
        total, count = np.zeros(books.shape, dtype=np.int64), np.zeros(books.shape[:2], dtype=np.int64)
        for at, entry, part in self.owners(books):
            if part is None:
                np.add.at(total, (self.part[at], entry), self.sum[at])
                np.add.at(count, (self.part[at], entry), self.count[at])
            else:
                np.add.at(total, (part, entry), self.points[at])
                np.add.at(count, (part, entry), 1)
        return total, count

    def assign(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's entries by part, and its squared error."""
        entry = np.empty(PARTS * self.n, dtype=np.uint8)
        for at, best, part in self.owners(books):
            if part is None:
                at, best = np.repeat(self.start[at], self.count[at]) + runs(self.count[at]), np.repeat(best, self.count[at])
            entry[at] = best
        codes, error = np.empty((self.n, PARTS), dtype=np.uint8), np.zeros(self.n, dtype=np.int64)
        for part in range(PARTS):
            mine = entry[part * self.n : (part + 1) * self.n]
            codes[self.order[part], part] = mine
            error[self.order[part]] += ((self.points[part * self.n : (part + 1) * self.n] - books[part][mine]) ** 2).sum(axis=1)
        return codes, error


def grown(dim: int, chunk: int):
    """mapInArrow: (vec_id, label, embedding) to chunks of vectors with their trees."""

    def cut(held: list[pa.RecordBatch]) -> bytes:
        table = pa.Table.from_batches(held).combine_chunks()
        flat = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if len(flat) and np.abs(flat).max() >= LIMIT:
            raise ValueError(f"a component of {LIMIT} or more in size: its squared distance need not fit a long")
        values = np.floor(flat * SCALE).astype(np.int64).reshape(-1, dim)
        return pickle.dumps((table.column("vec_id").to_pylist(), table.column("label").to_pylist(), Forest(values)), protocol=5)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                take = batch.slice(0, chunk - n)
                held.append(take)
                n += take.num_rows
                batch = batch.slice(take.num_rows)
                if n == chunk:
                    yield pa.RecordBatch.from_arrays([pa.array([cut(held)], pa.binary())], names=["trees"])
                    held, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([cut(held)], pa.binary())], names=["trees"])

    return run


def summed(books: np.ndarray):
    """mapInArrow: trees to one partial sum of each number (slot, value) a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, dtype=np.int64), np.zeros(books.shape[:2], dtype=np.int64)
        for batch in batches:
            for trees in batch.column(0):
                more, n = pickle.loads(trees.as_py())[2].sums(books)
                total += more
                count += n
        if count.any():
            values = np.concatenate([total.ravel(), count.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["slot", "value"])

    return run


def encoded(books: np.ndarray):
    """mapInArrow: trees to RESULT."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for trees in batch.column(0):
                vec_id, label, forest = pickle.loads(trees.as_py())
                codes, error = forest.assign(books)
                text = codes.tobytes().hex()
                code = [text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)]
                yield pa.RecordBatch.from_arrays([pa.array(vec_id, pa.int64()), pa.array(label, pa.int64()), pa.array(code, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def kept_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, embedding of vectors without null or non-finite components."""
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return rows.filter(F.coalesce(finite, F.lit(False)))


def train(embeddings: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, chunk: int = CHUNK) -> tuple[DataFrame, np.ndarray]:
    """The table of trees of the vectors (vec_id, label, embedding), and the codebooks: part, entry, component."""
    spark = embeddings.sparkSession
    bounded_batches(spark)
    kept = kept_vectors(embeddings)
    sized = kept.filter((F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0))
    first = sized.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).collect()
    dim = len(first[0].embedding) if first else 0
    first = [r.embedding for r in first if len(r.embedding) == dim]
    books = np.floor(np.array(first, dtype=np.float64).reshape(len(first), dim) * SCALE).astype(np.int64)
    books = books.reshape(len(first), PARTS, dim // PARTS).transpose(1, 0, 2).copy()
    trees = materialise(sized.filter(F.size("embedding") == dim).mapInArrow(grown(dim, chunk), TREES), "trees")
    for _ in range(rounds if first else 0):
        slots = trees.mapInArrow(summed(books), "slot long, value long").groupBy("slot").agg(F.sum("value").alias("value")).collect()
        values = np.zeros(books.size + books.shape[0] * books.shape[1], dtype=np.int64)
        for r in slots:
            values[r.slot] = r.value
        total, count = values[: books.size].reshape(books.shape), values[books.size :].reshape(books.shape[:2])
        books = np.where(count[:, :, None] > 0, total // np.maximum(count, 1)[:, :, None], books)
    return trees, books


def encode(trees: DataFrame, books: np.ndarray) -> DataFrame:
    """RESULT for every vector of the trees."""
    return trees.mapInArrow(encoded(books), RESULT)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees, books = train(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    codes = materialise(encode(trees, books), "codes")
    by_label = materialise(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    by_label = F.broadcast(by_label) if by_label.count() <= BROADCAST_LABELS else by_label
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    joined = codes.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds unrolled, one pair of clauses each."""
    clauses = [
        f"kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS x FROM kept, (SELECT unnest(range({PARTS})) AS p))",
        f"b0 AS (SELECT p, e - 1 AS e, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) AS e FROM parts) WHERE e <= {ENTRIES})",
    ]
    near = "SELECT a.vec_id, a.label, a.p, a.x, arg_min(b.e, (list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.e)) AS e, min(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM parts a JOIN {b} b ON a.p = b.p GROUP BY ALL"
    for i in range(1, ROUNDS + 1):
        clauses.append(f"a{i} AS MATERIALIZED ({near.format(b=f'b{i - 1}')})")
        clauses.append(
            f"m{i} AS (SELECT p, e, list(q ORDER BY i) AS x FROM (SELECT p, e, i, (s - ((s % n) + n) % n) // n AS q FROM (SELECT p, e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{i}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY p, e, i)) GROUP BY p, e)"
        )
        clauses.append(f"b{i} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{i - 1} b LEFT JOIN m{i} m ON b.p = m.p AND b.e = m.e)")
    clauses.append(f"z AS MATERIALIZED ({near.format(b=f'b{ROUNDS}')})")
    clauses.append("r AS (SELECT vec_id, label, string_agg(format('{:02x}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM z GROUP BY vec_id, label)")
    clauses.append(f"h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})")
    return "WITH " + ",\n".join(clauses) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r, h"


QUERIES = {"op12_vector_codes": op12_vector_codes}
ORACLES = {"op12_vector_codes": _sql()}
