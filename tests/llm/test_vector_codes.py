"""Vector codes against plain k-means in Python integers, and against the query's SQL."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    rows = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not rows:
        return []
    w = len(rows[0][1]) // 8
    parts = [[tuple(v[p * w : p * w + w]) for p in range(8)] for _, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    books = [[parts[i][p] for i in order[:16]] for p in range(8)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(6):
        for p in range(8):
            groups = {}
            for row in parts:
                groups.setdefault(near(row[p], books[p])[1], []).append(row[p])
            books[p] = [tuple(sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)) if k in groups else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    got = [[near(row[p], books[p]) for p in range(8)] for row in parts]
    errors, by_label = [sum(d for d, _ in g) for g in got], {}
    for (_, _, label), e in zip(rows, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    return sorted(((i, "".join(f"{k:02x}" for _, k in g), e, by_label[label], digest) for (i, _, label), g, e in zip(rows, got, errors, strict=True)), key=repr)


def run(spark, rows, tmp_path, parts=3):
    spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumn("CODE", F.lit("clash")).withColumn("trees", F.lit(1)).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    return sorted((tuple(r) for r in vc.op12_vector_codes(spark, str(tmp_path)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def vectors(n, dim, seed, spread=0.3):
    pick = random.Random(seed)
    middle = [[pick.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    return [(i, [pick.gauss(m, spread) for m in pick.choice(middle)], pick.choice([0, 1, None])) for i in range(n)]


@pytest.mark.parametrize(("n", "dim", "spread"), [(600, 16, 0.3), (300, 8, 0.01), (9, 24, 1.0), (400, 32, 2.0)])
def test_against_brute_force(spark, tmp_path, n, dim, spread):
    rows = vectors(n, dim, n, spread)
    assert run(spark, rows, tmp_path) == brute(rows)


def test_nulls_ties_and_repeats(spark, tmp_path):
    rows = vectors(60, 8, 1)
    rows += [(100 + i, [0.5] * 8, i % 2) for i in range(200)] + [(i % 3, [0.25, -0.25] * 4, None) for i in range(40)]
    rows += [(900, None, 1), (901, [None] + [0.0] * 7, 1), (902, [float("nan")] * 8, 1), (903, [float("inf")] + [0.0] * 7, 1), (None, [0.125] * 8, 4)]
    assert run(spark, rows, tmp_path) == brute(rows)


def test_no_vectors(spark, tmp_path):
    assert run(spark, [], tmp_path) == [] and run(spark, [(1, None, 1), (2, [], 1)], tmp_path) == []


def test_other_lengths_and_components_out_of_range(spark, tmp_path):
    rows = vectors(40, 8, 2)
    assert run(spark, rows + [(50, [0.0] * 16, 1), (51, [0.0] * 7, 1)], tmp_path) == brute(rows)
    with pytest.raises(Exception, match="a component of 32768"):
        run(spark, rows + [(60, [40000.0] * 8, 1)], tmp_path)


@pytest.mark.parametrize("seed", range(3))
def test_trees_answer_as_all_points_do_and_own_whole_balls(seed):
    pick = np.random.default_rng(seed)
    values = np.concatenate([pick.normal(m, 60, (700, 16)) for m in (0, 900, 5000)]).astype(np.int64)
    forest = vc.Forest(values)
    books = np.stack([values[pick.integers(0, len(values), 16)][:, 2 * p : 2 * p + 2] for p in range(8)])
    total, count = forest.sums(books)
    codes, error = forest.assign(books)
    for p in range(8):
        x = values[:, 2 * p : 2 * p + 2]
        d = ((x[:, None] - books[p][None]) ** 2).sum(axis=2)
        want = d.argmin(axis=1)
        assert (codes[:, p] == want).all()
        assert (count[p] == np.bincount(want, minlength=16)).all() and all((total[p, k] == x[want == k].sum(axis=0)).all() for k in range(16))
    by_ball = sum(int(forest.count[at].sum()) for at, _, part in forest.owners(books) if part is None)
    assert by_ball > len(values)  # of 8 points a vector, many go by whole balls


def test_sql_over_the_drivers_table(spark):
    duckdb, data = pytest.importorskip("duckdb"), "/root/testdata/sf0.001"
    try:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    except duckdb.Error:
        pytest.skip("the driver's tables are not here")
    got = sorted(tuple(r) for r in vc.op12_vector_codes(spark, data).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
    assert got == sorted(con.execute(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({vc.ORACLES['op12_vector_codes']})").fetchall())
