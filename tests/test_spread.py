"""The spread over numbered graphs: the same as over names, side by side or row by row, and steps that stay where they lie."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from heddle.operators import propagate

SETTINGS = [("a", 3, 0.0, False), ("b", 3, 0.6, True), ("c", 1, 0.0, False)]


def graph(spark):
    pick = random.Random(3)
    name = lambda i: f"n{i}"
    rows = {(pick.randrange(44), pick.randrange(44), pick.choice(["calls", "inherits", "contains", "odd"])) for _ in range(150)}
    # 40 to 43 are no nodes, and one end is unknown altogether
    edges = [(name(a), name(b), r, pick.choice([0.5, 1.0, None]), a * 7, b * 7) for a, b, r in sorted(rows)] + [(None, "n1", "calls", 1.0, None, 7)]
    nodes = [(name(i), i % 9 == 0, i * 7) for i in range(40)]
    seeds = [(x, name(pick.randrange(42)), w) for x in ("x", "y", None) for w in (1.0, 2.0, None)]
    schema = "src string, dst string, relation string, confidence double, src_id long, dst_id long"
    return spark.createDataFrame(edges, schema), spark.createDataFrame(nodes, "node string, is_module boolean, id long"), spark.createDataFrame(seeds, "issue_id string, node string, weight double")


def rows(df):
    return sorted((str(r.issue_id), r.config, r.node, r.distance, round(r.mass, 12), r.visits) for r in df.collect())


@pytest.mark.parametrize("at_once", [0, 400_000])
def test_numbers_and_names_and_rows_side_by_side(spark, monkeypatch, at_once):
    monkeypatch.setattr(propagate, "BROADCAST_ROWS", at_once)
    edges, nodes, seeds = graph(spark)
    grid = propagate.configs(spark, SETTINGS)
    run = lambda e, n: rows(propagate.spread(e, n, seeds, grid, reasons=False))
    beside = run(edges, nodes)
    by_name = run(edges.drop("src_id", "dst_id"), nodes.drop("id"))
    monkeypatch.setattr(propagate, "SIDE_BY_SIDE", 0)
    assert beside == by_name == run(edges, nodes) and {r[3] for r in beside} == {0, 1, 2, 3}


def test_steps_stay_where_they_lie(spark):
    edges, nodes, _ = graph(spark)
    steps = propagate.prepared(edges, nodes).steps
    assert "Exchange" not in steps.groupBy("a").count()._jdf.queryExecution().executedPlan().toString()


def test_first_ranks_are_the_ranks(spark):
    edges, nodes, seeds = graph(spark)
    reached = propagate.spread(edges, nodes, seeds.filter("issue_id IS NOT NULL"), propagate.configs(spark, SETTINGS), reasons=False)
    picked = lambda df: sorted((r.issue_id, r.config, r.node, r["rank"]) for r in df.filter("rank <= 5").collect())
    assert picked(propagate.ranked(reached, at_most=5)) == picked(propagate.ranked(reached))


def large(spark, monkeypatch):
    monkeypatch.setattr(propagate, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(propagate, "BLOCK_BITS", 4)
    return graph(spark)


def test_steps_of_a_large_graph_lie_by_blocks(spark, monkeypatch):
    """Neighbouring numbers lie together, and a frontier too long to broadcast comes to the steps, however many partitions shuffles have."""
    edges, nodes, _ = large(spark, monkeypatch)
    with propagate.planned_with(spark, {"spark.sql.shuffle.partitions": "64"}):
        whole = propagate.prepared(edges, nodes)
        front = whole.beside(whole.nodes.select(F.col("id").alias("a"), F.lit(1.0).alias("mass")))
        with whole.planned(spark):
            plan = whole.steps.join(front.hint("shuffle_hash"), whole.lies)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "ShuffledHashJoin" in plan
        where = whole.steps.select("a", F.input_file_name().alias("file")).distinct().collect()
    files = {}
    for r in where:
        files.setdefault(r.a >> 4, set()).add(r.file)
    assert len(files) > 10 and all(len(f) == 1 for f in files.values())
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_what_a_large_graph_shuffles_goes(spark, monkeypatch):
    edges, nodes, seeds = large(spark, monkeypatch)
    dirs = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: {n for d in dirs for _, _, names in os.walk(d) for n in names if n.startswith("shuffle_") and n.endswith(".data")}
    nodes.repartition(3, "node").count()
    before = shuffled()
    assert before
    propagate.prepared(edges, nodes)
    for _ in range(100):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before


@pytest.mark.parametrize("at_once", [0, 400_000])
def test_without_visits_the_rest_is_the_same(spark, monkeypatch, at_once):
    monkeypatch.setattr(propagate, "BROADCAST_ROWS", at_once)
    edges, nodes, seeds = graph(spark)
    run = lambda visits: propagate.ranked(propagate.spread(edges, nodes, seeds.filter("issue_id IS NOT NULL"), propagate.configs(spark, SETTINGS), reasons=False, visits=visits), without=("visits", "reasons"))
    got, want = (sorted((r.issue_id, r.config, r.node, r.distance, r["rank"], round(r.mass, 12)) for r in run(v).collect()) for v in (False, True))
    assert got == want and {r[3] for r in got} == {0, 1, 2, 3}
