import random
import shutil

import pytest

from pyspark.sql import functions as F

from heddle.operators import propagate
from heddle.operators.graph_store import GraphStore
from heddle.sources.snapshots import BUCKETS, bucket_of
from heddle.storage import materialise

SEEDS = "issue_id string, node string, weight double"


def tables(spark, edges, names):
    return spark.createDataFrame(edges, "src string, dst string, relation string, confidence double"), spark.createDataFrame([(n, n.startswith("m")) for n in names], "node string, is_module boolean")


def rows(df):
    return sorted((r.issue_id or "", r.config, r.node, r.distance, round(r.mass, 9), r.visits, tuple(r.reasons)) for r in df.collect())


def plain(edges, names, seeds, hops, floor, modules):
    """The spread of one issue by loops: node to (distance, mass, visits)."""
    weigh = lambda relation, forward: propagate.RELATION_WEIGHTS.get(relation, (propagate.OTHER_WEIGHT,) * 2)[forward]
    steps = {}
    for src, dst, relation, confidence in edges:
        confidence = 1.0 if confidence is None else confidence
        if src in names and dst in names and (relation != "calls" or confidence >= floor):
            steps.setdefault(src, []).append((dst, weigh(relation, 1) * confidence))
            steps.setdefault(dst, []).append((src, weigh(relation, 0) * confidence))
    found = {}
    for node, weight in seeds:
        if node in names:
            found[node] = (0, found.get(node, (0, 0.0, 0))[1] + weight, 0)
    front = {n: m for n, (_, m, _) in found.items()}
    for h in range(1, hops + 1):
        fresh = {}
        for node, mass in front.items():
            for nb, weight in steps.get(node, []):
                part = mass * propagate.DECAY / len(steps[node]) * weight
                if part > propagate.LEAST_MASS and nb not in found and (modules or not nb.startswith("m")):
                    m, n = fresh.get(nb, (0.0, 0))
                    fresh[nb] = (m + part, n + 1)
        found |= {n: (h, m, v) for n, (m, v) in fresh.items()}
        front = {n: m for n, (m, _) in fresh.items()}
    return found


def test_stored_graphs_spread_as_loops_do(spark, tmp_path):
    rng = random.Random(5)
    names = [f"m{i}" for i in range(6)] + [f"n{i}" for i in range(60)]
    edges = [(a, b, rng.choice(["calls", "calls", "imports", "contains", "odd"]), rng.choice([0.25, 0.5, 0.85, 1.0, None])) for a, b in ((rng.choice(names), rng.choice([*names, "gone"])) for _ in range(160))]
    settings = [("all", 3, 0.0, False), ("tied", 2, 0.2, False), ("sure", 3, 0.6, False), ("modules", 2, 0.85, True), ("none", 3, 1.5, False), ("still", 0, 0.0, False)]
    seeds = [("i", "n1", 1.0), ("i", "n1", 0.5), ("i", "gone", 1.0), ("j", "n2", 2.0), ("j", "m1", 1.0), (None, "n3", 1.0)]
    e, n = tables(spark, edges, names)
    store = GraphStore(spark, f"file://{tmp_path}/graph")
    assert store.put(e, n) == 1
    given, grid = spark.createDataFrame(seeds, SEEDS), propagate.configs(spark, settings)
    reached = materialise(propagate.spread_over(store.open(), given, grid), "reached")
    got = rows(reached)
    assert got == rows(propagate.spread(e, n, given, grid))
    want = []
    for issue in ("i", "j", None):
        for config, hops, floor, modules in settings:
            found = plain(edges, set(names), [(a, w) for k, a, w in seeds if k == issue], hops, floor, modules)
            want += [(issue or "", config, node, d, round(m, 9), v) for node, (d, m, v) in found.items()]
    assert [r[:6] for r in got] == sorted(want) and len(got) > 100
    places = {(r.issue_id, r.config, r.node): r["rank"] for r in propagate.ranked(reached).collect()}
    assert sorted(r for (i, c, _), r in places.items() if (i, c) == ("j", "all")) == list(range(1, sum(k[:2] == ("j", "all") for k in places) + 1))


def test_a_query_opens_the_buckets_of_its_frontier_only(spark, tmp_path):
    names = [f"n{i}" for i in range(400)]
    e, n = tables(spark, [(f"n{i}", f"n{i + 1}", "calls", 1.0) for i in range(399)], names)
    store = GraphStore(spark, f"file://{tmp_path}/graph")
    store.put(e, n)
    graph = store.open()
    near = [f"n{i}" for i in range(198, 203)]
    ids = graph.nodes.filter(F.col("node").isin(near))
    kept = {"nodes": {r.b for r in ids.select(bucket_of(F.col("node")).alias("b")).collect()}, "steps": {r.b for r in ids.select(bucket_of(F.col("id")).alias("b")).collect()}}
    kept["degrees"] = kept["steps"]
    gone = 0
    for name, buckets in kept.items():
        for folder in (tmp_path / "graph" / "data" / name).iterdir():
            for b in range(BUCKETS):
                if b not in buckets and (folder / f"bucket={b}").exists():
                    shutil.rmtree(folder / f"bucket={b}")
                    gone += 1
    assert gone > 100
    # whatever lies elsewhere is not even there
    found = propagate.spread_over(graph, spark.createDataFrame([("i", "n200", 1.0)], SEEDS), propagate.configs(spark, [("two", 2, 0.0, False)]))
    assert sorted((r.node, r.distance) for r in found.collect()) == [("n198", 2), ("n199", 1), ("n200", 0), ("n201", 1), ("n202", 2)]


def test_versions_nothing_stored_and_many_files(spark, tmp_path, monkeypatch):
    from heddle.operators import graph_store

    store = GraphStore(spark, f"file://{tmp_path}/graph")
    with pytest.raises(KeyError):
        store.open()
    names = [f"n{i}" for i in range(50)]
    assert store.put(*tables(spark, [("n0", "n1", "calls", 1.0)], names)) == 1
    old = store.open()
    monkeypatch.setattr(graph_store, "FILE_ROWS", 1)
    monkeypatch.setattr(graph_store, "LISTED", 1)
    assert store.put(*tables(spark, [("n0", f"n{i}", "calls", 0.5) for i in range(2, 50)] * 3, names)) == 2
    seeds, grid = spark.createDataFrame([("i", "n0", 1.0)], SEEDS), propagate.configs(spark, [("one", 2, 0.0, False)])
    assert {r.node for r in propagate.spread_over(old, seeds, grid).collect()} == {"n0", "n1"}
    assert {r.node for r in propagate.spread_over(store.open(), seeds, grid).collect()} == {"n0", *names[2:]}
    assert propagate.spread_over(store.open(), seeds.limit(0), grid).count() == 0
    assert store.put(*(t.limit(0) for t in tables(spark, [("n0", "n1", "calls", 1.0)], names))) == 3
    assert propagate.spread_over(store.open(), seeds, grid).count() == 0
