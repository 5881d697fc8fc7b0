"""Re-exports: long chains, choices, circles; edges that tie in their order."""

import itertools
import random

import pytest

from heddle.operators import reexports
from heddle.operators.graphs import last_edge_wins
from heddle.operators.resolve import build_graph


def follow(spark, own, takes):
    given = spark.createDataFrame([(k, v) for k, v in own.items()], "key string, node string")
    took = spark.createDataFrame([(k, s, i) for i, (k, s) in enumerate(takes)], "key string, src string, at int")
    return {r.key: r.node for r in reexports.follow(given, took).collect()}


def in_place(own, takes, passes=3):
    """Statements in order, each replacing what its name stood for."""
    value = dict(own)
    for _ in range(passes):
        for key, src in takes:
            if src in value:
                value[key] = value[src]
    return value


@pytest.mark.parametrize("order", list(itertools.permutations("abc")))
def test_circles_end_as_reading_in_order_does(spark, order):
    own = {k: k.upper() for k in "abc"}
    ahead = {"a": "b", "b": "c", "c": "a"}
    takes = [(k, ahead[k]) for k in order]
    assert follow(spark, own, takes) == in_place(own, takes)


def test_two_that_take_from_each_other_and_one_that_takes_from_itself(spark):
    own, takes = {"a": "A", "b": "B", "s": "S"}, [("a", "b"), ("b", "a"), ("s", "s"), ("t", "a")]
    assert follow(spark, own, takes) == in_place(own, takes) == {"a": "B", "b": "B", "s": "S", "t": "B"}


def test_circles_without_a_definition_give_nothing(spark):
    own = {"d": "D"}
    takes = [("x", "y"), ("y", "x"), ("z", "d"), ("z", "x"), ("u", "none"), ("v", "u"), ("v", "d"), ("d", "x"), ("w", "x")]
    assert follow(spark, own, takes) == {"d": "D", "z": "D", "v": "D"}


def test_a_chain_of_200_takes_few_rounds(spark, monkeypatch):
    rounds, plain = [], reexports.materialise
    monkeypatch.setattr(reexports, "materialise", lambda df, name: rounds.append(name) or plain(df, name))
    n = 200
    got = follow(spark, {f"m{n}": "N"}, [(f"m{i}", f"m{i + 1}") for i in range(n)])
    assert got == {f"m{i}": "N" for i in range(n + 1)}
    longest = max(len(list(g)) - 1 for name, g in itertools.groupby(rounds) if name == "ends")
    assert longest < 12


def test_any_order_without_circles(spark):
    pick = random.Random(5)
    names = [f"n{i}" for i in range(40)]
    own = {k: k.upper() for k in names if pick.random() < 0.3}
    takes = [(names[i], names[j]) for i, j in (sorted(pick.sample(range(40), 2)) for _ in range(70))]
    pick.shuffle(takes)
    want = in_place(own, takes, passes=60)
    assert follow(spark, own, takes) == want


def test_a_circle_in_one_repository_leaves_others_alone(spark):
    files = [("round", "a.py", "def x():\n    pass\nfrom b import x\n"), ("round", "b.py", "def x():\n    pass\nfrom a import x\n"), ("round", "use.py", "import a\ndef f():\n    a.x()\n")]
    files += [("plain", "p/__init__.py", "from .m import x\n"), ("plain", "p/m.py", "def x():\n    pass\n"), ("plain", "use.py", "import p\ndef f():\n    p.x()\n")]
    calls = build_graph(spark.createDataFrame(files, "repo_id string, path string, source string")).edges.filter("relation = 'calls'").collect()
    assert {(c.repo_id, c.src, c.dst) for c in calls} == {("round", "use.py::f", "b.py::x"), ("plain", "use.py::f", "p/m.py::x")}


def test_the_order_of_edges_decides_ties_by_its_later_columns(spark):
    rows = [("a", "b", "calls", 1, 0.5, 7), ("a", "b", "calls", 1, 1.0, 7), ("a", "b", "calls", 0, 0.9, 9)]
    for seed in range(3):
        df = spark.createDataFrame(random.Random(seed).sample(rows, 3), "src string, dst string, relation string, at int, confidence double, line int").repartition(3)
        assert [tuple(r) for r in last_edge_wins(df, ["at", "confidence"], ["confidence", "line"]).collect()] == [("a", "b", "calls", 1.0, 7)]
        joined = df.selectExpr("src", "dst", "relation", "at * 2 + CAST(confidence = 1.0 AS INT) AS at", "confidence", "line")
        assert [tuple(r) for r in last_edge_wins(joined, ["at"], ["confidence", "line"]).collect()] == [("a", "b", "calls", 1.0, 7)]
