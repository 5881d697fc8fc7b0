"""Trees and lists as data sources, analysers as a table function, and retrieval by bounded lists."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from heddle.functions.python_source import ANALYSERS, register_parts
from heddle.operators import embed, ranking, retrieve, vectors
from heddle.operators.resolve import build_graph
from heddle.sources import files, repos


def _tree(root, names):
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"# {name}\n")


NAMES = ["top.py", "a/x.py", "a/b/y.py", "a/b/c/d/z.pyi", "e/f/g.py", "e/__init__.py", "build/no.py", "e/.venv/no.py", "e/no.txt"]


@pytest.mark.parametrize("wanted", [1, 2, 3, 5, 100])
def test_folders_hold_every_file_once(tmp_path, wanted):
    _tree(tmp_path, NAMES)
    reader = files.TreeReader({"path": str(tmp_path), "partitions": str(wanted)})
    dealt = reader.partitions()
    assert len(dealt) <= wanted
    rows = sorted(row for part in dealt for row in reader.read(part))
    assert rows == sorted(("repo", n, f"# {n}\n") for n in NAMES if "no." not in n)


def test_a_tree_is_a_data_source(spark, tmp_path):
    _tree(tmp_path, NAMES)
    files.register(spark)
    read = lambda **how: spark.read.format("source_tree").options(**how).load(str(tmp_path))
    assert read(suffixes=".txt", repo_id="r").collect() == [("r", "e/no.txt", "# e/no.txt\n")]
    # a file at the top belongs to no tree
    assert {(r.repo_id, r.path) for r in read(trees="true").collect()} == {("a", "x.py"), ("a", "b/y.py"), ("a", "b/c/d/z.pyi"), ("e", "f/g.py"), ("e", "__init__.py")}
    (tmp_path / "none").mkdir()
    assert repos.read_repo(spark, tmp_path / "none").count() == 0
    with pytest.raises(Exception, match="no such folder"):
        repos.read_repo(spark, tmp_path / "absent").collect()


def test_a_list_is_written_whole_or_not_at_all(spark, tmp_path):
    at = tmp_path / "out" / "list.json"
    rows = spark.range(0, 100, 1, 7).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit('"\né'), "id")).alias("text"))
    assert repos.write_json_list(rows, at) == 100
    first = json.loads(at.read_text())
    assert [r["id"] for r in first] == list(range(100)) and first[0]["text"] is None and first[1]["text"] == '"\né1'
    bad = rows.withColumn("text", F.when(F.col("id") == 60, F.raise_error(F.lit("a bad row"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="a bad row"):
        repos.write_json_list(bad, at)
    assert json.loads(at.read_text()) == first and os.listdir(at.parent) == ["list.json"]
    assert repos.write_json_list(rows.limit(0), at) == 0 and json.loads(at.read_text()) == []
    files.register(spark)
    with pytest.raises(Exception, match="list.json"):
        rows.select(F.lit("1").alias("v")).write.format("json_list").mode("append").save(str(at))
    assert os.listdir(at.parent) == ["list.json"]


def words(path, source):
    """Another language: ``def name`` on a line defines, ``run name`` calls."""
    lines = [line.split() for line in source.split("\n")]
    symbols = [{"qualname": w[1], "kind": "function", "start_line": i, "end_line": i, "parent": None, "decorators": []} for i, w in enumerate(lines, 1) if w[:1] == ["def"]]
    calls = [{"caller": symbols[0]["qualname"] if symbols else None, "callee": w[1], "line": i} for i, w in enumerate(lines, 1) if w[:1] == ["run"]]
    return {"n_lines": len(lines), "symbols": symbols, "imports": [], "calls": calls, "bases": [], "errors": []}


def test_a_second_language_in_sql_and_in_a_graph(spark):
    rows = [("r", "a.py", "from .m import f as g\nclass C(B):\n    def go(self):\n        g()\n"), ("r", "b.w", "def one\ndef two\nrun two"), ("r", "bad.py", "def ("), ("r", "lost.py", None), ("r", "x.txt", "def"), ("r", None, "def")]
    table = spark.createDataFrame(rows, files.FILES)
    table.createOrReplaceTempView("tree_files")
    register_parts(spark, {**ANALYSERS, ".w": words})
    got = spark.sql("SELECT f.path, p.* FROM tree_files f, LATERAL source_parts(f.path, f.source) p")
    assert sorted(map(tuple, got.filter("part != 'error' AND path = 'a.py'").collect()), key=str) == sorted([
        ("a.py", "symbol", "C", None, "class", None, 2, 4),
        ("a.py", "symbol", "C.go", "C", "method", None, 3, 4),
        ("a.py", "import", "m", "f", "g", 1, 1, 1),
        ("a.py", "call", "g", "C.go", None, None, 4, 4),
        ("a.py", "base", "B", "C", None, None, 2, 2),
    ], key=str)
    assert {(r.part, r["name"]) for r in got.filter("path = 'b.w'").collect()} == {("symbol", "one"), ("symbol", "two"), ("call", "two")}
    assert sorted(r.path for r in got.filter("part = 'error'").collect()) == ["bad.py", "lost.py"]
    assert got.filter("path = 'x.txt' OR path IS NULL").count() == 0
    assert spark.sql("SELECT p.of, count(*) AS n FROM tree_files f, LATERAL source_parts(f.path, f.source) p WHERE p.part = 'call' GROUP BY p.of").count() == 2
    graph = build_graph(table.filter("path IS NOT NULL"), analysers={**ANALYSERS, ".w": words})
    assert ("b.w::one", "b.w::two", "calls") in {(r.src, r.dst, r.relation) for r in graph.edges.collect()}


def test_encoder_gives_unit_vectors(spark):
    df = spark.createDataFrame([(1, "load load json"), (2, ""), (3, None), (4, "json load load")], "id int, text string")
    got = {r.id: r.embedding for r in embed.hashed_words(df, "text", 16).collect()}
    assert got[1] == got[4] and abs(sum(x * x for x in got[1]) - 1) < 1e-12 and got[2] == got[3] == [0.0] * 16
    assert embed.hashed_words(df.limit(0), "text", 16).count() == 0


def test_nearest_by_group_is_what_all_pairs_give(spark):
    rnd = random.Random(5)
    sizes = {"big": 300, "small": 3, "one": 1, "unasked": 40}
    rows = [(g, [float(rnd.randrange(-2, 3)) for _ in range(4)]) for g in sorted(sizes) for _ in range(sizes[g])]
    have = [(i, *row) for i, row in enumerate(rows)]
    asked = [(-1 - i, g, [float(rnd.randrange(-2, 3)) for _ in range(4)]) for i, g in enumerate(["big"] * 20 + ["small", "one", "absent"])]
    schema = "vec_id long, g string, embedding array<double>"

    def unit(v):
        size = sum(x * x for x in v) ** 0.5
        return [x / size if size else 0.0 for x in v]

    want = set()
    for q, g, v in asked:
        near = sorted((-round(sum(a * b for a, b in zip(unit(v), unit(w), strict=True)) + 1e-12, 6), i) for i, h, w in have if h == g)
        want |= {(q, rank, i, -s) for rank, (s, i) in enumerate(near[:7], 1)}
    for block in (16, 4096):
        got = vectors.top_by_group(spark.createDataFrame(have, schema), spark.createDataFrame(asked, schema), "g", 7, block)
        assert {(r.query_id, r["rank"], r.vec_id, r.cosine + 0.0) for r in got.collect()} == want


@pytest.mark.parametrize("budget", [1, 60, 8000])
def test_retrieval_from_short_lists_is_that_from_all(spark, budget, monkeypatch):
    monkeypatch.setattr(retrieve, "FIRST_LISTS", 1)
    monkeypatch.setattr(retrieve, "LONGER", 2)
    rnd = random.Random(3)
    names = [f"name{i}" for i in range(12)]
    # most chunks overshoot a small budget, so that lists have to grow
    tree = spark.createDataFrame([(repo, f"f{i}.py", "\n".join(" ".join(rnd.choices(names, k=rnd.choice([1, 40]))) for _ in range(6))) for repo in ("r", "q") for i in range(20)], files.FILES)
    issues = spark.createDataFrame([("i", "r", "name1 name2 name3"), ("i", "q", "name4"), ("j", "r", "name5 name5 name6"), ("k", "q", ""), ("l", "absent", "name1")], "issue_id string, repo_id string, text string")
    how = retrieve.EmbeddingRetriever(k=3, chunk_lines=2)
    got = how.retrieve(issues, tree, budget_tokens=budget)
    every = how.rank(issues, tree)
    want = ranking.budget_pack(every, ["issue_id", "repo_id"], "position", "tokens", 3, budget).join(every.drop("tokens"), ["issue_id", "repo_id", "position"])
    assert sorted((r.issue_id, r.position, r.path, r.start_line, r.score) for r in got.collect()) == sorted((r.issue_id, r.picked_at, r.path, r.start_line, r.score) for r in want.collect())
    assert got.count() >= 4
