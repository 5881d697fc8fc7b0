import json

import pytest

from heddle import cli, probes
from heddle.operators import evaluate, render
from heddle.operators.graph_store import GraphStore
from heddle.operators.resolve import build_graph
from heddle.operators.retrieve import GraphRetriever, keyed

TREE = {
    "app.py": "from core import run\n\ndef start_server():\n    run()\n",
    "core.py": "from store import save\n\ndef run():\n    save()\n",
    "store.py": "def save():\n    return 1\n",
    "alone.py": "def quiet():\n    pass\n",
}
INSTANCES = [
    ("one", "org/a", "start_server() hangs", "+++ b/core.py\n+++ b/app.py\n"),
    ("two", "org/b", "nothing of use here", "+++ b/store.py\n"),
    ("bare", "org/b", "start_server() hangs", ""),
]


@pytest.fixture(scope="module")
def asked(spark):
    instances = spark.createDataFrame(INSTANCES, "instance_id string, repo string, problem_statement string, patch string")
    files = spark.createDataFrame([(i[0], p, s) for i in INSTANCES for p, s in TREE.items()], "repo_id string, path string, source string")
    return instances, files, build_graph(files)


def test_ablation(asked):
    rows = probes.ablation(*asked).collect()
    assert {r["mode"] for r in rows} == {name for name, _, _ in probes.ABLATION} | {"seeds"} and {r.instance_id for r in rows} == {"one", "two"}
    got = {(r.instance_id, r["mode"], r.k): r.recall for r in rows}
    assert got["one", "seeds", 20] == 0.5 and got["one", "baseline h1 c0.00", 20] == got["one", "imports-only h3 c0.86", 20] == 1.0
    assert not any(v for (i, _, _), v in got.items() if i == "two")


def test_structure(asked):
    rows = probes.structure_probe(*asked)
    assert sorted(map(tuple, rows.collect())) == [("one", 1, 2), ("two", 0, None)]
    s = probes.structure_summary(rows).first()
    assert (s.instances, s.without_novel_file, s.with_novel_file, s.p25, s.p50, s.p75, s.within_3) == (2, 1, 1, 2, 2, 2, 1)
    empty = probes.structure_summary(rows.limit(0)).first()
    assert empty.instances == 0 and empty.p50 is None


def test_diversity(asked):
    rows = probes.diversity_probe(*asked, k=1)
    got = {r.instance_id: r for r in rows.collect()}
    assert set(got) == {"one", "two"} and got["one"].gold == ["app.py", "core.py"]
    assert (got["one"].snippets, got["one"].delivered_files, got["one"].delivered_recall, got["one"].ranked_recall) == (1, 1, 0.5, 0.5)
    assert (got["two"].snippets, got["two"].delivered_recall) == (0, 0.0)
    s = probes.diversity_summary(rows).first()
    assert (s.instances, s.delivered_recall, s.ranked_recall, s.instances_with_gap, s.files_by_snippet) == (2, 0.25, 0.25, 0, 0.5)


def test_worked_example(asked):
    instances, files, _ = asked
    found = probes.worked_example(instances, files, "one", k=2)
    assert [(f["path"], f["gold"]) for f in found["files"]] == [("app.py", True), ("core.py", True)] and found["recall"] == 1.0
    assert found["files"][0]["reason"] == "named in the text" and "app.py:start_server @1" in found["files"][1]["reason"]
    assert found["graph"]["files"] == 4 and found["seeds_found"] == 1 and found["snippets"] == 2
    text = render.example_text(found)
    assert "2. GOLD core.py: calls" in text and "recall@2 = 1.00" in text
    with pytest.raises(KeyError):
        probes.worked_example(instances, files, "gone")


def test_ranks_from_a_stored_graph(spark, asked, tmp_path):
    instances, files, graph = asked
    issues = instances.selectExpr("instance_id AS issue_id", "instance_id AS repo_id", "problem_statement AS text")
    store = GraphStore(spark, f"file://{tmp_path}/graph")
    store.put(*keyed(graph))
    order = lambda r: sorted((x.issue_id, x.position, x.node, x.score, tuple(x.reasons)) for x in r.rank(issues, files).collect())
    assert order(GraphRetriever(graph=graph, adjacency=store.open())) == order(GraphRetriever(graph=graph)) != []


def test_commands_and_report(spark, asked, tmp_path, capsys):
    (tmp_path / "i.json").write_text(json.dumps([dict(zip(("instance_id", "repo", "problem_statement", "patch"), i), base_commit="c") for i in INSTANCES[:1]]))
    for p, s in TREE.items():
        (tmp_path / "trees" / "one").mkdir(parents=True, exist_ok=True)
        (tmp_path / "trees" / "one" / p).write_text(s)
    call = lambda name, *more: cli.main([name, str(tmp_path / "i.json"), str(tmp_path / "trees"), *more], spark)
    assert call("ablation", "--out", str(tmp_path / "a.json")) == 0
    shown = capsys.readouterr().out
    assert "n = **1** (a 1)" in shown and shown.index("| seeds |") < shown.index("| baseline h1 c0.00 |") and len(json.loads((tmp_path / "a.json").read_text())["rows"]) == 8 * len(evaluate.K_LEVELS)
    assert call("structure") == 0 and json.loads(capsys.readouterr().out)["p50"] == 2
    summary = spark.createDataFrame([("graph", 1, 2, 0.5)], "mode string, k int, instances long, mean_recall double")
    by = spark.createDataFrame([("org/a", "graph", 1, 2, 0.5)], "repo string, mode string, k int, instances long, mean_recall double")
    assert "| org/a | graph | 0.500 | - |" in render.report(summary, by_repo=by)
