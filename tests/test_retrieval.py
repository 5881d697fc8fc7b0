"""Seeds, retrievers, packing, evaluation, sources and sinks, the command line and the stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from heddle import api, cli
from heddle.functions.text import gold_files, identifier_offers, literal_candidates
from heddle.operators import evaluate, graphs, literals, ranking, render, retrieve, vectors
from heddle.operators.resolve import build_graph
from heddle.operators.seeds import extract_seeds, named_files
from heddle.sources import repos
from heddle.streaming.reindex import CHANGES, Reindexer
from heddle.streaming.windows import hourly

FILES = {
    "pkg/__init__.py": "",
    "pkg/models.py": "class Response:\n    def json(self):\n        return load()\n\ndef load():\n    pass\n",
    "pkg/other.py": "class Request:\n    def json(self):\n        return 1\n",
    "x/dup.py": "def first():\n    pass\n",
    "y/dup.py": "def second():\n    pass\n",
    "quiet.py": "def lonely():\n    pass\n",
}
ISSUES = {
    "trace": 'It fails.\n  File "/site/pkg/models.py", line 3, in json\n',
    "span": "`Response.json` is broken",
    "called": "Response.json() is broken",
    "prose": "the ordinary prose of a person who complains",
    "link": "see https://github.com/o/r/blob/abc123/pkg/models.py#L6 and https://github.com/o/r/blob/abc/quiet.py",
    "ambiguous": "look at dup.py and at quiet.py",
    "none": "",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("r", p, s) for p, s in FILES.items()], "repo_id string, path string, source string")


@pytest.fixture(scope="module")
def graph(files):
    return build_graph(files)


@pytest.fixture(scope="module")
def issues(spark):
    return spark.createDataFrame([(i, "r", t) for i, t in ISSUES.items()], "issue_id string, repo_id string, text string")


@pytest.fixture(scope="module")
def seeds(issues, graph):
    found = {i: {} for i in ISSUES}
    for r in extract_seeds(issues, graph).collect():
        found[r.issue_id][r.node] = r.weight
    return found


def test_seed_weights(seeds):
    assert seeds["trace"]["pkg/models.py::Response.json"] == 4.0
    assert seeds["span"] == {"pkg/models.py::Response.json": 2.0, "pkg/other.py::Request.json": 0.8} | {k: v for k, v in seeds["span"].items() if k.endswith("::Response")}
    assert seeds["called"]["pkg/models.py::Response.json"] == 1.5 and seeds["called"]["pkg/other.py::Request.json"] == 0.65
    assert seeds["link"] == {"pkg/models.py::load": 3.5, "quiet.py::<module>": 1.6, "pkg/models.py::<module>": 1.2}
    assert seeds["prose"] == {} and seeds["none"] == {} and seeds["ambiguous"] == {"quiet.py::<module>": 1.2}


def test_named_files(issues, graph):
    found = {(r.issue_id, r.path): r.named_at for r in named_files(issues, graph).collect()}
    assert found[("trace", "pkg/models.py")] == 1 and ("ambiguous", "quiet.py") in found and ("ambiguous", "x/dup.py") not in found


def test_graph_retriever(issues, files, graph):
    got = {}
    for r in retrieve.GraphRetriever(graph=graph, k=5).retrieve(issues, files).collect():
        got.setdefault(r.issue_id, []).append(r)
    first = min(got["trace"], key=lambda r: r.position)
    assert (first.path, first.start_line, first.end_line, first.symbol, first.score) == ("pkg/models.py", 2, 3, "Response.json", 1.0)
    assert first.text == "    def json(self):\n        return load()"
    assert {r.path for r in got["ambiguous"]} == {"quiet.py"} and "none" not in got
    tight = retrieve.GraphRetriever(graph=graph).retrieve(issues.filter("issue_id = 'trace'"), files, budget_tokens=1).collect()
    assert len(tight) == 1  # the first always fits


def test_embedding_retriever(issues, files):
    asked = issues.filter("issue_id = 'called'")
    rows = retrieve.EmbeddingRetriever(k=2).retrieve(asked, files).orderBy("position").collect()
    assert rows[0].path == "pkg/models.py" and rows[0].reason.startswith("embedding rank 1, cosine=0.") and len(rows) == 2
    packed = retrieve.contexts(retrieve.EmbeddingRetriever(k=2).retrieve(asked, files)).first()
    assert packed.files[0] == "pkg/models.py" and packed.token_estimate == sum(r.tokens for r in rows)
    with pytest.raises(ValueError, match="unknown mode"):
        retrieve.build_retriever("guess")


def test_packing_skips_and_stops(spark):
    rows = [("a", 1, 50), ("a", 2, 90), ("a", 3, 40), ("a", 4, 10), ("a", 5, 1), ("b", 1, 500), ("b", 2, 1), ("c", 1, 1), ("c", 2, 1), ("c", 3, 1)]
    df = spark.createDataFrame(rows, "g string, p int, cost long")
    got = [(r.g, r.p) for r in ranking.budget_pack(df, ["g"], "p", "cost", 2, 100).orderBy("g", "p").collect()]
    assert got == [("a", 1), ("a", 3), ("b", 1), ("c", 1), ("c", 2)]
    got = [(r.g, r.p) for r in ranking.budget_pack(df, ["g"], "p", "cost", 9, 100).orderBy("g", "p").collect()]
    assert got == [("a", 1), ("a", 3), ("a", 4), ("b", 1), ("c", 1), ("c", 2), ("c", 3)]


def test_chunks(spark):
    text = "\n".join(f"line {i}" for i in range(1, 101)) + "\n"
    df = spark.createDataFrame([("f", text), ("blank", "\n \n\t\n"), ("empty", ""), ("null", None)], "path string, text string")
    assert sorted((r.path, r.start_line, r.end_line) for r in ranking.chunk_lines(df).collect()) == [("f", 1, 40), ("f", 41, 80), ("f", 81, 100)]


def test_orders(spark):
    df = spark.createDataFrame([("i", "busy.py", 1), ("i", "busy.py", 2), ("i", "busy.py", 3), ("i", "quiet.py", 4)], "g string, path string, rank int")
    assert [r.rank for r in ranking.file_diversity(df, ["g"]).orderBy("position").collect()] == [1, 4, 2, 3]
    named = spark.createDataFrame([("i", "quiet.py", 1)], "g string, path string, named_at int")
    assert [r.rank for r in ranking.evidence_first(df, named, ["g"]).orderBy("position").collect()] == [4, 1, 2, 3]


def test_text_patterns(spark):
    row = spark.range(1).select(gold_files(F.lit("--- a/x.py\n+++ b/x.py\n+++ b/docs/a.md\n+++ b/y/z.py\n+++ b/x.py")).alias("gold"), literal_candidates(F.lit("use --min-similarity-lines or `some-option`, not --all; see W0613 and `x-y`")).alias("lits")).first()
    assert row.gold == ["x.py", "y/z.py"] and sorted(row.lits) == ["W0613", "min-similarity-lines", "some-option"]
    df = spark.createDataFrame([("a", "call load() and plain.name, `get`, snake_case")], "id string, text string")
    assert {r.name: r.weight for r in identifier_offers(df, "id").collect()} == {"snake_case": 1.0, "plain.name": 1.0, "name": 0.8, "load": 1.5}


def test_literals(spark):
    files = spark.createDataFrame([(str(i), "a min-lines b" if i < 9 else "rare-one min-lin") for i in range(10)] + [("n", None)], "file string, text string")
    lits = spark.createDataFrame([("1", "min-lines"), ("2", "rare-one"), ("3", "absent"), ("4", "in-li"), ("5", ""), ("6", "rare-one")], "literal_id string, literal string")
    assert {(r.literal_id, r.files) for r in literals.selective(literals.contains(files, lits)).collect()} == {("2", 1), ("6", 1)}
    assert literals.contains(files, lits.limit(0)).count() == 0


def test_lookups(spark):
    known = spark.createDataFrame([(p,) for p in ("src/pkg/models.py", "pkg/models.py", "lib/only.py", "a/dup.py", "b/dup.py")], "path string")
    asked = spark.createDataFrame([(m,) for m in ("/usr/lib/pkg/models.py", "only.py", "dup.py", "zz.py", "./a/dup.py", "///")], "mention string")
    assert {r.mention: r.path for r in graphs.suffix_match(asked, known, []).collect()} == {"/usr/lib/pkg/models.py": "pkg/models.py", "only.py": "lib/only.py", "./a/dup.py": "a/dup.py"}
    names = spark.createDataFrame([("f", "a.b.c"), ("f", "a.x"), ("f", "z")], "path string, name string")
    bound = spark.createDataFrame([("f", "a", "m1"), ("f", "a.b", "m2")], "path string, prefix string, target string")
    assert {r.name: r.target for r in graphs.longest_prefix(names, bound, ["path"]).collect()} == {"a.b.c": "m2", "a.x": "m1", "z": None}


def test_recall(spark):
    ranked = spark.createDataFrame([("i", "a", 1), ("i", "b", 4), ("i", "b", 2), ("j", "z", 1)], "id string, path string, rank int")
    gold = spark.createDataFrame([("i", "a"), ("i", "b"), ("j", "y"), ("k", "q")], "id string, path string")
    got = {(r.id, r.k): (r.recall, r.any_hit) for r in evaluate.recall_at_k(ranked, gold, ["id"], "path", levels=(1, 3)).collect()}
    assert got == {("i", 1): (0.5, True), ("i", 3): (1.0, True), ("j", 1): (0.0, False), ("j", 3): (0.0, False), ("k", 1): (0.0, False), ("k", 3): (0.0, False)}
    ranks = spark.createDataFrame([(r,) for r in (9, 1, 4, 2, None, 12)], "r int")
    row = evaluate.index_percentiles(ranks, [], "r").first()
    assert (row.n, row.p25, row.p50, row.p75, row.within_3, row.within_5, row.within_10) == (5, 2, 4, 9, 2, 3, 4)


def test_cosine_in_blocks(spark):
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 3), 1.0]) for i in range(60)] + [(99, None)], "vec_id long, embedding array<double>")
    whole = vectors.cosine_top_k(df, df.filter("vec_id % 20 = 0"), 5, block=1000)
    cut = vectors.cosine_top_k(df, df.filter("vec_id % 20 = 0"), 5, block=7)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect())) and whole.count() == 15


def test_instances_and_report(spark, files, graph, tmp_path):
    rows = [{"instance_id": "r", "repo": "org/name", "base_commit": "c", "problem_statement": ISSUES["trace"], "patch": "+++ b/pkg/models.py\n"}] + [{"instance_id": f"q{i}", "repo": "org/other", "base_commit": "c", "problem_statement": "", "patch": ""} for i in range(3)]
    (tmp_path / "i.json").write_text(json.dumps(rows))
    assert repos.read_instances(spark, f"{tmp_path}/i.json", max_per_repo=2).count() == 3
    one = repos.read_instances(spark, f"{tmp_path}/i.json", repos=["name"])
    scored = api.evaluate_instances(one, files, settings=[("graph", 2, 0.0), ("sure", 2, 0.6)], graph=graph)
    got = {(r["mode"], r.k): r.recall for r in scored.collect()}
    assert got["graph", 1] == got["seeds", 1] == got["sure", 20] == 1.0
    text = render.report(evaluate.summarise(scored, ["mode"]), spark.createDataFrame([("h1", 1, 0.5)], "config string, k int, mean_recall double"))
    assert "| 1 | 1.000 | 1.000 | +0.000 |" in text and "_No results present._" in text and "| h1 | 0.500 | - |" in text


def test_evaluation_of_all_modes(spark, tmp_path, capsys):
    issue = "Response.json() ignores --max-lines, see --no-such-option"
    rows = [{"instance_id": i, "repo": "org/name", "base_commit": "c", "problem_statement": t, "patch": p} for i, t, p in (("one", issue, "+++ b/pkg/models.py\n"), ("two", "", "+++ b/quiet.py\n"), ("bare", "--max-lines", ""))]
    (tmp_path / "i.json").write_text(json.dumps(rows))
    for name in ("one", "two", "bare"):
        for p, s in {**FILES, "pkg/models.py": FILES["pkg/models.py"] + 'OPTION = "--max-lines"\n'}.items():
            (tmp_path / "trees" / name / p).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / "trees" / name / p).write_text(s)
    assert cli.main(["evaluate", str(tmp_path / "i.json"), str(tmp_path / "trees"), "--out", str(tmp_path / "e.json")], spark) == 0
    shown = capsys.readouterr().out
    assert "- org/name: 2" in shown and "one is worth 0.500" in shown and "Graph against embedding" in shown
    kept = json.loads((tmp_path / "e.json").read_text())
    assert set(kept) == {"summary", "config", "rows"} and len(kept["rows"]) == 2 * 3 * len(evaluate.K_LEVELS)
    got = {(r["instance_id"], r["mode"], r["k"]): r["recall"] for r in kept["rows"]}
    assert got["one", "graph", 1] == got["one", "seeds", 1] == got["one", "embedding", 1] == 1.0
    assert got["two", "graph", 20] == got["two", "seeds", 20] == 0.0 and got["two", "embedding", 20] == 1.0
    assert cli.main(["probe", str(tmp_path / "i.json"), str(tmp_path / "trees"), "--out", str(tmp_path / "p.json")], spark) == 0
    probed = {r["instance_id"]: r for r in map(json.loads, (tmp_path / "p.json").read_text().splitlines())}
    assert probed["one"] == {"instance_id": "one", "gold": ["pkg/models.py"], "candidates": ["max-lines", "no-such-option"], "useful_candidates": ["max-lines"], "gold_reached": ["pkg/models.py"]}
    assert probed["two"]["candidates"] == [] and probed["bare"]["useful_candidates"] == ["max-lines"] and probed["bare"]["gold_reached"] == []


def test_a_literal_in_many_files_is_not_useful(spark):
    instances = spark.createDataFrame([("r", "x/y", "--common-option", "+++ b/f0.py\n"), ("n", "x/y", None, None)], "instance_id string, repo string, problem_statement string, patch string")
    for n, useful in ((8, ["common-option"]), (9, [])):
        tree = spark.createDataFrame([("r", f"f{i}.py", "'--common-option'") for i in range(n)], "repo_id string, path string, source string")
        found = {r.instance_id: r for r in api.literal_probe(instances, tree).collect()}
        assert found["r"].useful_candidates == useful and found["r"].gold_reached == (["f0.py"] if useful else []) and found["n"].candidates == []


def test_a_file_that_shrank_gives_no_stale_snippet(spark, files, graph):
    issue = spark.createDataFrame([("i", "r", "Response.json() and load() in pkg/models.py")], "issue_id string, repo_id string, text string")
    shrunk = files.withColumn("source", F.when(F.col("path") == "pkg/models.py", "class Response:\n").otherwise(F.col("source")))
    got = retrieve.GraphRetriever(graph=graph).retrieve(issue, shrunk).filter("path = 'pkg/models.py'").collect()
    assert got and all(r.end_line == 1 and r.text == "class Response:" for r in got)


def test_reports_that_are_none(spark, tmp_path):
    assert repos.report_or_none(spark, f"{tmp_path}/absent.json") is None
    for name, text in (("broken", "{not json"), ("other", '{"a": 1}'), ("empty", "")):
        (tmp_path / f"{name}.json").write_text(text)
        assert repos.report_or_none(spark, f"{tmp_path}/{name}.json") is None
    assert cli.main(["score", "--report", f"{tmp_path}/broken.json"], spark) == 2


def test_sources_and_sinks(spark, tmp_path):
    tree = tmp_path / "tree"
    for p, s in {**FILES, "build/skip.py": "x", ".venv/a.py": "x", "note.txt": "x", "pkg/stub.pyi": "def s(): ..."}.items():
        (tree / p).parent.mkdir(parents=True, exist_ok=True)
        (tree / p).write_text(s)
    (tree / "latin.py").write_bytes(b"x = '\xe9'\r\n")
    got = {r.path: r.source for r in repos.read_repo(spark, tree).collect()}
    assert set(got) == {*FILES, "pkg/stub.pyi", "latin.py"} and got["latin.py"] == "x = '�'\n"
    (tmp_path / "issue.json").write_text(json.dumps({"instance_id": "i7", "problem_statement": "Response.json() fails"}))
    (tmp_path / "plain.txt").write_text("\n  A title\nand more")
    assert tuple(repos.read_issues(spark, f"{tmp_path}/issue.json").first()) == ("i7", "", "Response.json() fails")
    assert tuple(repos.read_issues(spark, f"{tmp_path}/plain.txt").first())[:2] == ("plain", "A title")
    preds = spark.createDataFrame([("i", "patch", "mine")], "instance_id string, model_patch string, model_name_or_path string")
    assert repos.write_json_list(repos.checked_predictions(preds), tmp_path / "out" / "p.json") == 1
    assert json.loads((tmp_path / "out" / "p.json").read_text())[0]["model_name_or_path"] == "mine"
    with pytest.raises(Exception, match="reserved model name"):
        repos.checked_predictions(preds.withColumn("model_name_or_path", F.lit("Gold"))).collect()
    (tmp_path / "report.json").write_text(json.dumps({"submitted_instances": 0, "resolved_instances": 0, "resolved_ids": []}))
    assert repos.read_report(spark, f"{tmp_path}/report.json").first().resolved_rate == 0.0
    assert cli.main(["graph", str(tree), "--format", "dot", "--out", str(tmp_path / "g" / "x.dot")], spark) == 0
    assert cli.main(["graph", str(tree), "--format", "mermaid", "--max-nodes", "0"], spark) in (0, 2)
    assert cli.main(["resolve", str(tree), str(tmp_path / "issue.json"), "--out", str(tmp_path / "c.json")], spark) == 0
    found = json.loads((tmp_path / "c.json").read_text())
    assert found["files"][0] == "pkg/models.py" and found["mode"] == "graph"
    stats = found["stats"]
    assert stats["seeds"] >= 1 and stats["snippets"] == len(found["snippets"]) and stats["tokens"] == found["token_estimate"] and stats["reached"] >= stats["seeds"]
    assert stats["truncated_snippets"] == 0 and stats["graph_nodes"] > stats["graph_files"] > 0 and stats["k"] == 12 and stats["build_seconds"] > 0
    assert cli.main(["attempt", str(tree), str(tmp_path / "issue.json"), "--out", str(tmp_path / "p.txt")], spark) == 0
    assert (tmp_path / "p.txt").read_text() == api.STUB_PATCH
    top = api.blast_radius(spark, str(tree), "Response.json() fails", hops=1, limit=3)
    assert all(" from pkg/" in r or " to pkg/" in r or r == "seed" or ".py:" in r for row in top["ranked"] for r in row["reasons"]) and "::" not in str([r["reasons"] for r in top["ranked"]])
    assert top["ranked"][0]["distance"] == 0 and top["seeds"][0]["weight"] == 1.5 and len(top["ranked"]) <= 3
    assert api.resolve(spark, str(tree), "Response.json() fails").stub


def test_reindexing_a_stream(spark, tmp_path):
    put = lambda n, rows: spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    put(1, [("r", "a.py", "def f():\n    pass\n", 1), ("q", "b.py", "def g():\n    pass\n", 1)])
    index = Reindexer(spark, f"file://{tmp_path}/index")
    go = lambda: index.start(spark.readStream.schema(CHANGES).parquet(f"file://{tmp_path}/in"), f"file://{tmp_path}/check").awaitTermination()
    go()
    assert {(r.repo_id, r.node) for r in index.table("nodes").filter("kind = 'function'").collect()} == {("r", "a.py::f"), ("q", "b.py::g")}
    put(2, [("r", "a.py", "def f2():\n    pass\n", 2), ("r", "c.py", "from a import f2\ndef h():\n    f2()\n", 2)])
    go()
    assert {(r.repo_id, r.node) for r in index.table("nodes").filter("kind = 'function'").collect()} == {("r", "a.py::f2"), ("r", "c.py::h"), ("q", "b.py::g")}
    assert {(r.src, r.dst) for r in index.table("edges").filter("relation = 'calls'").collect()} == {("c.py::h", "a.py::f2")}


def test_windows_on_a_stream(spark, tmp_path):
    spark.sql("SELECT timestamp_ntz'2024-01-01 00:10:00' AS ts, 'a' AS event_type, 1.25D AS value UNION ALL SELECT timestamp_ntz'2024-01-01 00:50:00', 'a', 2D UNION ALL SELECT timestamp_ntz'2024-01-01 09:00:00', 'b', 1D").write.parquet(f"file://{tmp_path}/e")
    batch = {(str(r.hour), r.event_type): (r.events, r.total) for r in hourly(spark.read.parquet(f"file://{tmp_path}/e")).collect()}
    assert batch[("2024-01-01 00:00:00", "a")] == (2, 325)
    stream = hourly(spark.readStream.schema("ts timestamp_ntz, event_type string, value double").parquet(f"file://{tmp_path}/e"))
    stream.writeStream.format("memory").queryName("hours").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert {(str(r.hour), r.event_type): (r.events, r.total) for r in spark.table("hours").collect()} == {("2024-01-01 00:00:00", "a"): (2, 325)}


def test_kept_tables_can_be_deleted(spark):
    from heddle import storage

    kept = storage.materialise(spark.range(5), "some")
    assert kept.count() == 5
    assert storage.cleanup(spark) >= 1 and storage.cleanup(spark) == 0


@pytest.mark.parametrize("k, budget", [(1, 5), (4, 10), (12, 40), (3, 0)])
def test_packing_takes_what_a_loop_takes(spark, k, budget):
    rnd = random.Random(k)
    rows = [(g, at, rnd.randrange(rnd.choice([2, 9, 70]))) for g in range(30) for at in range(rnd.randrange(90))]
    want, state = set(), {}
    for g, at, cost in rows:
        n, used = state.get(g, (0, 0))
        if n < k and used < budget and (not n or used + cost <= budget):
            state[g] = (n + 1, used + cost)
            want.add((g, at, cost, *state[g]))
    got = ranking.budget_pack(spark.createDataFrame(rows, "g int, at int, cost long"), ["g"], "at", "cost", k, budget)
    assert {tuple(r) for r in got.collect()} == want
