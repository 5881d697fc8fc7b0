"""Places, order statistics, literals and intervals against plain loops, and their plans where one group is all there is."""

import random

from pyspark.sql import functions as F

from heddle.operators import evaluate, graphs, literals, order, ranking


def test_places_in_groups_of_any_size(spark):
    pick = random.Random(1)
    rows = [(pick.choice(["all"] * 8 + ["few", None]), pick.choice([1, 2, 3, None]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(7)
    got = {r.i: r.position for r in order.placed(df, ["g"], [F.desc("v"), F.col("i")]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        want |= {r[2]: n for n, r in enumerate(mine, 1)}
    assert got == want
    assert sorted(r.at for r in order.placed(df, [], ["i"], "at").collect()) == list(range(1, 3001))
    assert order.placed(df.limit(0), ["g"], ["i"]).count() == 0


def test_no_group_is_one_tasks(spark):
    df = spark.range(50_000).selectExpr("'one' AS g", "id AS i")
    plan = order.placed(df.repartition(16), ["g"], ["i"])._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_order_statistics(spark):
    pick = random.Random(2)
    rows = [(pick.choice(["a", "a", "b", None]), pick.choice([None, *range(40)])) for _ in range(900)] + [("lone", 5), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(5)
    got = {r.g: (r.n, r.p25, r.p50, r.p75, r.within_3) for r in evaluate.index_percentiles(df, ["g"], "v").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        mine = sorted(r[1] for r in rows if r[0] == g and r[1] is not None)
        if mine:
            n = len(mine)
            want[g] = (n, mine[n // 4], mine[n // 2], mine[3 * n // 4], sum(v <= 3 for v in mine))
    assert got == want
    whole = evaluate.index_percentiles(df, [], "v")
    flat = sorted(r[1] for r in rows if r[1] is not None)
    assert [tuple(r)[:4] for r in whole.select("n", "p25", "p50", "p75").collect()] == [(len(flat), *(flat[len(flat) * a // 4] for a in (1, 2, 3)))]
    assert "SinglePartition" not in whole._jdf.queryExecution().toString()


def test_evidence_and_diversity_with_null_paths(spark):
    pick = random.Random(3)
    rows = [("q", pick.choice(["x", "y", "z", None]), i) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "g string, path string, rank int").repartition(4)
    named = spark.createDataFrame([("q", "z", 1), ("q", "x", 2), ("q", "gone", 3)], "g string, path string, named_at int")
    first = {p: min(r for _, q, r in rows if q == p) for p in ("x", "y", "z", None)}
    lead = [first["z"], first["x"]]
    assert [r.rank for r in ranking.evidence_first(df, named, ["g"]).orderBy("position").collect()] == lead + [r for _, _, r in rows if r not in lead]
    heads = sorted(first.values())
    assert [r.rank for r in ranking.file_diversity(df, ["g"]).orderBy("position").collect()] == heads + [r for _, _, r in rows if r not in heads]


def test_literals_of_every_length(spark):
    pick = random.Random(4)
    texts = [(str(i), "".join(pick.choice("abcdé漢 -") for _ in range(pick.randint(0, 60)))) for i in range(150)] + [("null", None), ("long", "ab" * 700_000 + "needle-in-a-haystack" + "cd" * 700_000)]
    lits = [(str(i), (lambda t, a, n: t[a : a + n])(pick.choice(texts[:150])[1], pick.randint(0, 40), pick.randint(1, 12))) for i in range(120)]
    lits += [("no", "zzzzzzzz"), ("needle", "needle-in-a-haystack"), ("border", "bneedle-"), ("same", "ab"), ("same", "cd"), ("void", ""), ("none", None)]
    files = spark.createDataFrame(texts, "file string, text string").repartition(5)
    known = spark.createDataFrame(lits, "literal_id string, literal string").repartition(3)
    got = sorted(map(tuple, literals.contains(files, known).collect()))
    assert got == sorted({(f, i) for f, t in texts if t for i, lit in lits if lit and lit in t})


def test_a_literal_is_looked_up_by_its_rarest_gram(spark):
    files = spark.createDataFrame([(str(i), "common-part " + ("rare-part" if i == 3 else "other")) for i in range(50)], "file string, text string")
    known = literals.anchors(files, spark.createDataFrame([("1", "common-part rare-part"), ("2", "common-part nowhere")], "literal_id string, literal string")).collect()
    gram = known[0].gram.to_bytes(8, "little")
    assert [r.literal_id for r in known] == ["1"] and gram not in b"common-part other" and gram in b"common-part rare-part"


def test_innermost_span(spark):
    pick = random.Random(5)
    spans = [(pick.choice("kl"), s, s + pick.choice([0, 1, 5, 40, 900]), f"s{i}") for i in range(200) for s in [pick.randint(-500, 500)]] + [("k", 9, 3, "backward")]
    points = [(pick.choice("klm"), f"p{i}", pick.choice([None, *range(-600, 1500, 7)])) for i in range(300)]
    df = graphs.innermost(spark.createDataFrame(points, "key string, p string, at long"), spark.createDataFrame(spans, "key string, span_start long, span_end long, name string"), ["key"], "p", "at", "name")
    want = {p: min(((e - s, n) for q, s, e, n in spans if q == k and at is not None and s <= at <= e), default=(0, None))[1] for k, p, at in points}
    assert {r.p: r.inside for r in df.collect()} == want


def test_a_hundred_thousand_points_and_spans_on_one_key(spark):
    n = 100_000
    points = spark.range(n).selectExpr("'k' AS key", "id AS p", "id * 10 + 3 AS at")
    spans = spark.range(n).selectExpr("'k' AS key", "id * 10 AS span_start", "id * 10 + 7 AS span_end", "id AS name").unionByName(spark.createDataFrame([("k", 0, 10 * n, -1)], "key string, span_start long, span_end long, name long"))
    out = graphs.innermost(points, spans, ["key"], "p", "at", "name")
    assert out.filter("inside <> p OR inside IS NULL").count() == 0
    # pairs that meet in a bin: a few for each point, not a hundred thousand
    levels = spans.selectExpr("key", "length(bin(span_end - span_start)) AS level", "span_start", "span_end").selectExpr("level", "explode(array_distinct(array(shiftright(span_start, level), shiftright(span_end, level)))) AS bin")
    met = levels.join(points.selectExpr("at", "explode(array(4, 20)) AS level").selectExpr("level", "shiftright(at, level) AS bin"), ["level", "bin"]).count()
    assert met < 8 * n


def test_statistics_of_a_context(spark):
    from heddle.operators.retrieve import GraphRetriever

    long = "def long():\n" + "    x = 1\n" * 30 + "def short():\n    long()\n"
    files = spark.createDataFrame([("r", "a.py", long)], "repo_id string, path string, source string")
    issues = spark.createDataFrame([("i", "r", "`long` and short() in a.py"), ("j", "r", "nothing here")], "issue_id string, repo_id string, text string")
    by = GraphRetriever(max_snippet_lines=10)
    found = by.retrieve(issues, files)
    got = {r.issue_id: r for r in by.statistics.collect()}
    cut = [r for r in found.filter("issue_id = 'i'").collect() if r.end_line - r.start_line + 1 == 10]
    assert got["i"].truncated_snippets == len(cut) > 0 and got["i"].seed_files == 1 and got["i"].seeds >= 2 and got["i"].graph_files == 1
    assert (got["j"].seeds, got["j"].reached, got["j"].snippets, got["j"].truncated_snippets) == (0, 0, 0, 0)
