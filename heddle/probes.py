"""Questions about the retrieval that evaluation alone leaves open, each asked of all instances at once.

All take ``instances`` (instance_id, repo, problem_statement, patch) and ``files`` (repo_id: the instance whose snapshot it
is, path, source); an instance without gold files is left out.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .api import as_files, asked, evaluate_instances, evidence
from .operators import evaluate, ranking
from .operators.propagate import rounded
from .operators.resolve import CodeGraph, build_graph
from .operators.retrieve import BUDGET, GraphRetriever, K
from .operators.seeds import extract_seeds, named_files
from .storage import materialise

# The settings of an ablation (name, hops, least confidence). Each step up leaves out one way of resolving calls.
ABLATION = [
    ("baseline h3 c0.00", 3, 0.00),
    ("no-ambiguous h3 c0.30", 3, 0.30),
    ("no-guesses h3 c0.60", 3, 0.60),
    ("imports-only h3 c0.86", 3, 0.86),
    ("baseline h1 c0.00", 1, 0.00),
    ("baseline h2 c0.00", 2, 0.00),
    ("baseline h4 c0.00", 4, 0.00),
]
#: Ranked files that the structure probe looks at.
FIRST_FILES = 20


def ablation(instances: DataFrame, files: DataFrame, graph: CodeGraph | None = None, settings: list[tuple[str, int, float]] | None = None) -> DataFrame:
    """``evaluate_instances`` under seven settings and, as mode seeds, without the graph: one graph and one spread for all.

    ``evaluate.summarise(rows, ["mode"])`` gives the means, with ["repo", "mode"] those of each repository.
    """
    return evaluate_instances(instances, files, settings or ABLATION, graph)


def _with_gold(instances: DataFrame) -> tuple[DataFrame, DataFrame]:
    issues, gold = asked(instances)
    gold = materialise(gold.distinct(), "gold")
    return issues.join(gold.select("issue_id").distinct(), "issue_id", "left_semi"), gold


def structure_probe(instances: DataFrame, files: DataFrame, graph: CodeGraph | None = None, at_most: int = FIRST_FILES) -> DataFrame:
    """instance_id, evidence_files, first_novel_rank: the place of the first ranked file that the issue's own evidence does
    not have (null: none among ``at_most``). Before that place the graph cannot differ from its seeds alone."""
    issues, _ = _with_gold(instances)
    graph = graph or build_graph(files)
    own = materialise(evidence(issues, graph).select("issue_id", "path").distinct(), "evidence")
    ranked = as_files(GraphRetriever(graph=graph).rank(issues, files), "position", F.lit("graph"))
    order = ranking.first_appearance(ranked, ["issue_id"], "path", "at").filter(F.col("position") <= at_most)
    novel = evaluate.first_novel(order, own, ["issue_id"], "path", rank="position")
    out = issues.select("issue_id").join(own.groupBy("issue_id").agg(F.count("*").alias("evidence_files")), "issue_id", "left").join(novel, "issue_id", "left")
    return out.select(F.col("issue_id").alias("instance_id"), F.coalesce("evidence_files", F.lit(0)).alias("evidence_files"), F.col("first_rank").alias("first_novel_rank"))


def structure_summary(probed: DataFrame) -> DataFrame:
    """One row: instances, without_novel_file, and ``index_percentiles`` of the ranks that there are (null if there are none)."""
    counts = probed.agg(F.count("*").alias("instances"), F.count_if(F.col("first_novel_rank").isNull()).alias("without_novel_file"))
    return counts.join(evaluate.index_percentiles(probed, [], "first_novel_rank").withColumnRenamed("n", "with_novel_file"), F.lit(True), "left")


def diversity_probe(instances: DataFrame, files: DataFrame, graph: CodeGraph | None = None, k: int = K, budget_tokens: int = BUDGET) -> DataFrame:
    """instance_id, repo, gold, snippets, delivered_files, delivered_recall, ranked_recall: what packing into a budget of k
    snippets leaves of the gold files that the first k ranked files hold."""
    issues, gold = _with_gold(instances)
    retriever = GraphRetriever(k=k, graph=graph)
    given = materialise(retriever.retrieve(issues, files, budget_tokens=budget_tokens).select("issue_id", "path"), "given")
    order = ranking.first_appearance(as_files(retriever.ranking, "position", F.lit("graph")), ["issue_id"], "path", "at").withColumnRenamed("position", "rank")
    at_k = evaluate.recall_at_k(order, gold, ["issue_id"], "path", (k,)).select("issue_id", F.col("recall").alias("ranked_recall"))
    got = evaluate.recall_at_k(given.distinct().withColumn("rank", F.lit(1)), gold, ["issue_id"], "path", (1,)).select("issue_id", F.col("recall").alias("delivered_recall"))
    sizes = given.groupBy("issue_id").agg(F.count("*").alias("snippets"), F.countDistinct("path").alias("delivered_files"))
    wanted = gold.groupBy("issue_id").agg(F.sort_array(F.collect_list("path")).alias("gold"))
    repo = instances.select(F.col("instance_id").alias("issue_id"), "repo")
    out = repo.join(wanted, "issue_id").join(at_k, "issue_id").join(got, "issue_id").join(sizes, "issue_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(F.col("issue_id").alias("instance_id"), "repo", "gold", n("snippets"), n("delivered_files"), "delivered_recall", "ranked_recall")


def diversity_summary(probed: DataFrame) -> DataFrame:
    """One row: instances, both mean recalls, instances where packing lost gold, and files by snippet (none counts as 0)."""
    share = F.coalesce(F.try_divide("delivered_files", "snippets"), F.lit(0.0))
    mean = lambda c, name: rounded(F.avg(c), 4).alias(name)
    return probed.agg(F.count("*").alias("instances"), mean("delivered_recall", "delivered_recall"), mean("ranked_recall", "ranked_recall"), F.count_if(F.col("ranked_recall") > F.col("delivered_recall")).alias("instances_with_gap"), mean(share, "files_by_snippet"))


def worked_example(instances: DataFrame, files: DataFrame, instance_id: str, k: int = 10) -> dict[str, Any]:
    """How one instance's ranking came about: graph, gold, named files, its first ten seeds, and k files each with the
    reason of its first symbol. KeyError if there is no such instance."""
    one = materialise(instances.filter(F.col("instance_id") == instance_id), "instance")
    row = one.first()
    if row is None:
        raise KeyError(instance_id)
    issues, gold = asked(one)
    snapshot = files.filter(F.col("repo_id") == instance_id)
    retriever = GraphRetriever(k=k)
    given = materialise(retriever.retrieve(issues, snapshot), "given").agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    graph, wanted = retriever.graph, {r.path for r in gold.distinct().collect()}
    leads = retriever.ranking.groupBy("path").agg(F.min(F.struct("position", "reasons")).alias("lead")).orderBy("lead.position").limit(k).collect()
    why = lambda r: next(iter(r.lead.reasons or []), "seed")
    ranked = [{"rank": i, "path": r.path, "gold": r.path in wanted, "reason": "named in the text" if why(r) == "seed" else why(r)} for i, r in enumerate(leads, 1)]
    seeds = materialise(extract_seeds(issues, graph), "seeds")
    sizes = {r.name: r.n for r in graph.stats().filter(F.col("name").isin("files", "nodes", "edges")).collect()}
    return {
        "instance_id": instance_id,
        "repo": row.repo,
        "graph": {**{name: sizes.get(name, 0) for name in ("files", "nodes", "edges")}, "seconds": round(graph.seconds, 3)},
        "gold": sorted(wanted),
        "named": [r.path for r in named_files(issues, graph).orderBy("named_at").collect()],
        "seeds_found": seeds.count(),
        "seeds": [r.asDict() for r in seeds.orderBy("place").limit(10).select("weight", "node", "evidence").collect()],
        "files": ranked,
        "k": k,
        "recall": sum(r["gold"] for r in ranked) / len(wanted) if wanted else 0.0,
        "snippets": given.n,
        "tokens": given.tokens,
    }
