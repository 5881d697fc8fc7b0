"""Entry points in plain Python: context for an issue, a ranking, and an evaluation over many instances."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import gold_files, literal_candidates
from .operators import evaluate, literals, propagate, ranking
from .operators.resolve import MODULE_SYMBOL, CodeGraph, build_graph
from .operators.retrieve import BUDGET, K, EmbeddingRetriever, GraphRetriever, build_retriever, contexts, place_of
from .operators.seeds import extract_seeds, named_files
from .sources.repos import read_repo
from .storage import materialise


@dataclass(frozen=True)
class Step:
    name: str
    detail: str


@dataclass(frozen=True)
class Result:
    """What a resolution attempt gives. stub: no model is called, so the patch is a placeholder."""

    patch: str
    iterations: int
    stub: bool = True
    steps: tuple[Step, ...] = field(default_factory=tuple)


STUB_PATCH = "# no model is configured: this is a placeholder, not a patch\n"


def one_issue(spark: SparkSession, text: str, issue_id: str = "issue", repo_id: str = "repo") -> DataFrame:
    return spark.createDataFrame([(issue_id, repo_id, text)], "issue_id string, repo_id string, text string")


def resolve_issue(spark: SparkSession, repo: str, issue: str, mode: str = "graph", k: int = K, budget_tokens: int = BUDGET) -> dict[str, Any]:
    """Ranked snippets of a repository for an issue, within a budget of tokens. Calls no model and makes no patch."""
    if not issue.strip():
        raise ValueError("the issue has no text")
    retriever = build_retriever(mode, k=k)
    files = materialise(read_repo(spark, repo), "files")
    found = contexts(retriever.retrieve(one_issue(spark, issue), files, budget_tokens=budget_tokens)).first()
    table = getattr(retriever, "statistics", None)
    stats = {} if table is None else table.drop("issue_id", "repo_id").first().asDict() | {"build_seconds": round(retriever.graph.seconds, 3)}
    if found is None:
        return {"mode": mode, "files": [], "token_estimate": 0, "snippets": [], "stats": stats}
    return {"mode": mode, "files": list(found.files), "token_estimate": found.token_estimate, "snippets": [s.asDict() for s in found.snippets], "stats": stats}


def resolve(spark: SparkSession, repo: str, issue: str, mode: str = "graph", k: int = K, budget_tokens: int = BUDGET) -> Result:
    """The loop around a model, without the model: context is gathered and a marked placeholder returned."""
    context = resolve_issue(spark, repo, issue, mode, k, budget_tokens)
    steps = (Step("retrieve", f"{len(context['snippets'])} snippets from {len(context['files'])} files"), Step("patch", "placeholder"))
    return Result(STUB_PATCH, 1, True, steps)


def blast_radius(spark: SparkSession, repo: str, issue: str, hops: int = 3, min_confidence: float = 0.0, limit: int = 20) -> dict[str, Any]:
    """Seeds, ranked nodes with reasons, and counts; no snippets."""
    graph = build_graph(read_repo(spark, repo))
    seeds = materialise(extract_seeds(one_issue(spark, issue), graph), "seeds")
    reached = propagate.spread(graph.edges, graph.nodes.select("node", (F.col("qualname") == MODULE_SYMBOL).alias("is_module")), seeds.select("issue_id", "node", "weight"), propagate.configs(spark, [("query", hops, min_confidence, False)]), label=place_of)
    where = graph.nodes.select("node", "path", "qualname")
    top = propagate.ranked(reached).filter(F.col("rank") <= limit).join(where, "node").orderBy("rank").select("node", "path", "qualname", "score", "distance", "reasons")
    stats = propagate.spread_stats(reached, seeds).first()
    return {
        "seeds": [r.asDict() for r in seeds.join(where.select("node", "path"), "node").orderBy("place").select("node", "path", "weight", "evidence").collect()],
        "ranked": [r.asDict() for r in top.collect()],
        "stats": stats.asDict() if stats else {"seeds_given": 0, "seeds_found": 0},
    }


def asked(instances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Issues (issue_id, repo_id, text) and gold files (issue_id, path) of instances; a snapshot is named as its instance."""
    issue = F.col("instance_id").alias("issue_id")
    return instances.select(issue, F.col("instance_id").alias("repo_id"), F.col("problem_statement").alias("text")), instances.select(issue, F.explode(gold_files(F.col("patch"))).alias("path"))


def as_files(ranked: DataFrame, place: str, mode: Column, kind: int = 0) -> DataFrame:
    """issue_id, mode, path, at of rows with a path: of two kinds of rows the lower comes first."""
    return ranked.select("issue_id", mode.alias("mode"), "path", F.struct(F.lit(kind).alias("kind"), F.col(place).cast("int").alias("at")).alias("at"))


def evidence(issues: DataFrame, graph: CodeGraph) -> DataFrame:
    """``as_files`` rows of mode seeds: the files that an issue names, then those of its seeds, without the graph's steps."""
    seeds = extract_seeds(issues, graph).join(graph.nodes.select("repo_id", "node", "path"), ["repo_id", "node"])
    return as_files(seeds, "place", F.lit("seeds"), 1).unionByName(as_files(named_files(issues, graph), "named_at", F.lit("seeds")))


def evaluate_instances(instances: DataFrame, files: DataFrame, settings: list[tuple[str, int, float]] | None = None, graph: CodeGraph | None = None, embedding: EmbeddingRetriever | None = None) -> DataFrame:
    """instance_id, repo, mode, k, recall, any_hit: file recall of the graph's ranking under each setting (mode, hops,
    least confidence), of its seeds alone (mode seeds) and, if a retriever is given, of its chunks (mode embedding).

    ``instances``: instance_id, repo, problem_statement, patch. ``files``: repo_id (an instance's snapshot, named as its
    instance_id), path, source. All instances and settings are one set of jobs; each has gold from its patch.
    """
    issues, gold = asked(instances)
    graph = graph or build_graph(files)
    settings = settings or [("graph", 3, 0.0)]
    spread = GraphRetriever(graph=graph).rank_settings(issues, files, settings)
    rows = as_files(spread, "position", F.col("config")).unionByName(evidence(issues, graph))
    modes = [*(s[0] for s in settings), "seeds"]
    if embedding is not None:
        near = as_files(embedding.rank(issues, files), "position", F.lit("embedding"))
        rows, modes = rows.unionByName(near), [*modes, "embedding"]
    order = ranking.first_appearance(rows, ["issue_id", "mode"], "path", "at").withColumnRenamed("position", "rank")
    wanted = gold.withColumn("mode", F.explode(F.array(*map(F.lit, modes))))
    scored = evaluate.recall_at_k(order, wanted, ["issue_id", "mode"], "path")
    return scored.join(instances.select(F.col("instance_id").alias("issue_id"), "repo"), "issue_id").withColumnRenamed("issue_id", "instance_id")


def literal_probe(instances: DataFrame, files: DataFrame, at_most: int = literals.USEFUL_FILES) -> DataFrame:
    """instance_id, gold, candidates, useful_candidates, gold_reached, all sorted lists: whether the literals of an issue
    that stand in some of its snapshot's files, but in no more than ``at_most``, lead to the files of its patch."""
    issues, gold = asked(instances)
    said = issues.select("issue_id", F.explode(literal_candidates(F.col("text"))).alias("literal"))
    python = files.filter(F.endswith("path", F.lit(".py")))
    place = F.concat_ws("\n", "repo_id", "path")
    hits = literals.contains(python.select(place.alias("file"), F.col("source").alias("text")), said.select(F.col("literal").alias("literal_id"), "literal").distinct())
    at = F.split("file", "\n", 2)
    found = hits.select(at[0].alias("issue_id"), at[1].alias("path"), F.col("literal_id").alias("literal")).join(said, ["issue_id", "literal"])
    useful = found.groupBy("issue_id", "literal").agg(F.count("*").alias("n")).filter(F.col("n") <= at_most).drop("n")
    reached = found.join(useful, ["issue_id", "literal"]).join(gold, ["issue_id", "path"])

    def listed(rows: DataFrame, item: str, name: str) -> DataFrame:
        return rows.groupBy("issue_id").agg(F.sort_array(F.collect_set(item)).alias(name))

    out = issues.select("issue_id")
    parts = [(gold, "path", "gold"), (said, "literal", "candidates"), (useful, "literal", "useful_candidates"), (reached, "path", "gold_reached")]
    for rows, item, name in parts:
        out = out.join(listed(rows, item, name), "issue_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out.withColumnRenamed("issue_id", "instance_id")


def build_server():
    """A tool server over these functions, where the protocol's library is installed."""
    from mcp.server.fastmcp import FastMCP

    spark = SparkSession.builder.getOrCreate()
    server = FastMCP("heddle")

    @server.tool()
    def context_for_issue(repo: str, issue: str, mode: str = "graph", k: int = K, budget_tokens: int = BUDGET) -> dict:
        """Ranked files and snippets for an issue, within a budget of tokens; no model is called."""
        return resolve_issue(spark, repo, issue, mode, k, budget_tokens)

    @server.tool()
    def ranking_for_issue(repo: str, issue: str, hops: int = 3, min_confidence: float = 0.0, limit: int = 20) -> dict:
        """The symbols that an issue's seeds reach in the dependency graph, and why."""
        return blast_radius(spark, repo, issue, hops, min_confidence, limit)

    return server
