"""Retrievers: issues and files to token-budgeted context, by graph or by embedding, for all issues in one job."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from . import embed, propagate, ranking, vectors
from .order import placed
from .resolve import MODULE_SYMBOL, CodeGraph, build_graph
from .seeds import extract_seeds, named_files

BUDGET, K, SNIPPET_LINES = 8000, 12, 80
#: Chunks listed for an issue at first, by snippet wanted, and how many times as many where they were too few.
FIRST_LISTS, LONGER = 4, 8
SNIPPET = "issue_id, position, path, start_line, end_line, text, score, symbol, reason, tokens"


def place_of(node: Column) -> Column:
    """A node as reasons name it: ``path:qualname``, without its repository."""
    return F.regexp_replace(F.regexp_replace(node, r"^[^|]*\|", ""), "::", ":")


def keyed(graph: CodeGraph) -> tuple[DataFrame, DataFrame]:
    """Edges and nodes of all repositories, as ``propagate`` and ``GraphStore.put`` take them: names start with ``repo_id|``."""
    key = lambda c: F.concat_ws("|", "repo_id", c).alias(c)
    return graph.edges.select(key("src"), key("dst"), "relation", "confidence"), graph.nodes.select(key("node"), (F.col("qualname") == MODULE_SYMBOL).alias("is_module"))


class Retriever(Protocol):
    def retrieve(self, issues: DataFrame, files: DataFrame, *, budget_tokens: int = BUDGET) -> DataFrame:
        """Snippets for every issue (issue_id, repo_id, text) from its repository's files (repo_id, path, source)."""


@dataclass
class GraphRetriever:
    """Seeds from the text, spread over the code graph; files that the text names come first, then files take turns."""

    k: int = K
    max_hops: int = 3
    min_confidence: float = 0.0
    max_snippet_lines: int = SNIPPET_LINES
    graph: CodeGraph | None = None
    #: After ``retrieve``, one row for each issue: see ``context_statistics``.
    statistics: DataFrame | None = None
    #: After ``retrieve``, ``rank``'s rows as they were kept.
    ranking: DataFrame | None = None
    #: The graph as it is walked, keyed by ``keyed``; made when first needed, or opened from a ``GraphStore``.
    adjacency: propagate.Adjacency | None = None

    def rank(self, issues: DataFrame, files: DataFrame) -> DataFrame:
        """issue_id, repo_id, node, path, score, distance, reasons and position, the order before files take turns."""
        return self.rank_settings(issues, files, [("graph", self.max_hops, self.min_confidence)]).drop("config")

    def rank_settings(self, issues: DataFrame, files: DataFrame, settings: list[tuple[str, int, float]]) -> DataFrame:
        """``rank`` under each setting (config, hops, least confidence), with a column config: one spread for them all."""
        graph = self.graph or build_graph(files)
        self.graph = graph
        seeds = materialise(extract_seeds(issues, graph), "seeds")
        key = lambda c: F.concat_ws("|", "repo_id", c)
        self.adjacency = self.adjacency or propagate.prepared(*keyed(graph))
        given = seeds.select(key("issue_id").alias("issue_id"), key("node").alias("node"), "weight")
        grid = propagate.configs(issues.sparkSession, [(*s, False) for s in settings])
        reached = propagate.ranked(propagate.spread_over(self.adjacency, given, grid, label=place_of))
        bare = lambda c: F.regexp_replace(c, r"^[^|]*\|", "")
        ranked = reached.select("config", bare("issue_id").alias("issue_id"), F.regexp_extract("issue_id", r"^([^|]*)\|", 1).alias("repo_id"), bare("node").alias("node"), "score", "distance", "reasons", "rank")
        ranked = ranked.join(graph.nodes.select("repo_id", "node", "path"), ["repo_id", "node"])
        named = named_files(issues, graph).withColumn("config", F.explode(F.array(*(F.lit(s[0]) for s in settings))))
        # a named file that the spread did not reach is there by its module
        absent = named.join(ranked.select("config", "issue_id", "repo_id", "path").distinct(), ["config", "issue_id", "repo_id", "path"], "left_anti")
        modules = absent.select("config", "repo_id", F.concat("path", F.lit("::" + MODULE_SYMBOL)).alias("node"), "issue_id", F.lit(0.0).alias("score"), F.lit(-1).alias("distance"), F.array().cast("array<string>").alias("reasons"), (F.lit(1 << 30) + F.col("named_at")).alias("rank"), "path")
        return ranking.evidence_first(ranked.unionByName(modules), named, ["config", "issue_id", "repo_id"])

    def retrieve(self, issues: DataFrame, files: DataFrame, *, budget_tokens: int = BUDGET) -> DataFrame:
        self.ranking = materialise(self.rank(issues, files), "ranked")
        ranked = self.ranking.withColumnRenamed("position", "graph_rank")
        order = ranking.file_diversity(ranked, ["issue_id", "repo_id"], rank="graph_rank")
        spans = order.join(self.graph.nodes.select("repo_id", "node", "qualname", "start_line", "end_line"), ["repo_id", "node"])
        lines = files.filter("source IS NOT NULL").select("repo_id", "path", F.split(F.regexp_replace("source", r"\n$", ""), "\n", -1).alias("lines"))
        cut = spans.join(lines, ["repo_id", "path"]).withColumn("last", F.least("end_line", F.size("lines"), F.col("start_line") + self.max_snippet_lines - 1)).filter("last >= start_line")
        text = F.array_join(F.slice("lines", F.col("start_line"), F.col("last") - F.col("start_line") + 1), "\n")
        shortened = F.least("end_line", F.size("lines")) > F.col("last")
        items = materialise(cut.select("issue_id", "repo_id", "position", "path", "qualname", "graph_rank", "start_line", F.col("last").alias("end_line"), text.alias("text"), shortened.alias("shortened")).withColumn("tokens", ranking.token_cost(F.col("text"))), "snippets")
        taken = ranking.budget_pack(items, ["issue_id", "repo_id"], "position", "tokens", self.k, budget_tokens)
        self.statistics = self.context_statistics(issues, ranked, items, taken, budget_tokens)
        out = taken.drop("tokens").join(items, ["issue_id", "repo_id", "position"])
        symbol = F.when(F.col("qualname") != MODULE_SYMBOL, F.col("qualname"))
        return out.select("issue_id", F.col("picked_at").alias("position"), "path", "start_line", "end_line", "text", F.round(1 - (F.col("picked_at") - 1) / F.lit(self.k), 6).alias("score"), symbol.alias("symbol"), F.concat(F.lit("graph rank "), F.col("graph_rank").cast("string")).alias("reason"), "tokens")


    def context_statistics(self, issues: DataFrame, ranked: DataFrame, items: DataFrame, taken: DataFrame, budget_tokens: int) -> DataFrame:
        """issue_id, repo_id, seeds, seed_files, reached, graph_nodes, graph_files, hops, min_confidence, k, tokens, snippets
        and truncated_snippets: snippets cut to ``max_snippet_lines`` among those that packing looked at before it was done."""
        key = ["issue_id", "repo_id"]
        packed = taken.groupBy(*key).agg(F.count("*").alias("snippets"), F.max("used").alias("tokens"), F.max("position").alias("last"))
        full = (F.col("snippets") >= self.k) | (F.col("tokens") >= budget_tokens)
        looked = items.filter("shortened").select(*key, "position").join(packed, key).filter(~full | (F.col("position") <= F.col("last")))
        parts = [
            extract_seeds(issues, self.graph).groupBy(*key).agg(F.countDistinct("node").alias("seeds")),
            named_files(issues, self.graph).groupBy(*key).agg(F.countDistinct("path").alias("seed_files")),
            ranked.filter("distance >= 0").groupBy(*key).agg(F.count("*").alias("reached")),
            packed.drop("last"),
            looked.groupBy(*key).agg(F.count("*").alias("truncated_snippets")),
        ]
        out = issues.select(*key).distinct()
        for part in parts:
            out = out.join(part, key, "left")
        sizes = [(self.graph.nodes, "graph_nodes"), (self.graph.files, "graph_files")]
        for table, name in sizes:
            out = out.join(table.groupBy("repo_id").agg(F.count("*").alias(name)), "repo_id", "left")
        counts = [c for c in out.columns if c not in key]
        return out.select(*key, *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), F.lit(self.max_hops).alias("hops"), F.lit(self.min_confidence).alias("min_confidence"), F.lit(self.k).alias("k"))


@dataclass
class EmbeddingRetriever:
    """Windows of lines by the cosine of their vectors with the issue's: the control without a graph."""

    k: int = K
    chunk_lines: int = 40
    encoder: embed.Encoder = embed.hashed_words
    index: DataFrame | None = None

    def build_index(self, files: DataFrame) -> DataFrame:
        """repo_id, path, start_line, end_line, text, embedding, tokens and chunk_id, in the order of the first three."""
        keyed = files.filter("source IS NOT NULL AND path LIKE '%.py'").select(F.struct("repo_id", "path").alias("at"), "source")
        chunks = ranking.chunk_lines(keyed, self.chunk_lines, key="at", text="source")
        coded = self.encoder(chunks.select("at.repo_id", "at.path", "start_line", "end_line", "text"), "text")
        place = ["repo_id", "path", "start_line"]
        dealt = coded.withColumn("tokens", ranking.token_cost(F.col("text"))).repartitionByRange(*place).sortWithinPartitions(*place)
        return materialise(dealt.withColumn("chunk_id", F.monotonically_increasing_id()), "chunks")

    def _asked(self, issues: DataFrame, files: DataFrame) -> DataFrame:
        self.index = self.index if self.index is not None else self.build_index(files)
        return self.encoder(issues.select("issue_id", "repo_id", "text"), "text").drop("text")

    def rank(self, issues: DataFrame, files: DataFrame) -> DataFrame:
        """issue_id, repo_id, path, start_line, end_line, tokens, score and position of every chunk; texts stay in the index."""
        asked = self._asked(issues, files).withColumnRenamed("embedding", "wanted")
        near = self.index.drop("text", "chunk_id").join(asked, "repo_id").withColumn("score", propagate.rounded(F.aggregate(F.zip_with("embedding", "wanted", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)))
        return placed(near.drop("embedding", "wanted"), ["issue_id", "repo_id"], [F.desc("score"), "path", "start_line"])

    def nearest(self, asked: DataFrame, at_most: int) -> DataFrame:
        """``rank`` with chunk_id, of the first ``at_most`` chunks of each issue; no list of all chunks is made or sorted.

        ``asked``: query_id (negative), issue_id, repo_id, embedding. The index has been built.
        """
        chunks = self.index.select("repo_id", F.col("chunk_id").alias("vec_id"), "embedding")
        queries = asked.select("repo_id", F.col("query_id").alias("vec_id"), "embedding")
        found = vectors.top_by_group(chunks, queries, "repo_id", at_most)
        named = found.select("query_id", F.col("rank").alias("position"), F.col("vec_id").alias("chunk_id"), F.col("cosine").alias("score"))
        return named.join(asked.drop("embedding", "repo_id"), "query_id").join(self.index.drop("embedding", "text"), "chunk_id")

    def retrieve(self, issues: DataFrame, files: DataFrame, *, budget_tokens: int = BUDGET) -> DataFrame:
        """Snippets of every issue; an issue whose list ends before its budget and k are used up is given a longer one."""
        asked = materialise(self._asked(issues, files).withColumn("query_id", -1 - F.monotonically_increasing_id()), "asked")
        at_most, packed = FIRST_LISTS * self.k, []
        while True:
            items = materialise(self.nearest(asked, at_most), "chunk-ranks")
            taken = materialise(ranking.budget_pack(items, ["query_id"], "position", "tokens", self.k, budget_tokens), "packed")
            ended = taken.groupBy("query_id").agg(F.count("*").alias("n"), F.max("used").alias("used")).filter((F.col("n") >= self.k) | (F.col("used") >= budget_tokens)).select("query_id")
            whole = items.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") < at_most).select("query_id")
            done = ended.union(whole).distinct()
            packed.append(taken.drop("tokens").join(items, ["query_id", "position"]).join(done, "query_id"))
            # an issue whose repository has no chunk is in no list
            asked = materialise(asked.join(done, "query_id", "left_anti").join(items.select("query_id").distinct(), "query_id", "left_semi"), "asked")
            if asked.isEmpty():
                break
            at_most *= LONGER
        out = reduce(DataFrame.unionByName, packed).join(self.index.select("chunk_id", "text"), "chunk_id")
        why = F.format_string("embedding rank %d, cosine=%.3f", F.col("position"), F.col("score"))
        return out.select("issue_id", F.col("picked_at").alias("position"), "path", "start_line", "end_line", "text", "score", F.lit(None).cast("string").alias("symbol"), why.alias("reason"), "tokens")


MODES = {"graph": GraphRetriever, "embedding": EmbeddingRetriever}


def build_retriever(mode: str, **how) -> Retriever:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {', '.join(sorted(MODES))}")
    return MODES[mode](**how)


def contexts(snippets: DataFrame) -> DataFrame:
    """issue_id, snippets in order, token_estimate and the distinct files in the order of their first appearance."""
    row = F.struct(*(c for c in snippets.columns if c != "issue_id"))
    out = snippets.groupBy("issue_id").agg(F.array_sort(F.collect_list(row)).alias("snippets"), F.sum("tokens").alias("token_estimate"))
    return out.withColumn("files", F.array_distinct(F.transform("snippets", lambda s: s["path"])))
