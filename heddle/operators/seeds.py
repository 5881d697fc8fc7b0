"""Issue texts to weighted seeds in a code graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BLOB_URL, PATH, TRACEBACK, identifier_offers, last_part, matches, node_id
from .graphs import suffix_match
from .resolve import MODULE_SYMBOL, CodeGraph

# What a mention is worth.
FRAME_LINE, LINK_LINE, LINK_FILE, NAMED_FILE = 4.0, 3.5, 1.6, 1.2
MATCHES_AT_MOST, SEEDS_AT_MOST = 4, 40


def _mentions(issues: DataFrame) -> DataFrame:
    """issue_id, repo_id, mention, line, weight, evidence, turn: files that a text names, in the order of the sources."""
    text = F.col("text")
    groups = []
    for turn, (pattern, with_line) in enumerate(((TRACEBACK, True), (BLOB_URL, True), (PATH, False))):
        lines = matches(text, pattern, 2) if with_line else F.transform(matches(text, pattern), lambda _: F.lit(""))
        pairs = F.arrays_zip(matches(text, pattern).alias("mention"), lines.alias("line"))
        groups.append(issues.select("issue_id", "repo_id", F.lit(turn).alias("turn"), F.posexplode(pairs).alias("at", "p")))
    rows = groups[0].unionByName(groups[1]).unionByName(groups[2])
    line = F.try_to_number(F.nullif(F.col("p.line"), F.lit("")), F.lit("999999999")).cast("int")
    return rows.select("issue_id", "repo_id", "turn", "at", F.col("p.mention").alias("mention"), line.alias("line"))


def named_files(issues: DataFrame, graph: CodeGraph) -> DataFrame:
    """issue_id, repo_id, path, named_at: the files that a text names, longer mentions first, each once."""
    said = _mentions(issues).filter("turn <> 1").groupBy("issue_id", "repo_id", "mention").agg(F.min(F.struct("turn", "at")).alias("first"))
    found = suffix_match(said.select("issue_id", "repo_id", "mention"), graph.files.select("repo_id", "path"), ["repo_id", "issue_id"])
    rows = found.join(said, ["issue_id", "repo_id", "mention"]).groupBy("issue_id", "repo_id", "path").agg(F.min(F.struct((-F.length("mention")).alias("n"), "first")).alias("o"))
    return rows.withColumn("named_at", F.row_number().over(Window.partitionBy("issue_id", "repo_id").orderBy("o", "path"))).drop("o")


def extract_seeds(issues: DataFrame, graph: CodeGraph, at_most: int = SEEDS_AT_MOST) -> DataFrame:
    """issue_id, repo_id, node, weight, evidence of each issue's heaviest seeds. ``issues``: issue_id, repo_id, text.

    A line that a traceback or a link names gives the innermost symbol on it; a file gives its module; a name gives the
    symbols of that qualified name, or else of that last name, its weight shared among them, unless there are too many.
    """
    said = _mentions(issues)
    paths = suffix_match(said.select("issue_id", "repo_id", "mention").distinct(), graph.files.select("repo_id", "path"), ["repo_id", "issue_id"])
    placed = said.join(paths, ["issue_id", "repo_id", "mention"]).withColumn("point", F.concat_ws("|", "turn", "at", "mention"))
    symbols = graph.nodes.filter(F.col("qualname") != MODULE_SYMBOL)
    spans = symbols.select("repo_id", "path", F.col("start_line").alias("a"), F.col("end_line").alias("b"), "node", F.col("ord").alias("node_ord"))
    inside = placed.filter("line IS NOT NULL").join(spans, ["repo_id", "path"]).filter((F.col("line") >= F.col("a")) & (F.col("line") <= F.col("b")))
    inner = inside.groupBy("issue_id", "repo_id", "point").agg(F.min_by("node", F.struct(F.col("b") - F.col("a"), "node_ord")).alias("inner"))
    located = placed.join(inner, ["issue_id", "repo_id", "point"], "left")
    module = node_id(F.col("path"), F.lit(MODULE_SYMBOL))
    lined = F.col("line").isNotNull()
    weight = F.when(F.col("turn") == 0, FRAME_LINE).when((F.col("turn") == 1) & lined, LINK_LINE).when(F.col("turn") == 1, LINK_FILE).otherwise(NAMED_FILE)
    kind = F.when(F.col("turn") == 0, "traceback").when(F.col("turn") == 1, "link").otherwise("file named")
    offers = located.select("issue_id", "repo_id", F.when(lined, F.coalesce("inner", module)).otherwise(module).alias("node"), weight.alias("weight"), F.concat_ws(" ", kind, "path", F.col("line").cast("string")).alias("evidence"), F.struct("turn", "at", F.lit("").alias("name")).alias("offered"))

    names = identifier_offers(issues.select(F.struct("issue_id", "repo_id").alias("who"), "text"), "who").select("who.issue_id", "who.repo_id", "name", "weight")
    known = symbols.select("repo_id", "qualname", "node").distinct()
    full = names.join(known.withColumnRenamed("qualname", "name"), ["repo_id", "name"]).select("issue_id", "repo_id", "name", "weight", "node")
    short = known.select("repo_id", last_part(F.col("qualname")).alias("name"), "node")
    rest = names.join(full.select("issue_id", "repo_id", "name").distinct(), ["issue_id", "repo_id", "name"], "left_anti")
    # the cap comes before the rows: a name of many definitions gives no seed
    count = short.groupBy("repo_id", "name").agg(F.count("*").alias("n")).filter(F.col("n") <= MATCHES_AT_MOST)
    partly = rest.join(short.join(count, ["repo_id", "name"]).drop("n"), ["repo_id", "name"]).select("issue_id", "repo_id", "name", "weight", "node")
    hits = full.unionByName(partly)
    many = F.count("*").over(Window.partitionBy("issue_id", "repo_id", "name"))
    hits = hits.withColumn("n", many).filter(F.col("n") <= MATCHES_AT_MOST)
    offers = offers.unionByName(hits.select("issue_id", "repo_id", "node", (F.col("weight") / F.col("n")).alias("weight"), F.concat(F.lit("name "), "name").alias("evidence"), F.struct(F.lit(3).alias("turn"), F.lit(0).alias("at"), "name").alias("offered")))

    best = F.row_number().over(Window.partitionBy("issue_id", "repo_id", "node").orderBy(F.desc("weight"), "offered"))
    place = F.row_number().over(Window.partitionBy("issue_id", "repo_id").orderBy(F.desc("weight"), "node"))
    kept = offers.withColumn("n", best).filter("n = 1").withColumn("place", place).filter(F.col("place") <= at_most)
    return kept.select("issue_id", "repo_id", "node", "weight", "evidence", "place")
