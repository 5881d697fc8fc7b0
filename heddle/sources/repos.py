"""Source trees, issues and benchmark instances as tables; predictions and reports as files."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F

from .files import SKIP_DIRS, SUFFIXES, register

ISSUES = "issue_id string, title string, body string"
PREDICTION_NAMES_TAKEN = ("gold", "none")
REPORT = "total_instances int, submitted_instances int, completed_instances int, resolved_instances int, unresolved_instances int, resolved_ids array<string>, unresolved_ids array<string>, error_ids array<string>, empty_patch_ids array<string>, schema_version int"


def wanted(path: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """Whether a relative path is a source file outside the skipped folders."""
    name = F.element_at(F.split(path, "/", -1), -1)
    fits = F.lit(False)
    for s in suffixes:
        fits = fits | F.endswith(name, F.lit(s))
    return fits & ~F.arrays_overlap(F.split(path, "/", -1), F.array(*map(F.lit, SKIP_DIRS)))


def _tree(spark: SparkSession, root: str | os.PathLike, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("source_tree").options(**options).load(str(Path(root).resolve()))


def read_repo(spark: SparkSession, root: str | os.PathLike, repo_id: str = "repo", suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """FILES of a tree in a folder that all executors see: see ``files.SourceTree``."""
    return _tree(spark, root, repo_id=repo_id, suffixes=",".join(suffixes))


def read_trees(spark: SparkSession, root: str | os.PathLike) -> DataFrame:
    """FILES of many trees, one in each folder of ``root``, whose name is its repo_id."""
    return _tree(spark, root, trees="true")


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    """ISSUES from JSON (id or instance_id, title, body or problem_statement) or from a text whose first line is the title."""
    if str(path).endswith(".json"):
        raw = spark.read.schema("id string, instance_id string, title string, body string, problem_statement string").json(path, multiLine=True)
        stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
        return raw.select(F.coalesce("id", "instance_id", stem).alias("issue_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("body", "problem_statement", F.lit("")).alias("body"))
    raw = spark.read.text(path, wholetext=True)
    title = F.regexp_extract("value", r"^\s*([^\n]*\S)", 1)
    return raw.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("issue_id"), title.alias("title"), F.col("value").alias("body"))


def issue_text() -> Column:
    return F.trim(F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("body", F.lit(""))))


def read_instances(spark: SparkSession, path: str, repos: list[str] | None = None, max_per_repo: int | None = None) -> DataFrame:
    """Benchmark instances with ``ord``; only repositories whose last path segment is named, and so many of each."""
    schema = "instance_id string, repo string, base_commit string, problem_statement string, patch string"
    # a list in one file becomes rows of one partition, so the ids are in the list's order
    rows = spark.read.schema(schema).json(path, multiLine=True).withColumn("ord", F.monotonically_increasing_id())
    if repos:
        rows = rows.filter(F.element_at(F.split("repo", "/", -1), -1).isin(*repos))
    if max_per_repo:
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("repo").orderBy("ord"))).filter(F.col("n") <= max_per_repo).drop("n")
    return rows


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A harness report with its resolved rate (0 if nothing was submitted)."""
    row = spark.read.schema(REPORT).json(path, multiLine=True)
    return row.withColumn("resolved_rate", F.coalesce(F.try_divide("resolved_instances", "submitted_instances"), F.lit(0.0)))


def report_or_none(spark: SparkSession, path: str) -> Row | None:
    """A harness report's row, or none where there is no file or what it holds is no report."""
    try:
        row = read_report(spark, path).first()
    except AnalysisException:
        return None
    return row if row is not None and row.total_instances is not None else None


def checked_predictions(predictions: DataFrame) -> DataFrame:
    """Predictions (instance_id, model_patch, model_name_or_path); a reserved model name is an error."""
    name = F.col("model_name_or_path")
    taken = F.lower(name).isin(*PREDICTION_NAMES_TAKEN)
    return predictions.select("instance_id", "model_patch", F.when(taken, F.raise_error(F.concat(F.lit("reserved model name: "), name))).otherwise(name).alias("model_name_or_path"))


def _write_list(df: DataFrame, path: str | os.PathLike, head: str = "", tail: str = "\n") -> int:
    at = Path(path).resolve()
    at.parent.mkdir(parents=True, exist_ok=True)
    register(df.sparkSession)
    seen = Observation()
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).observe(seen, F.count(F.lit(1)).alias("n"))
    rows.write.format("json_list").mode("overwrite").options(head=head, tail=tail).save(str(at))
    return seen.get["n"]


def write_json_list(df: DataFrame, path: str | os.PathLike) -> int:
    """Write rows as one JSON list, whole or not at all, in folders made as needed; the number of rows."""
    return _write_list(df, path)


def write_evaluation(rows: DataFrame, summary: DataFrame, config: dict, path: str | os.PathLike) -> int:
    """Write {summary, config, rows} as one JSON object, whole or not at all; the number of rows.

    The summary has a row for each mode and level, so it is gathered; rows are not.
    """
    said = ",\n ".join(r.j for r in summary.select(F.to_json(F.struct(*summary.columns), {"ignoreNullFields": "false"}).alias("j")).collect())
    return _write_list(rows, path, f'{{"summary": [\n {said}\n],\n"config": {json.dumps(config)},\n"rows": ', "}\n")
