"""Command line: resolve, blast, attempt, evaluate, probe, ablation, structure, diversity, example, graph, modes, score."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import api, probes
from .operators import evaluate, render
from .operators.resolve import build_graph
from .operators.retrieve import BUDGET, MODES, EmbeddingRetriever, K
from .sources.repos import checked_predictions, issue_text, read_instances, read_issues, read_repo, read_trees, report_or_none, write_evaluation, write_json_list
from .storage import materialise


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="heddle")
    commands = top.add_subparsers(dest="command", required=True)
    resolve = commands.add_parser("resolve", help="context for an issue")
    resolve.add_argument("repo")
    resolve.add_argument("issue", help="a .json or text file")
    resolve.add_argument("--mode", default="graph", choices=sorted(MODES))
    resolve.add_argument("-k", type=int, default=K)
    resolve.add_argument("--budget", type=int, default=BUDGET)
    resolve.add_argument("--out")
    blast = commands.add_parser("blast", help="ranking for an issue")
    blast.add_argument("repo")
    blast.add_argument("issue")
    blast.add_argument("--hops", type=int, default=3)
    blast.add_argument("--min-confidence", type=float, default=0.0)
    blast.add_argument("--limit", type=int, default=20)
    attempt = commands.add_parser("attempt", help="context and a placeholder for a patch, with the steps taken")
    attempt.add_argument("repo")
    attempt.add_argument("issue")
    attempt.add_argument("--mode", default="graph", choices=sorted(MODES))
    attempt.add_argument("--out", help="where the placeholder goes")
    questions = [
        ("evaluate", "recall of the graph, its seeds and the embedding"),
        ("probe", "whether literals lead to the files of a patch"),
        ("ablation", "recall under seven settings and without the graph"),
        ("structure", "where the graph's files first differ from the issue's own"),
        ("diversity", "what a budget of snippets leaves of the ranked files"),
        ("example", "how the ranking of one instance came about"),
    ]
    for name, what in questions:
        over = commands.add_parser(name, help=what)
        over.add_argument("instances", help="a JSON list of instances")
        over.add_argument("trees", help="a folder with one tree for each instance, named as it")
        over.add_argument("--repos", action="append", default=[])
        over.add_argument("--out")
        if name == "example":
            over.add_argument("--instance", required=True)
    graph = commands.add_parser("graph", help="imports of a repository")
    graph.add_argument("repo")
    graph.add_argument("--format", default="summary", choices=("summary", "mermaid", "dot"))
    graph.add_argument("--exclude", action="append", default=[])
    graph.add_argument("--max-nodes", type=int, default=render.NODES_AT_MOST)
    graph.add_argument("--out")
    commands.add_parser("modes", help="retrievers")
    score = commands.add_parser("score", help="write predictions, or read a harness report")
    score.add_argument("--predictions", help="a JSON list of predictions to check and write to --out")
    score.add_argument("--report", help="a harness report")
    score.add_argument("--out")
    return top


def _give(text: str, out: str | None) -> None:
    if out:
        Path(out).parent.mkdir(parents=True, exist_ok=True)
        Path(out).write_text(text, encoding="utf-8")
    else:
        print(text)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "modes":
        print("\n".join(sorted(MODES)))
        return 0
    spark = spark or SparkSession.builder.appName("heddle").getOrCreate()
    if args.command in ("resolve", "blast"):
        text = read_issues(spark, args.issue).select(issue_text().alias("t")).first().t
        if args.command == "resolve":
            found = api.resolve_issue(spark, args.repo, text, args.mode, args.k, args.budget)
        else:
            found = api.blast_radius(spark, args.repo, text, args.hops, args.min_confidence, args.limit)
        _give(json.dumps(found, indent=1, default=str), getattr(args, "out", None))
    elif args.command == "attempt":
        text = read_issues(spark, args.issue).select(issue_text().alias("t")).first().t
        result = api.resolve(spark, args.repo, text, args.mode)
        print("\n".join(f"{i}. {s.name}: {s.detail}" for i, s in enumerate(result.steps, 1)))
        _give(result.patch, args.out)
    elif args.command in ("evaluate", "probe", "ablation", "structure", "diversity", "example"):
        instances, files = read_instances(spark, args.instances, args.repos or None), materialise(read_trees(spark, args.trees), "files")
        if args.command == "probe":
            found = api.literal_probe(instances, files)
            _give("\n".join(found.toJSON().toLocalIterator()), args.out)
            return 0
        if args.command == "example":
            _give(render.example_text(probes.worked_example(instances, files, args.instance)), args.out)
            return 0
        if args.command in ("structure", "diversity"):
            ask, sum_up = (probes.structure_probe, probes.structure_summary) if args.command == "structure" else (probes.diversity_probe, probes.diversity_summary)
            rows = materialise(ask(instances, files), args.command)
            print(json.dumps(sum_up(rows).first().asDict()))
            if args.out:
                write_json_list(rows, args.out)
            return 0
        if args.command == "ablation":
            rows = materialise(probes.ablation(instances, files), "ablation")
            summary = evaluate.summarise(rows, ["mode"])
            print("\n".join(render.settings_table("Settings", summary, rows.groupBy("repo").agg(F.countDistinct("instance_id").alias("instances")))))
            if args.out:
                write_evaluation(rows, summary, {"instances": args.instances, "trees": args.trees, "repos": args.repos}, args.out)
            return 0
        rows = materialise(api.evaluate_instances(instances, files, embedding=EmbeddingRetriever()), "evaluation")
        summary = evaluate.summarise(rows, ["mode"])
        print(render.report(summary, repos=rows.groupBy("repo").agg(F.countDistinct("instance_id").alias("instances")), by_repo=evaluate.summarise(rows, ["repo", "mode"])))
        if args.out:
            write_evaluation(rows, summary, {"instances": args.instances, "trees": args.trees, "repos": args.repos}, args.out)
    elif args.command == "graph":
        graph = build_graph(read_repo(spark, args.repo))
        try:
            if args.format == "mermaid":
                text = render.to_mermaid(graph, tuple(args.exclude), args.max_nodes)
            elif args.format == "dot":
                text = render.to_dot(graph)
            else:
                text = "\n".join(f"{r.fan_in}\t{r.fan_out}\t{r.path}" for r in render.module_summary(graph).limit(25).collect())
        except ValueError as e:
            print(e, file=sys.stderr)
            return 2
        _give(text, args.out)
    else:
        if args.predictions:
            rows = spark.read.schema("instance_id string, model_patch string, model_name_or_path string").json(args.predictions, multiLine=True)
            print(write_json_list(checked_predictions(rows), args.out or "predictions.json"))
        if args.report:
            row = report_or_none(spark, args.report)
            if row is None:
                print(f"{args.report} is no report", file=sys.stderr)
                return 2
            print(json.dumps(row.asDict()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
