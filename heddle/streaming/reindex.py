"""Keeping a code graph up with a stream of changed files: what a change can reach is resolved again, the rest is kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import last_part
from ..operators import resolve
from ..sources.snapshots import Snapshot, Snapshots, bucket_of
from ..storage import materialise

CHANGES = "repo_id string, path string, source string, version long"
FILE = ["repo_id", "path"]


def newest(changes: DataFrame) -> DataFrame:
    """Each file's newest version; a null source means that the file went."""
    order = F.row_number().over(Window.partitionBy("repo_id", "path").orderBy(F.desc("version"), F.col("source").isNull(), "source"))
    return changes.withColumn("n", order).filter("n = 1").drop("n")


def _differing(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows that are in one of two tables without repeats."""
    both = new.withColumn("_side", F.lit(1)).unionByName(old.withColumn("_side", F.lit(-1)))
    return both.groupBy(*new.columns).agg(F.sum("_side").alias("_side")).filter("_side <> 0").drop("_side")


def _keys(rows: DataFrame, kind: str, *columns) -> DataFrame:
    return rows.select("repo_id", F.lit(kind).alias("kind"), F.concat_ws("|", *columns).alias("key"))


def changed_names(parsed_old: DataFrame, parsed_new: DataFrame, names: resolve.Names, modules_old: DataFrame, exports_old: DataFrame) -> DataFrame:
    """repo_id, kind, key of names that may mean something else now.

    ``parsed_old`` and ``parsed_new`` are the changed files before and after. Kinds: modules whose claims differ, exports
    whose node differs, and last names of all definitions in changed files and of those modules and exports.
    """
    claims = _differing(names.modules.select("repo_id", "module", "path"), modules_old.select("repo_id", "module", "path"))
    exports = _differing(names.exports.select("repo_id", "module", "name", "node"), exports_old.select("repo_id", "module", "name", "node"))
    short = [p.select("repo_id", F.explode("symbols").alias("s")).select("repo_id", last_part(F.col("s.qualname")).alias("name")) for p in (parsed_old, parsed_new)]
    parts = [_keys(claims, "module", "module"), _keys(exports, "export", "module", "name"), _keys(claims.select("repo_id", last_part(F.col("module")).alias("name")), "short", "name"), _keys(exports, "short", last_part(F.col("name")))]
    return reduce(DataFrame.unionByName, [*parts, *(_keys(s, "short", "name") for s in short)]).distinct()


def mentions(parsed: DataFrame, imports: DataFrame) -> DataFrame:
    """repo_id, path, kind, key: the names that a file's references depend on, one row each: its dependencies, reversed
    by a join on the key."""
    keyed = lambda rows, kind, *columns: rows.select(*FILE, F.lit(kind).alias("kind"), F.concat_ws("|", *columns).alias("key"))
    sub = F.concat_ws(".", F.when(F.col("target") != "", F.col("target")), "name")
    targets = imports.select(*FILE, F.explode(F.array("target", sub, F.element_at(F.split("target", r"\.", -1), 1))).alias("m"))
    named = imports.filter("name IS NOT NULL")
    calls = parsed.select(*FILE, F.explode(F.concat(F.transform("calls", lambda c: c["callee"]), F.transform("bases", lambda b: b["base"]))).alias("name"))
    return keyed(targets, "module", "m").unionByName(keyed(named, "export", "target", "name")).unionByName(keyed(calls.select(*FILE, last_part(F.col("name")).alias("n")), "short", "n")).distinct()


def below(classes: DataFrame, bases: DataFrame) -> DataFrame:
    """repo_id, node: classes and all that inherit from them, over bases (repo_id, src, dst)."""
    known = front = materialise(classes.select("repo_id", "node").distinct(), "below")
    while not front.isEmpty():
        step = bases.join(front.select("repo_id", F.col("node").alias("dst")), ["repo_id", "dst"]).select("repo_id", F.col("src").alias("node")).distinct()
        front = materialise(step.join(known, ["repo_id", "node"], "left_anti"), "below")
        known = known.unionByName(front)
    return known


class Reindexer:
    """Applies batches of changes to versioned tables: files, deleted, parsed, modules, exports, nodes, edges, bases and outcomes.

    A batch parses the files that it changes, works out again what names stand for in the repositories that it touches,
    and resolves the references of files that are changed or mention a name that may mean something else. All tables
    appear together (see ``Snapshots``). A batch that is sent again changes nothing; versions of a file that come late are
    passed over, also after a deletion.
    """

    TABLES = ("files", "deleted", "parsed", "modules", "exports", "nodes", "edges", "bases", "outcomes")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.snapshots = spark, Snapshots(spark, path)

    def apply(self, batch: DataFrame, number: int) -> dict:
        """Counts of the version that results: files changed, parsed and resolved."""
        base = self.snapshots.open()
        if number in base.facts.get("batches", []):
            return base.facts
        given = materialise(newest(batch.select("repo_id", "path", "source", "version")), "batch")
        touched = [r.b for r in given.select(bucket_of(F.col("repo_id")).alias("b")).distinct().collect()]
        repos = given.select("repo_id").distinct()
        old = lambda name, schema=None: base.table(name, touched, schema)
        files_old = old("files", CHANGES).unionByName(old("deleted", CHANGES))
        files = materialise(newest(files_old.unionByName(given)), "files")
        before = files_old.filter("source IS NOT NULL").select(*FILE, F.col("source").alias("was"))
        changed = materialise(files.join(repos, "repo_id").join(before, FILE, "left").filter(~F.col("source").eqNullSafe(F.col("was"))).select(*FILE, "source"), "changed")
        fresh = materialise(resolve.parse(changed.filter("source IS NOT NULL")), "parsed")
        parsed_old = old("parsed", fresh.schema.toDDL())
        parsed = materialise(parsed_old.join(changed, FILE, "left_anti").unionByName(fresh), "parsed")
        mine = parsed.join(repos, "repo_id", "left_semi")
        names = resolve.known_names(mine)
        modules_old, exports_old = (old(n, t.schema.toDDL()).join(repos, "repo_id", "left_semi") for n, t in (("modules", names.modules), ("exports", names.exports)))

        may = changed_names(parsed_old.join(changed, FILE, "left_semi"), fresh, names, modules_old, exports_old)
        reached = mentions(mine, names.imports).join(may, ["repo_id", "kind", "key"], "left_semi").select(*FILE)
        moved = _differing(names.modules, modules_old).select(*FILE).join(mine.select(*FILE), FILE, "left_semi")
        again = materialise(fresh.select(*FILE).unionByName(reached).unionByName(moved).distinct(), "again")
        shapes = {"edges": "repo_id string, path string, src string, dst string, relation string, confidence double, via string, line int", "bases": "repo_id string, path string, src string, dst string, ord int", "outcomes": "repo_id string, path string, outcome string"}
        gone = changed.select(*FILE)

        def kept(name: str, files: DataFrame) -> DataFrame:
            return old(name, shapes[name]).join(files, FILE, "left_anti")

        out = again.unionByName(gone).distinct()
        edges, bases, outcomes = resolve.resolve_references(mine.join(again, FILE, "left_semi"), names, more_bases=kept("bases", out))
        bases = materialise(bases, "bases")
        bases_new = kept("bases", out).unionByName(bases)
        # a class whose bases changed may give other methods to what inherits from it
        turned = _differing(bases_new.distinct(), old("bases", shapes["bases"]).distinct()).join(repos, "repo_id", "left_semi")
        heirs = below(turned.select("repo_id", F.col("src").alias("node")), bases_new.unionByName(old("bases", shapes["bases"])))
        later = heirs.join(names.nodes.select("repo_id", "node", "path"), ["repo_id", "node"]).select(*FILE).distinct().join(out, FILE, "left_anti")
        later = materialise(later, "later")
        if not later.isEmpty():
            more = resolve.resolve_references(mine.join(later, FILE, "left_semi"), names, more_bases=bases_new.join(later, FILE, "left_anti"))
            out, edges, outcomes = out.unionByName(later), edges.unionByName(more[0]), outcomes.unionByName(more[2])
            bases_new = bases_new.join(later, FILE, "left_anti").unionByName(more[1])
        carried = lambda name, t: old(name, t.schema.toDDL()).join(repos, "repo_id", "left_anti").unionByName(t)
        tables = {
            "files": files.filter("source IS NOT NULL"),
            "deleted": files.filter("source IS NULL"),
            "parsed": parsed,
            "modules": carried("modules", names.modules),
            "exports": carried("exports", names.exports),
            "nodes": carried("nodes", names.nodes),
            "edges": kept("edges", out).unionByName(edges),
            "bases": bases_new,
            "outcomes": kept("outcomes", out).unionByName(outcomes),
        }
        facts = {"batches": [*base.facts.get("batches", []), number][-1000:], "changed": changed.count(), "parsed": fresh.count(), "resolved": again.count() + later.count()}
        written = {name: self.snapshots.write(name, tables[name], "repo_id") for name in self.TABLES}
        self.snapshots.commit(base, written, touched, facts)
        return facts

    def open(self, version: int | None = None) -> Snapshot:
        return self.snapshots.open(version)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self.open(version).table(name)

    def graph(self, version: int | None = None) -> resolve.CodeGraph:
        """The graph of one version, as ``build_graph`` gives it for the same files."""
        at = self.open(version)
        told = at.table("parsed").join(at.table("modules"), FILE).select("repo_id", "path", "module", "n_lines", "errors")
        return resolve.CodeGraph(at.table("nodes"), at.table("edges").drop("path"), told, at.table("outcomes"))

    def start(self, changes: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        writer = changes.writeStream.foreachBatch(lambda batch, number: self.apply(batch, number) and None).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
