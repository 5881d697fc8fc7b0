"""From parsed files to a typed, confidence-weighted symbol graph, by joins over all files and repositories at once."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import python_source
from ..functions.text import last_part, node_id, resolve_relative
from ..storage import materialise
from .graphs import AMBIGUITY_AT_MOST, CONFIDENCE, first_owner_up, last_edge_wins, prefixes
from .reexports import follow

MODULE_SYMBOL = "<module>"


@dataclass(frozen=True)
class CodeGraph:
    """nodes: repo_id, node, path, qualname, kind, start_line, end_line, module, decorators. edges: repo_id, src, dst,
    relation, confidence, via, line. files: repo_id, path, module, n_lines, errors. refs: what became of each reference."""

    nodes: DataFrame
    edges: DataFrame
    files: DataFrame
    refs: DataFrame
    #: How long the jobs took that built it.
    seconds: float = 0.0

    def stats(self) -> DataFrame:
        """repo_id, name, n: files, parse errors, nodes, edges, modules, ambiguous modules and what became of references."""
        f = self.files.groupBy("repo_id").agg(F.count("*").alias("files"), F.count_if(F.size("errors") > 0).alias("parse_errors"))
        owned = self.files.groupBy("repo_id", "module").agg(F.count("*").alias("n")).groupBy("repo_id").agg(F.count_if(F.col("n") == 1).alias("modules"), F.count_if(F.col("n") > 1).alias("ambiguous_modules"))
        n = self.nodes.groupBy("repo_id").agg(F.count("*").alias("nodes"))
        e = self.edges.groupBy("repo_id").agg(F.count("*").alias("edges"))
        wide = f.join(owned, "repo_id", "left").join(n, "repo_id", "left").join(e, "repo_id", "left")
        names = [c for c in wide.columns if c != "repo_id"]
        tall = wide.select("repo_id", F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.coalesce(F.col(c), F.lit(0)).alias("n")) for c in names))).alias("s")).select("repo_id", "s.name", "s.n")
        return tall.unionByName(self.refs.groupBy("repo_id", F.col("outcome").alias("name")).agg(F.count("*").alias("n")))

    def first_errors(self, at_most: int = 20) -> DataFrame:
        """repo_id, path, error: the first parse errors of each repository, by path."""
        told = self.files.select("repo_id", "path", F.posexplode("errors").alias("at", "error"))
        order = F.row_number().over(Window.partitionBy("repo_id").orderBy("path", "at"))
        return told.withColumn("n", order).filter(F.col("n") <= at_most).select("repo_id", "path", "error")

    def symbols_in(self, path: str) -> DataFrame:
        return self.nodes.filter(F.col("path") == path)


def module_names(files: DataFrame) -> DataFrame:
    """repo_id, path, module, is_package: the dotted name below the outermost folder of an unbroken chain of packages."""
    parts = F.split("path", "/", -1)
    packages = files.filter(F.element_at(parts, -1) == "__init__.py").select("repo_id", F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("dir")).distinct()
    dirs = files.select("repo_id", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("dir"), n.alias("depth")))).alias("d")).filter(F.size(parts) > 1).select("repo_id", "path", "d.dir", "d.depth")
    held = dirs.join(packages, ["repo_id", "dir"]).groupBy("repo_id", "path").agg(F.collect_set("depth").alias("depths"))
    deep = F.size(parts) - 1
    # how many folders, from the file's own outwards, are packages without a gap
    chain = F.aggregate(F.sequence(F.lit(0), deep), F.lit(0), lambda n, i: F.when((n == i) & F.array_contains(F.coalesce("depths", F.array().cast("array<int>")), deep - i), n + 1).otherwise(n))
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.py$", "")
    is_package = F.element_at(parts, -1) == "__init__.py"
    named = files.select("repo_id", "path").join(held, ["repo_id", "path"], "left")
    folders = F.slice(parts, F.size(parts) - F.col("chain"), F.col("chain"))
    return named.withColumn("chain", chain).select("repo_id", "path", F.array_join(F.when(is_package, folders).otherwise(F.concat(folders, F.array(stem))), ".").alias("module"), is_package.alias("is_package"))


def _exploded(parsed: DataFrame, column: str) -> DataFrame:
    return parsed.select("repo_id", "path", "file_ord", F.posexplode(column).alias("ord", "r")).select("repo_id", "path", "file_ord", "ord", "r.*")


def _export_table(symbols: DataFrame, refs: DataFrame, owned: DataFrame) -> DataFrame:
    """repo_id, module, name, node: what each owned module gives out, re-exports followed to their end.

    An import that resolves comes before a definition of the same name, and a later import before an earlier one.
    """
    key = F.struct("repo_id", "module", "name").alias("key")
    own = symbols.filter("parent IS NULL").join(owned, ["repo_id", "path"]).groupBy("repo_id", "module", F.col("qualname").alias("name")).agg(F.max("node").alias("node"))
    named = refs.filter("name IS NOT NULL").join(owned, ["repo_id", "path"])
    source = F.struct("repo_id", F.col("target").alias("module"), F.col("name").alias("name")).alias("src")
    takes = named.select(F.struct("repo_id", "module", F.coalesce("alias", "name").alias("name")).alias("key"), source, F.struct("file_ord", "ord").alias("at"))
    return follow(own.select(key, "node"), takes).select("key.*", "node")


def _bindings(refs: DataFrame, modules: DataFrame, owner: DataFrame, exports: DataFrame) -> DataFrame:
    """repo_id, path, prefix, kind, target: what each name that a file imports stands for; later statements win."""
    known = modules.select("repo_id", F.col("module").alias("target"), F.lit(True).alias("known")).distinct()
    plain = refs.filter("name IS NULL").join(known, ["repo_id", "target"], "left")
    kind = F.when(F.col("known"), "module").otherwise("external")
    bound = plain.select("repo_id", "path", "ord", F.coalesce("alias", "target").alias("prefix"), kind.alias("kind"), "target", F.lit(True).alias("strong"))
    head = F.element_at(F.split("target", r"\.", -1), 1)
    heads = plain.filter("alias IS NULL").filter(F.contains("target", F.lit("."))).select("repo_id", "path", "ord", head.alias("target")).join(known, ["repo_id", "target"], "left")
    weak = heads.select("repo_id", "path", "ord", F.col("target").alias("prefix"), kind.alias("kind"), "target", F.lit(False).alias("strong"))
    given = exports.select("repo_id", F.col("module").alias("target"), "name", "node")
    sub = owner.select("repo_id", F.col("module").alias("sub"), F.lit(True).alias("is_sub"))
    named = refs.filter("name IS NOT NULL").withColumn("sub", F.concat_ws(".", F.when(F.col("target") != "", F.col("target")), "name"))
    named = named.join(given, ["repo_id", "target", "name"], "left").join(sub, ["repo_id", "sub"], "left").join(known, ["repo_id", "target"], "left")
    what = F.when(F.col("node").isNotNull(), F.struct(F.lit("symbol").alias("kind"), F.col("node").alias("target"))).when(F.col("is_sub") | F.col("known"), F.struct(F.lit("module").alias("kind"), F.col("sub").alias("target"))).otherwise(F.struct(F.lit("external").alias("kind"), F.col("sub").alias("target")))
    froms = named.select("repo_id", "path", "ord", F.coalesce("alias", "name").alias("prefix"), what.alias("w"), F.lit(True).alias("strong")).select("repo_id", "path", "ord", "prefix", "w.kind", "w.target", "strong")
    rows = bound.unionByName(weak).unionByName(froms)
    # a package's head is bound by ``import a.b`` only where nothing else binds it
    best = F.max_by(F.struct("kind", "target"), F.struct("strong", F.when(F.col("strong"), F.col("ord")).otherwise(-F.col("ord"))))
    return rows.groupBy("repo_id", "path", "prefix").agg(best.alias("b")).select("repo_id", "path", "prefix", "b.kind", "b.target")


def resolve_dotted(names: DataFrame, bindings: DataFrame, exports: DataFrame, owner: DataFrame, symbols: DataFrame, shorts: DataFrame) -> DataFrame:
    """names (repo_id, path, name) with node and is_external. The longest bound prefix decides, with no second try."""
    names = names.select("repo_id", "path", "name").distinct()
    parts = F.split("name", r"\.", -1)
    spread = names.select("repo_id", "path", "name", F.explode(prefixes(parts, ".")).alias("p")).select("repo_id", "path", "name", "p.prefix", "p.size")
    hit = spread.join(bindings, ["repo_id", "path", "prefix"]).groupBy("repo_id", "path", "name").agg(F.max_by(F.struct("prefix", "kind", "target"), "size").alias("b"))
    rows = names.join(hit, ["repo_id", "path", "name"], "left")
    rest = F.when(F.length("name") > F.length("b.prefix"), F.expr("substring(name, length(b.prefix) + 2)"))
    rows = rows.select("repo_id", "path", "name", F.col("b.kind").alias("kind"), F.col("b.target").alias("target"), rest.alias("rest"))
    member = symbols.select("repo_id", F.col("node").alias("member_id"), F.col("node").alias("member")).distinct()
    given = exports.select("repo_id", F.col("module").alias("target"), F.col("name").alias("rest"), F.col("node").alias("given"))
    home = owner.select("repo_id", F.col("module").alias("module_name"), node_id(F.col("owner"), F.lit(MODULE_SYMBOL)).alias("module_node"))
    top = symbols.filter("parent IS NULL").groupBy("repo_id", "path", F.col("qualname").alias("name")).agg(F.max("node").alias("here"))
    lone = shorts.filter("candidates = 1").select("repo_id", F.col("short").alias("name"), F.element_at("nodes", 1).alias("lone"))
    rows = rows.withColumn("member_id", F.concat_ws(".", "target", "rest")).join(member, ["repo_id", "member_id"], "left")
    rows = rows.join(given, ["repo_id", "target", "rest"], "left")
    rows = rows.withColumn("module_name", F.concat_ws(".", "target", "rest")).join(home, ["repo_id", "module_name"], "left")
    rows = rows.join(top, ["repo_id", "path", "name"], "left").join(lone, ["repo_id", "name"], "left")
    node = F.when(F.col("kind") == "symbol", F.when(F.col("rest").isNull(), F.col("target")).otherwise(F.coalesce("member", "target"))).when(F.col("kind") == "module", F.coalesce("given", "module_node")).when(F.col("kind").isNull(), F.coalesce("here", "lone"))
    return rows.select("repo_id", "path", "name", node.alias("node"), F.coalesce(F.col("kind") == "external", F.lit(False)).alias("is_external"))


@dataclass(frozen=True)
class Names:
    """What names stand for in whole repositories. modules: repo_id, path, module, is_package. claims: repo_id, module, n,
    owner. symbols: every definition. nodes: as in a graph. shorts: repo_id, short, candidates, nodes. imports: import
    references with their target. exports: repo_id, module, name, node."""

    modules: DataFrame
    claims: DataFrame
    symbols: DataFrame
    nodes: DataFrame
    shorts: DataFrame
    imports: DataFrame
    exports: DataFrame

    @property
    def owner(self) -> DataFrame:
        return self.claims.filter("n = 1").select("repo_id", "module", "owner")


def parse(files: DataFrame, analysers: dict | None = None) -> DataFrame:
    """Analysed files (repo_id, path, source), and the order of files in which later edges win."""
    parsed = files.select("repo_id", "path", "source").mapInPandas(python_source.analyse_files(analysers), python_source.ANALYSIS)
    return parsed.withColumn("file_ord", F.split("path", "/", -1))


def known_names(parsed: DataFrame, max_ambiguity: int = AMBIGUITY_AT_MOST) -> Names:
    modules = materialise(module_names(parsed.select("repo_id", "path")), "modules")
    claims = modules.groupBy("repo_id", "module").agg(F.count("*").alias("n"), F.min("path").alias("owner"))
    owned = claims.filter("n = 1").select("repo_id", "module", F.col("owner").alias("path"))

    symbols = _exploded(parsed, "symbols").withColumn("node", node_id(F.col("path"), F.col("qualname")))
    named = modules.select("repo_id", "path", "module")
    whole = parsed.join(named, ["repo_id", "path"]).select("repo_id", node_id(F.col("path"), F.lit(MODULE_SYMBOL)).alias("node"), "path", F.lit(MODULE_SYMBOL).alias("qualname"), F.lit(python_source.MODULE).alias("kind"), F.lit(1).alias("start_line"), F.col("n_lines").alias("end_line"), "module", F.array().cast("array<string>").alias("decorators"), F.lit(-1).alias("ord"))
    # a name that a file defines twice is one node, with what the last definition says
    last = symbols.groupBy("repo_id", "path", "qualname", "node").agg(F.max_by(F.struct("kind", "start_line", "end_line", "decorators"), "ord").alias("l"), F.min("ord").alias("ord"))
    defined = last.join(named, ["repo_id", "path"]).select("repo_id", "node", "path", "qualname", "l.kind", "l.start_line", "l.end_line", "module", "l.decorators", "ord")
    nodes = materialise(whole.unionByName(defined), "nodes")
    # every definition counts as a candidate of its last name, also one of two in a file; lists stay within the cap
    shorts = symbols.withColumn("short", last_part(F.col("qualname"))).groupBy("repo_id", "short").agg(F.count("*").alias("candidates"))
    listed = symbols.withColumn("short", last_part(F.col("qualname"))).select("repo_id", "short", "node").distinct().join(shorts.filter(F.col("candidates") <= max_ambiguity), ["repo_id", "short"])
    shorts = materialise(listed.groupBy("repo_id", "short", "candidates").agg(F.sort_array(F.collect_list("node")).alias("nodes")).unionByName(shorts.filter(F.col("candidates") > max_ambiguity).withColumn("nodes", F.array().cast("array<string>"))), "shorts")
    imports = materialise(_targets(parsed, modules), "imports")
    return Names(modules, claims, symbols, nodes, shorts, imports, _export_table(symbols, imports, owned))


#: Edges as files give them; ``path`` is the file that an edge's source stands in.
EDGE = ["repo_id", "path", "src", "dst", "relation", "confidence", "via", "line"]


def resolve_references(parsed: DataFrame, names: Names, max_ambiguity: int = AMBIGUITY_AT_MOST, more_bases: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges (EDGE), bases (repo_id, path, src, dst, ord) and outcomes (repo_id, path, outcome) of some files' references.

    ``more_bases``: bases of classes in other files, for walks up a hierarchy that begins here.
    """
    none = F.lit(None)
    plain = lambda relation: [F.lit(relation).alias("relation"), none.cast("double").alias("confidence"), none.cast("string").alias("via")]
    here = parsed.select("repo_id", "path")
    symbols = _exploded(parsed, "symbols").withColumn("node", node_id(F.col("path"), F.col("qualname")))
    contains = symbols.select("repo_id", "path", node_id(F.col("path"), F.coalesce("parent", F.lit(MODULE_SYMBOL))).alias("src"), F.col("node").alias("dst"), *plain("contains"), F.col("start_line").alias("line"), "file_ord", "ord")

    imports = names.imports.join(here, ["repo_id", "path"], "left_semi")
    bindings = materialise(_bindings(imports, names.claims, names.owner, names.exports), "bindings")
    reached = imports.join(names.owner.select("repo_id", F.col("module").alias("target"), "owner"), ["repo_id", "target"], "left")
    import_edges = reached.filter("owner IS NOT NULL").select("repo_id", "path", node_id(F.col("path"), F.lit(MODULE_SYMBOL)).alias("src"), node_id(F.col("owner"), F.lit(MODULE_SYMBOL)).alias("dst"), *plain("imports"), "line", "file_ord", "ord")
    import_refs = reached.select("repo_id", "path", F.when(F.col("owner").isNull(), "import_external").otherwise("import_edges").alias("outcome"))

    bases = _exploded(parsed, "bases").withColumnRenamed("base", "name")
    calls = _exploded(parsed, "calls").withColumnRenamed("callee", "name")
    dotted = materialise(resolve_dotted(bases.select("repo_id", "path", "name").unionByName(calls.select("repo_id", "path", "name")), bindings, names.exports, names.owner, names.symbols, names.shorts), "dotted")

    inherited = bases.join(dotted, ["repo_id", "path", "name"]).withColumn("src", node_id(F.col("path"), F.col("cls")))
    good = F.col("node").isNotNull() & (F.col("node") != F.col("src"))
    inherits = inherited.filter(good).select("repo_id", "path", "src", F.col("node").alias("dst"), *plain("inherits"), "line", "file_ord", "ord")
    inherit_refs = inherited.select("repo_id", "path", F.when(good, "inherit_edges").when(F.col("is_external"), "inherit_external").otherwise("inherit_unresolved").alias("outcome"))

    up = inherits.select("repo_id", "path", "src", "dst", "ord")
    call_edges, call_refs = _calls(calls, dotted, names.nodes, up if more_bases is None else up.unionByName(more_bases), names.shorts, max_ambiguity)
    every = contains.unionByName(import_edges).unionByName(inherits).unionByName(call_edges)
    keyed = every.withColumn("src", F.struct("repo_id", "path", "src"))
    edges = last_edge_wins(keyed, ["file_ord", "ord"], ["confidence", "via", "line"]).select("src.repo_id", "src.path", F.col("src.src").alias("src"), "dst", "relation", "confidence", "via", "line")
    return edges, up, import_refs.unionByName(inherit_refs).unionByName(call_refs)


def build_graph(files: DataFrame, analysers: dict | None = None, max_ambiguity: int = AMBIGUITY_AT_MOST) -> CodeGraph:
    """The graph of files (repo_id, path, source): definitions, containment, imports, inheritance, calls."""
    began = time.monotonic()
    parsed = materialise(parse(files, analysers), "parsed")
    names = known_names(parsed, max_ambiguity)
    edges, _, refs = resolve_references(parsed, names, max_ambiguity)
    told = parsed.join(names.modules, ["repo_id", "path"]).select("repo_id", "path", "module", "n_lines", "errors")
    kept = materialise(edges.drop("path"), "edges")
    return CodeGraph(names.nodes, kept, told, refs, time.monotonic() - began)


def _targets(parsed: DataFrame, modules: DataFrame) -> DataFrame:
    """Import references with ``target``, the absolute name of the module that they name."""
    refs = _exploded(parsed, "imports").withColumnRenamed("module", "written").join(modules, ["repo_id", "path"])
    return refs.select("repo_id", "path", "file_ord", "ord", "name", "alias", "line", resolve_relative(F.col("module"), F.col("is_package"), F.col("level"), F.col("written")).alias("target"))


def _calls(calls: DataFrame, dotted: DataFrame, nodes: DataFrame, inherits: DataFrame, shorts: DataFrame, max_ambiguity: int) -> tuple[DataFrame, DataFrame]:
    """Call edges, and what became of each call: the first of the ways to resolve it that answers."""
    caller = node_id(F.col("path"), F.coalesce("caller", F.lit(MODULE_SYMBOL)))
    rows = calls.withColumn("src", caller).join(nodes.select("repo_id", F.col("node").alias("src"), F.col("kind").alias("caller_kind")), ["repo_id", "src"])
    rows = rows.withColumn("short", last_part(F.col("name")))
    holder = F.when(F.startswith("name", F.lit("self.")) & (F.col("caller_kind") == python_source.METHOD), F.concat_ws("|", "repo_id", F.regexp_replace("src", r"\.[^.]*$", "")))
    rows = materialise(rows.withColumn("holder", holder), "calls")
    key = lambda c: F.concat_ws("|", "repo_id", c)
    order = F.row_number().over(Window.partitionBy("repo_id", "src").orderBy("ord"))
    up = inherits.withColumn("n", order).select(key("src").alias("cls"), key("dst").alias("base"), F.col("n").alias("ord"))
    methods = nodes.filter(F.col("kind") == python_source.METHOD).select(F.concat_ws("|", "repo_id", F.regexp_replace("node", r"\.[^.]*$", "")).alias("cls"), last_part(F.col("qualname")).alias("member")).distinct()
    asks = rows.filter("holder IS NOT NULL").select(F.col("holder").alias("cls"), F.col("short").alias("member")).distinct()
    owners = first_owner_up(asks, up, methods).select(F.col("cls").alias("holder"), F.col("member").alias("short"), F.concat_ws(".", F.regexp_replace("owner", r"^[^|]*\|", ""), "member").alias("own"))
    rows = rows.join(owners, ["holder", "short"], "left").join(dotted, ["repo_id", "path", "name"], "left").join(shorts, ["repo_id", "short"], "left")
    n = F.coalesce("candidates", F.lit(0))
    way = F.when(F.col("own").isNotNull(), "self_mro").when(F.col("node").isNotNull(), F.when(F.contains("name", F.lit(".")), "attribute").otherwise("direct")).when(F.col("is_external"), "external").when(n == 0, "unresolved").when(n == 1, "unique_name").when(n <= max_ambiguity, "ambiguous").otherwise("too_ambiguous")
    rows = rows.withColumn("via", way)
    targets = F.when(F.col("via") == "self_mro", F.array("own")).when(F.col("via").isin("direct", "attribute"), F.array("node")).when(F.col("via").isin("unique_name", "ambiguous"), F.col("nodes")).otherwise(F.array().cast("array<string>"))
    sure: Column = F.lit(None).cast("double")
    for name, value in CONFIDENCE.items():
        sure = F.when(F.col("via") == name, value).otherwise(sure)
    edges = rows.select("repo_id", "path", "src", F.explode(targets).alias("dst"), F.lit("calls").alias("relation"), sure.alias("confidence"), "via", "line", "file_ord", "ord").filter("src <> dst")
    return edges, rows.select("repo_id", "path", F.concat(F.lit("call_"), "via").alias("outcome"))
