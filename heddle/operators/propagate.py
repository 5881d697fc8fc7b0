"""Weighted spread of mass from seeds over a typed graph: the ranked blast radius, for many issues and settings at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import BROADCAST_ROWS, SHUFFLES_GO, few, materialise, materialise_by
from ..storage import settings as planned_with
from .order import placed

# How much of a step's mass a relation passes on, against its direction and along it.
RELATION_WEIGHTS = {"calls": (1.00, 0.45), "inherits": (0.80, 0.55), "imports": (0.30, 0.22), "contains": (0.50, 0.50)}
OTHER_WEIGHT = 0.2
DECAY = 0.55
LEAST_MASS = 1e-6
REASONS = 3
#: The most issues times walks that a step is taken for in one row.
SIDE_BY_SIDE = 32
#: Nodes of a bucket of steps, about.
BUCKET_NODES = 20_000
#: Of a graph too large to broadcast, the steps of 2^15 numbers in a row lie together: where the numbering follows the
#: structure (a repository, a tenant), what goes to one node is then added up before it moves.
BLOCK_BITS = 15
#: Joins by block and node take the steps where their blocks lie.
_BY_BLOCK = {"spark.sql.requireAllClusterKeysForCoPartition": "false"} | SHUFFLES_GO
CONFIG_SCHEMA = "config string, hops int, min_confidence double, include_modules boolean"


def rounded(x: Column, digits: int = 6) -> Column:
    """x to so many digits, halves up; the nudge puts sums that differ in their last bit on the same side."""
    unit = float(10**digits)
    return F.floor(x * unit + 0.500001) / unit


def configs(spark: SparkSession, rows: list[tuple[str, int, float, bool]]) -> DataFrame:
    return spark.createDataFrame(rows, CONFIG_SCHEMA)


def step_weight(relation: Column, forward: bool) -> Column:
    weight = F.lit(OTHER_WEIGHT)
    for name, pair in RELATION_WEIGHTS.items():
        weight = F.when(relation == name, F.lit(pair[forward])).otherwise(weight)
    return weight


def adjacency(edges: DataFrame) -> DataFrame:
    """Each edge as a step from either end: node, nb, relation, back, confidence.

    ``edges``: src, dst, relation, confidence (null counts as 1). ``back``: the step goes against the edge.
    """
    ends = [(F.col("src"), F.col("dst"), False), (F.col("dst"), F.col("src"), True)]
    steps = F.array(*(F.struct(a.alias("node"), b.alias("nb"), F.lit(back).alias("back")) for a, b, back in ends))
    return edges.select(F.explode(steps).alias("s"), "relation", F.coalesce("confidence", F.lit(1.0)).alias("confidence")).select("s.*", "relation", "confidence")


@dataclass(frozen=True)
class Adjacency:
    """A graph ready to be walked. nodes: id, node, is_module. steps: a, b (ids), is_module of b, relation, back,
    confidence, weight. degrees: a, tier, n, how many steps a node has by the confidence of calls (null: other steps,
    which every setting may take). tiers: the distinct confidences of calls."""

    nodes: DataFrame
    steps: DataFrame
    degrees: DataFrame
    tiers: DataFrame

    @property
    def lies(self) -> list[str]:
        """The columns by which steps are joined: the node, of a large graph its block too."""
        return ["home", "a"] if "home" in self.steps.columns else ["a"]

    def beside(self, front: DataFrame) -> DataFrame:
        """Rows of nodes (a) with the columns that joins with the steps need."""
        return front.withColumn("home", block_of(F.col("a"))) if "home" in self.lies else front

    def planned(self, spark: SparkSession):
        """What is planned inside joins the steps where they lie."""
        return planned_with(spark, _many(spark, self.nodes.count()) if "home" in self.lies else {})

    def at(self, name: str, ids: DataFrame, column: str) -> DataFrame:
        """A table that holds at least the rows of these ids."""
        return getattr(self, name)

    def named(self, wanted: DataFrame) -> DataFrame:
        """Nodes, at least those that ``wanted`` (node) names."""
        return self.nodes

    def floors(self, least: set[float]) -> dict[float, float]:
        """For each least confidence the lowest tier that it lets pass: settings between the same tiers walk alike."""
        asked = sorted(least)
        row = self.tiers.agg(*(F.min(F.when(F.col("confidence") >= m, F.col("confidence"))).alias(f"f{i}") for i, m in enumerate(asked))).first()
        return {m: float("inf") if row[f"f{i}"] is None else row[f"f{i}"] for i, m in enumerate(asked)}


def block_of(number: Column) -> Column:
    return F.shiftright(number, BLOCK_BITS)


def _buckets(spark: SparkSession, nodes: int) -> int:
    return max(spark.sparkContext.defaultParallelism, min(nodes // BUCKET_NODES, 4096))


def _many(spark: SparkSession, nodes: int) -> dict[str, str]:
    """Settings for a large graph: no fewer shuffle partitions than its size asks for."""
    return _BY_BLOCK | {"spark.sql.shuffle.partitions": str(max(_buckets(spark, nodes), int(spark.conf.get("spark.sql.shuffle.partitions"))))}


def numbered_steps(edges: DataFrame, known: DataFrame) -> DataFrame:
    """``Adjacency.steps`` but for the weight, of edges between known nodes (id, node, is_module). Edges that bring numbers (src_id, dst_id) are
    not joined with the nodes; what they do not know is left to ``between_known``."""
    if "src_id" not in edges.columns:  # once for an edge, not for each of its steps
        ids = few(known)
        edges = edges.join(ids.select(F.col("node").alias("src"), F.col("id").alias("src_id")), "src").join(ids.select(F.col("node").alias("dst"), F.col("id").alias("dst_id")), "dst")
    numbers = edges.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "relation", "confidence").filter("src IS NOT NULL AND dst IS NOT NULL")
    modules = few(known.filter("is_module").select(F.col("id").alias("nb"), "is_module").distinct())
    steps = adjacency(numbers).join(modules, "nb", "left")
    return steps.select(F.col("node").alias("a"), F.col("nb").alias("b"), F.coalesce("is_module", F.lit(False)).alias("is_module"), "relation", "back", "confidence")


def weighed(steps: DataFrame) -> DataFrame:
    """Steps with their weight, which is worked out where they are read so that it need not be moved."""
    weight = F.when(F.col("back"), step_weight(F.col("relation"), False)).otherwise(step_weight(F.col("relation"), True))
    return steps.withColumn("weight", weight * F.col("confidence"))


def between_known(steps: DataFrame, known: DataFrame, edges: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Kept steps without those from or to numbers that no node has. Every step is there from either end, so that the
    ends that steps start from are all ends; as a rule all are known and nothing is written again."""
    if "src_id" not in edges.columns:
        return steps
    unknown = materialise(steps.select("a").distinct().join(known.select(F.col("id").alias("a")), "a", "left_anti"), "unknown")
    if unknown.isEmpty():
        return steps
    gone = few(unknown)
    return keep(steps.join(gone, "a", "left_anti").join(gone.withColumnRenamed("a", "b"), "b", "left_anti").select(steps.columns))


def counted_steps(steps: DataFrame) -> DataFrame:
    lies = [c for c in ("home", "a") if c in steps.columns]
    return steps.groupBy(*lies, F.when(F.col("relation") == "calls", F.col("confidence")).alias("tier")).agg(F.count("*").alias("n")).select("a", "tier", "n")


def prepared(edges: DataFrame, nodes: DataFrame) -> Adjacency:
    """``edges`` (src, dst, relation, confidence) between ``nodes`` (node, is_module), numbered and kept for this session.

    Nodes may bring their numbers (id, a whole number for each name) and edges those of their ends (src_id, dst_id), both or neither.
    Steps lie in buckets of the node that they start from, of a large graph in buckets of its block, so that no hop has to move them.
    """
    spark = nodes.sparkSession
    known = materialise(nodes.select(F.col("id") if "id" in nodes.columns else F.monotonically_increasing_id().alias("id"), "node", "is_module"), "nodes")
    n = known.count()
    large = n > BROADCAST_ROWS
    # Spark moves tables of fewer buckets than shuffles have partitions
    buckets = max(_buckets(spark, n), int(spark.conf.get("spark.sql.shuffle.partitions"))) if large else _buckets(spark, n)
    keep = lambda df: materialise_by(df, "steps", "home" if large else "a", buckets)
    with planned_with(spark, _many(spark, n) if large else {}):
        steps = numbered_steps(edges, known)
        steps = between_known(keep(steps.withColumn("home", block_of(F.col("a"))) if large else steps), known, edges, keep)
        degrees = materialise(counted_steps(steps), "degrees")
    return Adjacency(known, weighed(steps), degrees, degrees.filter("tier IS NOT NULL").select(F.col("tier").alias("confidence")).distinct())


def spread(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, settings: DataFrame, decay: float = DECAY, reasons: bool = True, label: Callable[[Column], Column] = lambda node: node, visits: bool = True) -> DataFrame:
    """``spread_over`` a graph that is prepared for this one call."""
    return spread_over(prepared(edges, nodes), seeds, settings, decay, reasons, label, visits)


def spread_over(graph: Adjacency, seeds: DataFrame, settings: DataFrame, decay: float = DECAY, reasons: bool = True, label: Callable[[Column], Column] = lambda node: node, visits: bool = True) -> DataFrame:
    """issue_id, config, node, distance, mass, visits, reasons: what each issue's seeds reach under each setting.

    ``seeds``: issue_id, node, weight (null is 1; a node given twice adds up; unknown nodes are left out). ``settings``:
    CONFIG_SCHEMA. A node's mass is split over its traversable steps, those to modules and
    to visited nodes included; modules then lose theirs unless the setting includes them. A node takes all of its mass
    in the hop that first reaches it, and seeds keep their own. visits counts the contributions to a node, reasons are
    the largest three of them, if asked for, with ``label`` naming the node that each came from. Without ``visits`` they
    may be null.

    Settings that differ in their hops alone, or in a confidence between the same tiers, share a walk; an issue and a walk
    are one number, its origin. A hop asks the graph for the steps and degrees of frontier nodes only; a small frontier is
    broadcast to the steps, which then do not move. Each hop is one job over all issues and walks. Up to ``SIDE_BY_SIDE``
    issues times walks lie side by side in a row of the frontier, so that a step is taken once for all of them.
    """
    spark = seeds.sparkSession
    rows = settings.select("config", "hops", "min_confidence", "include_modules").collect()
    floor = graph.floors({r.min_confidence for r in rows})
    ways = sorted({(floor[r.min_confidence], r.include_modules) for r in rows})
    most = {w: max(r.hops for r in rows if (floor[r.min_confidence], r.include_modules) == w) for w in ways}
    walks = F.broadcast(spark.createDataFrame([(i, *w, most[w]) for i, w in enumerate(ways)], "walk int, floor double, include_modules boolean, most int"))
    grid = F.broadcast(spark.createDataFrame([(r.config, r.hops, ways.index((floor[r.min_confidence], r.include_modules))) for r in rows], "config string, hops int, walk int"))
    walk = F.pmod("origin", F.lit(len(ways))).cast("int").alias("walk")
    issues = materialise(seeds.select("issue_id").distinct().select("issue_id", F.monotonically_increasing_id().alias("issue")), "issues")
    given = seeds.join(few(issues.withColumnRenamed("issue_id", "of")), F.col("issue_id").eqNullSafe(F.col("of")))
    base = given.join(graph.named(seeds), "node").groupBy("issue", F.col("id").alias("a")).agg(F.sum(F.coalesce(F.col("weight").cast("double"), F.lit(1.0))).alias("mass"))
    start = F.array(F.lit("seed")) if reasons else F.array().cast("array<string>")
    origin = (F.col("issue") * len(ways) + F.col("walk")).alias("origin")
    hop = materialise(base.crossJoin(walks).select(origin, "a", F.lit(0).alias("distance"), "mass", F.lit(0).cast("long").alias("visits"), start.alias("reasons")), "hop")
    visited = hop
    listed = [r.issue for r in issues.select("issue").limit(SIDE_BY_SIDE + 1).collect()]
    beside = not reasons and len(listed) * len(ways) <= SIDE_BY_SIDE
    is_open = (F.col("relation") != "calls") | (F.col("confidence") >= F.col("floor"))
    for h in range(1, max((r.hops for r in rows), default=0) + 1):
        held = hop.count()
        if not held:
            break
        small = F.broadcast if held <= BROADCAST_ROWS else lambda df: df.hint("shuffle_hash")
        if beside:
            going = [(i * len(ways) + w, *ways[w], w) for i in listed for w in range(len(ways)) if most[ways[w]] >= h]
            found = _side_by_side(graph, hop, visited, going, decay, small, _not_reached(graph, visited, [g[0] for g in going]), visits)
            with graph.planned(spark):
                hop = materialise(found.select("origin", F.col("b").alias("a"), F.lit(h).alias("distance"), "mass", "visits", start.alias("reasons")), "hop")
            visited = visited.unionByName(hop)
            continue
        before = few(visited.select("origin", F.col("a").alias("b")))
        front = hop.withColumn("walk", walk).join(walks.filter(F.col("most") >= h), "walk").select("origin", "floor", "include_modules", "a", "mass")
        degree = graph.at("degrees", hop, "a").join(small(front.select("a", "floor").distinct()), "a").filter(F.col("tier").isNull() | (F.col("tier") >= F.col("floor"))).groupBy("floor", "a").agg(F.sum("n").alias("degree"))
        front = front.join(small(degree), ["floor", "a"]).withColumn("mass", F.col("mass") * decay / F.col("degree"))
        if reasons:  # named here, where a node is one row for an origin and not one for each step
            front = front.join(graph.at("nodes", hop, "a").select(F.col("id").alias("a"), label(F.col("node")).alias("from")), "a")
        moved = graph.at("steps", hop, "a").join(small(graph.beside(front)), graph.lies).filter(is_open & (F.col("include_modules") | ~F.col("is_module")))
        moved = moved.select("origin", "b", (F.col("mass") * F.col("weight")).alias("part"), "relation", "back", *["from"] * reasons).filter(F.col("part") > LEAST_MASS)
        # summed first: where the visited are many, the rows then lie as their join needs them
        found = moved.groupBy("origin", "b").agg(F.sum("part").alias("mass"), F.count("*").alias("visits")).join(before, ["origin", "b"], "left_anti")
        if reasons:  # only the largest contributions are gathered, whatever the number of those to a hub
            fresh = moved.join(before, ["origin", "b"], "left_anti")
            told = fresh.select("origin", "b", "part", F.concat("relation", F.when(F.col("back"), " from ").otherwise(" to "), "from", F.lit(f" @{h}")).alias("reason"))
            order = F.row_number().over(Window.partitionBy("origin", "b").orderBy(F.desc("part"), "reason"))
            top = told.withColumn("n", order).filter(F.col("n") <= REASONS).groupBy("origin", "b").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "reason"))), lambda r: r["reason"]).alias("reasons"))
            found = found.join(top, ["origin", "b"])
        else:
            found = found.withColumn("reasons", start)
        with graph.planned(spark):
            hop = materialise(found.select("origin", F.col("b").alias("a"), F.lit(h).alias("distance"), "mass", "visits", "reasons"), "hop")
        visited = visited.unionByName(hop)
    # named before the settings multiply the rows
    reached = visited.join(few(graph.at("nodes", visited, "a")).select(F.col("id").alias("a"), "node"), "a")
    reached = reached.withColumn("walk", walk).join(grid, "walk").filter(F.col("distance") <= F.col("hops"))
    reached = reached.withColumn("issue", F.expr(f"origin div {len(ways)}")).join(few(issues), "issue")
    return reached.select("issue_id", "config", "node", "distance", "mass", "visits", "reasons")


def _not_reached(graph: Adjacency, visited: DataFrame, origins: list[int]) -> DataFrame | None:
    """The nodes (b) that some of the origins have not reached, where these are few; else None."""
    reached = visited.filter(F.col("origin").isin(origins))
    if graph.nodes.count() * len(origins) - reached.count() > BROADCAST_ROWS:
        return None
    everywhere = reached.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") == len(origins))
    return graph.nodes.select(F.col("id").alias("b")).join(everywhere.select(F.col("a").alias("b")), "b", "left_anti")


def _side_by_side(graph: Adjacency, hop: DataFrame, visited: DataFrame, going: list[tuple[int, float, bool, int]], decay: float, small: Callable[[DataFrame], DataFrame], left: DataFrame | None, visits: bool) -> DataFrame:
    """origin, b, mass, visits: what a hop of the origins ``going`` (origin, floor, include_modules, walk) reaches first, a column for each.

    ``left`` (b), if given, are the nodes that some of the origins have not reached; no step to others matters. A node's
    row knows by bits which origins ``visited`` it, so that rows of single origins never move."""
    floors = {w: floor for _, floor, _, w in going}
    passes = lambda confidence, floor: confidence.isNull() | (confidence >= F.lit(floor))
    degree = graph.at("degrees", hop, "a").groupBy("a").agg(*(F.sum(F.when(passes(F.col("tier"), floor), F.col("n"))).alias(f"d{w}") for w, floor in floors.items()))
    masses = hop.groupBy("a").agg(*(F.max(F.when(F.col("origin") == origin, F.col("mass"))).alias(f"m{i}") for i, (origin, *_) in enumerate(going)))
    front = graph.beside(masses.join(degree, "a").select("a", *((F.col(f"m{i}") * decay / F.col(f"d{w}")).alias(f"m{i}") for i, (*_, w) in enumerate(going))))
    call = F.when(F.col("relation") == "calls", F.col("confidence"))
    steps = graph.at("steps", hop, "a").select(*graph.lies, "b", "is_module", "weight", call.alias("tier"))
    steps = (steps if left is None else steps.join(F.broadcast(left), "b", "left_semi")).join(small(front), graph.lies)

    def part(i: int, floor: float, include_modules: bool) -> Column:
        mass = F.col(f"m{i}") * F.col("weight")
        taken = passes(F.col("tier"), floor) & (mass > LEAST_MASS)
        return F.when(taken if include_modules else taken & ~F.col("is_module"), mass)

    moved = steps.select("b", *(part(i, floor, modules).alias(f"p{i}") for i, (_, floor, modules, _) in enumerate(going)))
    moved = moved.filter(F.coalesce(*(F.col(f"p{i}") for i in range(len(going)))).isNotNull())
    sums = moved.groupBy("b").agg(*(f(f"p{i}").alias(f"{name}{i}") for i in range(len(going)) for f, name in ((F.sum, "s"), (F.count, "n"))[: 1 + visits]))
    bit = F.coalesce(*(F.when(F.col("origin") == origin, F.lit(1 << i).cast("long")) for i, (origin, *_) in enumerate(going)))
    before = visited.select(F.col("a").alias("b"), bit.alias("bit")).filter("bit IS NOT NULL").groupBy("b").agg(F.bit_or("bit").alias("before"))
    known = sums.join(F.broadcast(before) if visited.count() <= BROADCAST_ROWS else before, "b", "left").withColumn("before", F.coalesce("before", F.lit(0).cast("long")))
    first = lambda i: F.when(F.col("before").bitwiseAND(F.lit(1 << i).cast("long")) == 0, F.col(f"s{i}"))
    times = lambda i: F.col(f"n{i}") if visits else F.lit(None).cast("long")
    apart = F.explode(F.array(*(F.struct(F.lit(origin).cast("long").alias("origin"), first(i).alias("mass"), times(i).alias("visits")) for i, (origin, *_) in enumerate(going))))
    return known.select("b", apart.alias("of")).select("of.origin", "b", "of.mass", "of.visits").filter("mass IS NOT NULL")


def ranked(reached: DataFrame, at_most: int | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    """``spread``'s rows with score (six digits) and rank: seeds first, then by score, ties by node; no issue is one task's.

    ``at_most``: only ranks up to this one, which tasks then pick before anything moves. ``without``: columns that are not
    needed once there are scores, and so do not move."""
    scored = reached.withColumn("score", rounded(F.col("mass"))).withColumn("_far", (F.col("distance") != 0).cast("int")).drop(*without)
    order = ["_far", F.desc("score"), "node"]
    if at_most is not None:
        return scored.withColumn("rank", F.row_number().over(Window.partitionBy("issue_id", "config").orderBy(*order))).filter(F.col("rank") <= at_most).drop("_far")
    return placed(scored, ["issue_id", "config"], order, "rank").drop("_far")


def spread_stats(reached: DataFrame, seeds: DataFrame) -> DataFrame:
    """issue_id, config, seeds_given, seeds_found, reached, expansions and the last hop that reached anything."""
    given = seeds.groupBy("issue_id").agg(F.countDistinct("node").alias("seeds_given"))
    got = reached.groupBy("issue_id", "config").agg(F.count_if(F.col("distance") == 0).alias("seeds_found"), F.count("*").alias("reached"), F.sum("visits").alias("expansions"), F.max("distance").alias("hops"))
    return given.join(got, "issue_id", "left")
