"""Graph tables: deduplicated typed edges, degrees, ownership, name tiers, prefix and suffix lookups, walks up a hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise

# The confidence of each way to resolve a call.
CONFIDENCE = {"direct": 1.0, "attribute": 0.9, "self_mro": 0.85, "unique_name": 0.5, "ambiguous": 0.25}
AMBIGUITY_AT_MOST = 3


def last_edge_wins(edges: DataFrame, order: list[str], carried: list[str]) -> DataFrame:
    """One edge for each (src, dst, relation), with what the last of its rows carries.

    ``order`` must be total: rows of an edge that are equal in it must be equal in ``carried`` too, or else which of them
    is taken is left open. Nulls come first. One column of a plain type is the fastest, above all where it is what is carried.
    """
    if len(order) == 1:  # one plain order: buffers of fixed width, which hash aggregation can hold
        return edges.groupBy("src", "dst", "relation").agg(*(F.max(c).alias(c) if c == order[0] else F.max_by(c, order[0]).alias(c) for c in carried))
    last = F.max_by(F.struct(*carried), F.struct(*order))
    return edges.groupBy("src", "dst", "relation").agg(last.alias("last")).select("src", "dst", "relation", *(F.col(f"last.{c}").alias(c) for c in carried))


def fan_in_out(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """path, fan_in, fan_out over distinct pairs (src, dst) of different paths; paths without any are there with zeros."""
    distinct = pairs.filter("src <> dst").select("src", "dst").distinct()
    out = distinct.groupBy(F.col("src").alias("path")).agg(F.count("*").alias("fan_out"))
    into = distinct.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("fan_in"))
    return files.select("path").join(into, "path", "left").join(out, "path", "left").select("path", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def edge_counts(pairs: DataFrame) -> DataFrame:
    """src, dst, n: how many edges lead from one path to another."""
    return pairs.filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def unique_owner(claims: DataFrame, key: list[str], owner: str) -> DataFrame:
    """key..., owner, claims: the owner only where exactly one claims the key."""
    counted = claims.groupBy(*key).agg(F.countDistinct(owner).alias("claims"), F.min(owner).alias("owner"))
    return counted.select(*key, F.when(F.col("claims") == 1, F.col("owner")).alias("owner"), "claims")


def name_tiers(candidates: Column, at_most: int = AMBIGUITY_AT_MOST) -> tuple[Column, Column]:
    """via and confidence of a name with so many candidates."""
    via = F.when(candidates == 0, "unresolved").when(candidates == 1, "unique_name").when(candidates <= at_most, "ambiguous").otherwise("too_ambiguous")
    confidence = F.when(candidates == 1, CONFIDENCE["unique_name"]).when((candidates > 1) & (candidates <= at_most), CONFIDENCE["ambiguous"])
    return via, confidence


def counts(parts: Column) -> Column:
    """1 to the number of parts; nothing if there are none."""
    return F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>"))


def prefixes(parts: Column, separator: str) -> Column:
    """Every prefix of a list of parts as (prefix, size)."""
    return F.transform(counts(parts), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), separator).alias("prefix"), n.alias("size")))


def suffixes(parts: Column, separator: str) -> Column:
    """Every suffix of a list of parts as (suffix, size)."""
    return F.transform(counts(parts), lambda n: F.struct(F.array_join(F.slice(parts, F.size(parts) - n + 1, n), separator).alias("suffix"), n.alias("size")))


def longest_prefix(names: DataFrame, bindings: DataFrame, key: list[str], separator: str = ".") -> DataFrame:
    """names with the longest of their dotted prefixes that is bound: bound, size and the binding's columns, or nulls.

    ``names``: key..., name. ``bindings``: prefix and other columns. The exploded prefixes make it an equality join.
    """
    spread = names.select(*key, "name", F.explode(prefixes(F.split("name", "\\" + separator if separator == "." else separator, -1), separator)).alias("p")).select(*key, "name", "p.prefix", "p.size")
    others = [c for c in bindings.columns if c != "prefix" and c not in key]
    on = [c for c in key if c in bindings.columns] + ["prefix"]
    hit = spread.join(bindings, on)
    best = hit.groupBy(*key, "name").agg(F.max_by(F.struct("prefix", "size", *others), F.col("size")).alias("b")).select(*key, "name", F.col("b.prefix").alias("bound"), F.col("b.size").alias("size"), *(F.col(f"b.{c}").alias(c) for c in others))
    return names.select(*key, "name").join(best, [*key, "name"], "left")


def suffix_match(mentions: DataFrame, known: DataFrame, key: list[str], separator: str = "/") -> DataFrame:
    """key..., mention, path: the known path that a mentioned one means.

    Leading segments of the mention are dropped until a known path equals the rest or ends in it; a lone last segment
    must end one path only. ``mentions``: key..., mention. ``known``: path, with any of key. Suffixes are exploded once.
    """
    clean = F.filter(F.split(F.regexp_replace("mention", r"^[./]+|[./]+$", ""), separator, -1), lambda s: s != "")
    asked = mentions.select(*key, "mention", F.explode(suffixes(clean, separator)).alias("s")).select(*key, "mention", "s.suffix", "s.size")
    ends = known.select(*(c for c in known.columns), F.explode(suffixes(F.split("path", separator, -1), separator)).alias("s")).select(*known.columns, F.col("s.suffix").alias("suffix"))
    on = [c for c in key if c in known.columns] + ["suffix"]
    hits = asked.join(ends, on)
    longest = hits.groupBy(*key, "mention").agg(F.max("size").alias("size"))
    found = hits.join(longest, [*key, "mention", "size"]).groupBy(*key, "mention", "size").agg(F.min(F.struct(F.length("path").alias("n"), "path")).alias("best"), F.countDistinct("path").alias("n"))
    return found.filter("size > 1 OR n = 1").select(*key, "mention", F.col("best.path").alias("path"))


def innermost(points: DataFrame, spans: DataFrame, key: list[str], point: str, at: str, order: str) -> DataFrame:
    """Each point with the shortest span of its key that covers it, ties to the first in ``order``; null if none does.

    ``spans``: key..., span_start, span_end, ``order``. Places are whole numbers. A span goes into one or two bins of a
    width that is the next power of two above its length; a point looks into its bin of each width that any span has, so
    that keys and bins are joined by equality, and a point meets only spans that begin or end within their own length of it.
    """
    size = F.col("span_end") - F.col("span_start")
    # the number of binary digits: 2**level is more than the length
    spans = spans.filter(size >= 0).withColumn("level", F.length(F.bin(size)))
    spans = spans.withColumn("bin", F.explode(F.array_distinct(F.array(F.expr("shiftright(span_start, level)"), F.expr("shiftright(span_end, level)")))))
    levels = sorted(r.level for r in spans.select("level").distinct().collect())  # 64 at most
    asked = points.filter(F.col(at).isNotNull()).select(*key, point, F.col(at).cast("long").alias("at"), F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("level")).withColumn("bin", F.expr("shiftright(at, level)"))
    hits = asked.join(spans.select(*key, "level", "bin", "span_start", "span_end", order), [*key, "level", "bin"]).filter("at >= span_start AND at <= span_end")
    best = hits.groupBy(*key, point).agg(F.min_by(F.col(order), F.struct(F.col("span_end") - F.col("span_start"), F.col(order))).alias("inside"))
    return points.join(best, [*key, point], "left")


#: More levels than any hierarchy has; a walk that is still going then fails rather than lose rows.
LEVELS_AT_MOST = 1000


def closure(edges: DataFrame, rounds: int = LEVELS_AT_MOST) -> DataFrame:
    """node, above, depth: everything above a node, at its least depth. ``edges``: node, parent.

    Each round extends the newest rows by one step and drops what was known; it stops when nothing is new, and fails if rows are still new
    after ``rounds``.
    """
    known = newest = materialise(edges.select("node", F.col("parent").alias("above"), F.lit(1).alias("depth")).distinct(), "closure")
    for depth in range(2, rounds + 2):
        step = newest.select("node", F.col("above").alias("mid")).join(edges.select(F.col("node").alias("mid"), F.col("parent").alias("above")), "mid")
        newest = materialise(step.select("node", "above").distinct().join(known, ["node", "above"], "left_anti").withColumn("depth", F.lit(depth)), "closure")
        if newest.isEmpty():
            break
        if depth > rounds:
            raise RuntimeError(f"closure has new rows after {rounds} rounds")
        known = known.unionByName(newest)
    return known


def first_owner_up(asks: DataFrame, bases: DataFrame, owns: DataFrame, rounds: int = LEVELS_AT_MOST) -> DataFrame:
    """cls, member, owner, depth: the first class, breadth first over bases in their declared order, that owns the member.

    ``asks``: cls, member. ``bases``: cls, base, ord. ``owns``: cls, member. A walk's order is the list of ords it took;
    a level drops who has an answer, so a deep hierarchy costs only those still looking; it fails if some
    still look after ``rounds``.
    """
    from pyspark.sql import types as T

    start = asks.distinct().select("cls", "member", F.col("cls").alias("at"), F.array().cast(T.ArrayType(T.IntegerType())).alias("way"), F.array("cls").alias("seen"))
    looking, found = start, None
    for depth in range(rounds + 1):
        hit = looking.join(owns.select(F.col("cls").alias("at"), "member"), ["at", "member"], "left_semi")
        got = hit.groupBy("cls", "member").agg(F.min_by("at", "way").alias("owner")).withColumn("depth", F.lit(depth))
        got = materialise(got, "mro")
        found = got if found is None else found.unionByName(got)
        step = looking.join(got, ["cls", "member"], "left_anti").join(bases.select(F.col("cls").alias("at"), "base", "ord"), "at")
        step = step.filter(~F.array_contains("seen", F.col("base"))).select("cls", "member", F.col("base").alias("at"), F.array_append("way", F.col("ord").cast("int")).alias("way"), F.array_append("seen", F.col("base")).alias("seen"))
        # a class that two ways reach on one level is visited once, by the first
        first = Window.partitionBy("cls", "member", "at").orderBy("way")
        looking = materialise(step.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n"), "mro")
        if looking.isEmpty():
            break
    else:
        raise RuntimeError(f"classes above are left after {rounds} rounds")
    return found
