"""Recall of ranked lists against gold sets, and its summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import order_statistics
from .propagate import rounded

K_LEVELS = (1, 3, 5, 10, 20)


def recall_at_k(ranked: DataFrame, gold: DataFrame, by: list[str], item: str, levels: tuple[int, ...] = K_LEVELS, rank: str = "rank") -> DataFrame:
    """by..., k, recall, any_hit for every group with gold, found or not.

    ``ranked``: by..., item, rank. ``gold``: by..., item. An item that is ranked twice counts at its first rank.
    """
    sizes = gold.groupBy(*by).agg(F.countDistinct(item).alias("n_gold"))
    listed = ranked.filter(F.col(rank) <= max(levels, default=0))
    hits = listed.join(gold.distinct(), [*by, item]).groupBy(*by, item).agg(F.min(rank).alias("first_rank"))
    grid = sizes.withColumn("k", F.explode(F.array(*map(F.lit, levels))))
    joined = grid.join(hits, by, "left").groupBy(*by, "n_gold", "k").agg(F.count_if(F.col("first_rank") <= F.col("k")).alias("n_hit"))
    return joined.select(*by, "k", rounded(F.col("n_hit") / F.col("n_gold")).alias("recall"), (F.col("n_hit") > 0).alias("any_hit"))


def recall_of_class(ranked: DataFrame, asked: DataFrame, by: list[str], own: str, theirs: str, levels: tuple[int, ...] = K_LEVELS, rank: str = "rank") -> DataFrame:
    """by..., asked's columns, k, recall, any_hit where the gold of a group is all other items of its class.

    ``ranked``: by..., rank, ``theirs`` (the class of an item; each item once). ``asked``: by..., ``own``, n_gold. Gold of a
    class is counted once and never listed, so that its size costs nothing.
    """
    grid = asked.withColumn("k", F.explode(F.array(*map(F.lit, levels))))
    hits = ranked.select(*by, F.col(rank).alias("at"), theirs)
    found = grid.join(hits, by, "left").groupBy(*asked.columns, "k").agg(F.count_if((F.col(theirs) == F.col(own)) & (F.col("at") <= F.col("k"))).alias("n_hit"))
    return found.select(*(c for c in asked.columns if c != "n_gold"), "k", rounded(F.col("n_hit") / F.col("n_gold")).alias("recall"), (F.col("n_hit") > 0).alias("any_hit"))


def summarise(recalls: DataFrame, by: list[str], digits: int = 4) -> DataFrame:
    """by..., k, instances, mean recall and share of any hit."""
    return recalls.groupBy(*by, "k").agg(F.count("*").alias("instances"), rounded(F.avg("recall"), digits).alias("mean_recall"), rounded(F.avg(F.col("any_hit").cast("int")), digits).alias("any_hit_rate"))


def rollup_recall(recalls: DataFrame, group: str, digits: int = 4) -> DataFrame:
    """k, group (null: overall), instances and mean recall in one pass."""
    return recalls.rollup("k", group).agg(F.count("*").alias("instances"), rounded(F.avg("recall"), digits).alias("mean_recall")).filter(F.col("k").isNotNull())


def index_percentiles(ranks: DataFrame, by: list[str], rank: str) -> DataFrame:
    """by..., n, p25, p50, p75 (the sorted ranks at n//4, n//2 and 3n//4, no interpolation), and how many are within 3, 5 and 10."""
    quarters = order_statistics(ranks, by, rank, {"p25": (1, 4), "p50": (1, 2), "p75": (3, 4)})
    within = ranks.filter(F.col(rank).isNotNull()).groupBy(*(F.col(c).alias(f"_w_{c}") for c in by), F.lit(0).alias("_w")).agg(*(F.count_if(F.col(rank) <= k).alias(f"within_{k}") for k in (3, 5, 10)))
    # one row for each group on both sides
    same = [F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in by]
    return quarters.withColumn("_one", F.lit(0)).join(within, [F.col("_one") == F.col("_w"), *same]).drop("_one", "_w", *(f"_w_{c}" for c in by))


def resolved_rate(report: DataFrame, by: list[str]) -> DataFrame:
    """by..., submitted, resolved and their ratio (0 where nothing was submitted)."""
    sums = report.groupBy(*by).agg(F.count_if("submitted").alias("submitted"), F.count_if(F.col("submitted") & F.col("resolved")).alias("resolved"))
    return sums.withColumn("resolved_rate", rounded(F.coalesce(F.try_divide("resolved", "submitted"), F.lit(0.0)), 4))


def first_novel(ranked: DataFrame, evidence: DataFrame, by: list[str], item: str, rank: str = "rank") -> DataFrame:
    """by..., first_rank: the rank of the first item that the evidence (by..., item) did not name; null if it named all."""
    fresh = ranked.join(evidence.select(*by, item).distinct(), [*by, item], "left_anti").groupBy(*by).agg(F.min(rank).alias("first_rank"))
    return ranked.select(*by).distinct().join(fresh, by, "left")


def delivery_gap(ranked: DataFrame, delivered: DataFrame, gold: DataFrame, by: list[str], item: str, k: int) -> DataFrame:
    """One row: groups with gold, mean recall of what was delivered and of the first k ranked, groups where packing lost
    gold that was ranked, and the mean number of items delivered."""
    at_k = recall_at_k(ranked, gold, by, item, (k,)).select(*by, F.col("recall").alias("ranked_recall"))
    given = delivered.select(*by, item).distinct()
    got = recall_at_k(given.withColumn("rank", F.lit(1)), gold, by, item, (1,)).select(*by, F.col("recall").alias("delivered_recall"))
    sizes = given.groupBy(*by).agg(F.count("*").alias("items"))
    rows = at_k.join(got, by).join(sizes, by, "left")
    return rows.agg(
        F.count("*").alias("groups"),
        rounded(F.avg("delivered_recall"), 4).alias("mean_delivered"),
        rounded(F.avg("ranked_recall"), 4).alias("mean_ranked"),
        F.count_if(F.col("delivered_recall") < F.col("ranked_recall")).alias("losing"),
        rounded(F.avg(F.coalesce("items", F.lit(0))), 4).alias("mean_items"),
    )
