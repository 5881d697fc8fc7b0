"""Ordering, deduplicating and packing ranked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import few, materialise
from .order import placed


def top(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group in the given order, with ``rank``."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def best_offer(offers: DataFrame, by: list[str], weight: str, offered: str) -> DataFrame:
    """The heaviest offer of each group; of equal ones, the first offered."""
    return top(offers, by, [F.desc(weight), F.col(offered)], 1).drop("rank")


def first_appearance(df: DataFrame, by: list[str], item: str, rank: str) -> DataFrame:
    """Each item once, at its first rank, and its position among the items."""
    first = df.groupBy(*by, item).agg(F.min(rank).alias("first_rank"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("first_rank", item))
    return first.withColumn("position", place)


def _leads(ranked: DataFrame, by: list[str], path: str, rank: str) -> DataFrame:
    """The best rank of each path, as columns of other names."""
    best = ranked.groupBy(*by, path).agg(F.min(rank).alias("_best"))
    return best.select(*(F.col(c).alias(f"_l_{c}") for c in (*by, path)), "_best")


def _with_lead(ranked: DataFrame, by: list[str], path: str, rank: str) -> DataFrame:
    """ranked with ``_lead``: whether a row is the best of its path. Ranks of a group are different."""
    same = [F.col(c).eqNullSafe(F.col(f"_l_{c}")) for c in (*by, path)]
    rows = ranked.join(few(materialise(_leads(ranked, by, path, rank), "leads")), same)
    return rows.withColumn("_lead", F.col(rank) == F.col("_best")).drop("_best", *(f"_l_{c}" for c in (*by, path)))


def evidence_first(ranked: DataFrame, named: DataFrame, by: list[str], path: str = "path", rank: str = "rank") -> DataFrame:
    """Ranked rows with ``position``: first, in the order named, the best row of each named path; then the rest by rank.

    ``named``: by..., path, named_at. Groups may have any size: see ``order.placed``.
    """
    rows = _with_lead(ranked, by, path, rank).join(named, [*by, path], "left")
    lead = F.col("_lead") & F.col("named_at").isNotNull()
    turn = [F.when(lead, 0).otherwise(1), F.when(lead, F.col("named_at")), F.col(rank)]
    return placed(rows, by, turn).drop("_lead", "named_at")


def file_diversity(ranked: DataFrame, by: list[str], path: str = "path", rank: str = "rank") -> DataFrame:
    """Ranked rows with ``position``: the first of each path in rank order, then what is left in rank order."""
    rows = _with_lead(ranked, by, path, rank)
    return placed(rows, by, [F.when(F.col("_lead"), 0).otherwise(1), F.col(rank)]).drop("_lead")


def token_cost(text: Column) -> Column:
    return F.floor(F.char_length(text) / 4)


def budget_pack(items: DataFrame, by: list[str], position: str, cost: str, k: int, budget: int) -> DataFrame:
    """The items of each group that a greedy packer takes, with ``picked_at`` and ``used`` (the tokens so far).

    It goes by position, stops at k items or once the budget is used up, and skips an item that would overshoot, but
    always takes the first. Costs are whole and not negative; null counts as 0.

    An item with k earlier ones of its own cost is never taken: where it fits, they fitted too. So the first k of each
    cost hold the answer, k * (budget + 2) rows of a group at most, whatever its size; only these come together.
    """
    kind = {f.name: f.dataType.simpleString() for f in items.schema}
    picks = f"array<struct<at:{kind[position]},cost:{kind[cost]},picked_at:int,used:bigint>>"
    rows = items.select(*by, F.col(position).alias("at"), F.coalesce(cost, F.lit(0)).cast(kind[cost]).alias("cost"))
    # items over the budget are one class: of these, none but the first of all can be taken
    same = Window.partitionBy(*by, F.least("cost", F.lit(budget + 1))).orderBy("at", "cost")
    early = rows.withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= k)
    lists = early.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("at", "cost"))).alias("items"))

    def take(state: Column, item: Column) -> Column:
        taken, used = state["taken"], state["used"] + item["cost"]
        fits = (F.size(taken) < k) & (state["used"] < budget) & ((F.size(taken) == 0) | (used <= budget))
        more = F.struct(item["at"].alias("at"), item["cost"].alias("cost"), (F.size(taken) + 1).alias("picked_at"), used.cast("long").alias("used"))
        return F.when(fits, F.struct(F.array_append(taken, more).alias("taken"), used.cast("long").alias("used"))).otherwise(state)

    start = F.struct(F.array().cast(picks).alias("taken"), F.lit(0).cast("long").alias("used"))
    packed = lists.select(*by, F.explode(F.aggregate("items", start, take, lambda state: state["taken"])).alias("pick"))
    return packed.select(*by, F.col("pick.at").alias(position), F.col("pick.cost").alias(cost), "pick.picked_at", "pick.used")


def chunk_lines(files: DataFrame, lines: int = 40, key: str = "path", text: str = "text") -> DataFrame:
    """key, start_line, end_line, text: windows of so many lines that do not overlap; blank ones are left out."""
    parts = F.split(F.col(text), "\n", -1)
    # a last line feed ends a line and begins none
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    split = files.filter(F.col(text).isNotNull() & (F.col(text) != "")).select(key, parts.alias("lines")).filter(F.size("lines") > 0)
    starts = split.select(key, "lines", F.explode(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / lines).cast("int"))).alias("i"))
    piece = F.slice("lines", F.col("i") * lines + 1, lines)
    out = starts.select(key, (F.col("i") * lines + 1).alias("start_line"), F.least((F.col("i") + 1) * lines, F.size("lines")).alias("end_line"), F.array_join(piece, "\n").alias("text"))
    return out.filter(F.regexp_replace("text", r"\s", "") != "")
