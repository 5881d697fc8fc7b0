"""Places and order statistics within groups of any size: rows are dealt by ranges, so that no group is one task's.

A range partition knows how many rows of a group come before it from a table of counts by partition and group. What is
gathered to add these up is one row for each partition that a group reaches into, not the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import few, materialise


def _same(by: list[str], other: str) -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(f"{other}{c}")) for c in by]


def _before(counts: DataFrame, by: list[str], number: str) -> Column:
    """How many come before, by partition; a group has one row for each partition."""
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(number).over(earlier), F.lit(0))


def placed(df: DataFrame, by: list[str], order: list, name: str = "position") -> DataFrame:
    """df with each row's place (from 1) in its group, in ``order``, which is to be total; nulls are a group of their own.

    Rows that are equal in ``order`` lie in one partition, next to each other. ``by`` may be empty.
    """
    keys = [F.col(c) for c in by]
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = materialise(dealt.withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33).alias("_part")
    counts = rows.groupBy(part, *by).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    known = materialise(counts.select(F.col("_part"), *(F.col(c).alias(f"_of_{c}") for c in by), (_before(counts, by, "_n") - F.col("_first") + 1).alias("_shift")), "shifts")
    joined = rows.join(few(known), [F.shiftright("_at", 33) == F.col("_part"), *_same(by, "_of_")])
    return joined.withColumn(name, (F.col("_at") + F.col("_shift")).cast("int")).drop("_at", "_part", "_shift", *(f"_of_{c}" for c in by))


def order_statistics(df: DataFrame, by: list[str], value: str, shares: dict[str, tuple[int, int]]) -> DataFrame:
    """by..., n and for each name in ``shares`` the value at index n * a // b of the sorted non-null values, exactly.

    Equal values are counted first; distinct ones are dealt by ranges, added up within a partition and over partitions.
    """
    one = F.lit(0).alias("_one")  # a key for what has none
    keys = [*by, "_one"]
    counted = df.filter(F.col(value).isNotNull()).select("*", one).groupBy(*keys, F.col(value).alias("_value")).agg(F.count("*").alias("_n"))
    dealt = materialise(counted.repartitionByRange(*keys, "_value").withColumn("_part", F.spark_partition_id()), "values")
    sums = dealt.groupBy("_part", *keys).agg(F.sum("_n").alias("_sum"))
    before = sums.select("_part", *(F.col(c).alias(f"_of_{c}") for c in keys), _before(sums, keys, "_sum").alias("_before"))
    inside = Window.partitionBy("_part", *keys).orderBy("_value")
    rows = dealt.withColumn("_to", F.sum("_n").over(inside))
    rows = rows.join(few(materialise(before, "sums")).withColumnRenamed("_part", "_p"), [F.col("_part") == F.col("_p"), *_same(keys, "_of_")])
    sizes = materialise(sums.groupBy(*keys).agg(F.sum("_sum").alias("n")), "sizes").select(*(F.col(c).alias(f"_in_{c}") for c in keys), "n")
    rows = rows.withColumn("_to", F.col("_to") + F.col("_before")).join(few(sizes), _same(keys, "_in_"))
    found = [F.max(F.when((F.floor(F.col("n") * a / b) >= F.col("_to") - F.col("_n")) & (F.floor(F.col("n") * a / b) < F.col("_to")), F.col("_value"))).alias(name) for name, (a, b) in shares.items()]
    return rows.groupBy(*keys).agg(F.max("n").alias("n"), *found).drop("_one")
