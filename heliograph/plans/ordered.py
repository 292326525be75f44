"""Building blocks over ordered rows: halves, islands, change points.  All windows of one operator
share partitioning and order, so Spark shuffles and sorts once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_half(keys: list[str], order: str) -> Column:
    """Whether a row lies in the first half of its group, split at count div 2."""
    w = Window.partitionBy(*keys)
    return F.row_number().over(w.orderBy(order)) <= F.floor(F.count("*").over(w) / 2)


def islands(rows: DataFrame, keys: list[str], order: str, starts: Column) -> DataFrame:
    """A number for each maximal run of rows, a new one beginning wherever ``starts`` holds."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("island", F.sum(F.when(starts, 1).otherwise(0)).over(w))


def change_points(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """For each group the split after 2..n-2 rows with the largest gap of means, the earliest on ties.

    Prefix and suffix sums are two frames; subtracting the prefix from the total would cancel digits.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    n = F.count("*").over(Window.partitionBy(*keys))
    gaps = rows.select(
        *keys, order, (F.row_number().over(w) - 1).alias("k"), n.alias("n"), F.avg(value).over(before).alias("level_before"), F.avg(value).over(after).alias("level_after"),
        F.abs(F.col(value) - F.lag(value).over(w)).alias("step"),
    )
    scatter = gaps.groupBy(*keys).agg(F.median("step").alias("scatter"))
    size = F.round(F.abs(F.col("level_after") - F.col("level_before")), 9)
    best = gaps.where((F.col("k") >= 2) & (F.col("k") <= F.col("n") - 2)).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(size), "k")))
    return best.where("rank = 1").drop("rank", "step").join(scatter, keys)
