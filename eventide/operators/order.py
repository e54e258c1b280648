"""Exact order statistics of columns of any size: distinct values are counted, sorted by ranges and ranked range by range.

No task holds more than its range of the distinct values, and nothing but counts by range is added up across ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialize


def ranked_values(cells: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n, before, total): each distinct value of a key, how often it is there, how many are less, how many there are.

    Null values aren't counted; NaN is greater than any number. Neither column may have a name of the result's.
    """
    counts = cells.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    own = materialize(counts.repartitionByRange(key, value).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = own.groupBy(key, "_range").agg(F.sum("n").alias("_sum"))
    lower = W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(key, "_range", F.coalesce(F.sum("_sum").over(lower), F.lit(0)).alias("_offset"), F.sum("_sum").over(W.partitionBy(key)).alias("total"))
    within = W.partitionBy(key, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    rows = own.withColumn("_within", F.coalesce(F.sum("n").over(within), F.lit(0))).join(offsets, [key, "_range"])
    return rows.select(key, value, "n", (F.col("_within") + F.col("_offset")).alias("before"), "total")


def holds_rank(rank: Column | str) -> Column:
    """Whether a row of :func:`ranked_values` has the value at ``rank`` (from 0)."""
    rank = F.expr(rank) if isinstance(rank, str) else rank
    return (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))


def medians(cells: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, median): exact medians by key, of an even number the mean of the middle two. A key without any value has no row."""
    ranked = ranked_values(cells.select(key, F.col(value).cast("double").alias(value)), key, value)
    low, high = holds_rank("(total - 1) div 2"), holds_rank("total div 2")
    middle = ranked.where(low | high).groupBy(key).agg(F.first("total").alias("n"), F.max(F.when(low, F.col(value))).alias("_low"), F.max(F.when(high, F.col(value))).alias("_high"))
    return middle.select(key, "n", (F.col("_low") / 2 + F.col("_high") / 2).alias("median"))


def quantile_limits(cells: DataFrame, key: str, value: str, bins: int) -> DataFrame:
    """(key, limits): the distinct values of a key if there are at most ``bins``; else those at the ranks (total - 1) * i / bins, rounded down."""
    ranked = ranked_values(cells, key, value).withColumn("_distinct", F.count("*").over(W.partitionBy(key)))
    # the first of the ranks total' * i / bins that isn't before a value is its own, or it has none
    ranked = ranked.withColumn("_i", F.expr(f"if(total > 1, greatest(1, (before * {bins} + total - 2) div (total - 1)), 1)"))
    at_cut = (F.col("_i") < bins) & F.expr(f"((total - 1) * _i) div {bins} < before + n")
    return ranked.where((F.col("_distinct") <= bins) | at_cut).groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("limits"), (F.max("_distinct") > bins).alias("cut"))
