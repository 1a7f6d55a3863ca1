"""Exact order statistics without holding a group in one task's memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, value, n``: equal values are counted before the shuffle; nulls are left out."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))


def middle_values(counts: DataFrame, keys: list[str], value: str, before: str | None = None, total: str | None = None) -> DataFrame:
    """``keys, median`` from value counts: the mean of the middle two values.

    ``counts`` may hold a slice of each group that contains its middle; then ``before`` names the column with the number of
    smaller values outside the slice and ``total`` that with the size of the whole group.
    """
    by = Window.partitionBy(*keys)
    upto = F.sum("n").over(by.orderBy(value)) + (F.col(before) if before else F.lit(0))
    size = F.col(total) if total else F.sum("n").over(by)
    ranked = counts.select(*keys, value, "n", upto.alias("_upto"), size.alias("_size"))
    low, high = F.floor((F.col("_size") + 1) / 2), F.floor(F.col("_size") / 2) + 1
    covers = lambda rank: (F.col("_upto") >= rank) & (F.col("_upto") - F.col("n") < rank)
    return (
        ranked.filter(covers(low) | covers(high))
        .groupBy(*keys)
        .agg(((F.max(F.when(covers(low), F.col(value))) + F.max(F.when(covers(high), F.col(value)))) / 2).alias("median"))
    )


def exact_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, median``: groups of any size, as only counts of distinct values are sorted (and may spill)."""
    return middle_values(value_counts(df, keys, value), keys, value)
