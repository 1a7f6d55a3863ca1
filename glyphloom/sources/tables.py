"""Reading the evidence tables and putting redelivered rows right."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One table of a dataset folder; give the columns that are needed so that the scan reads no others."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def latest(df: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row per ``key``: the delivery with the greatest ``order``, ties by the other columns; rows without a key are dropped.

    Empty tables give empty tables. Values that no order can tell apart are equal, so the choice never matters.
    """
    rest = [c for c in df.columns if c not in (key, order)]
    lead = [order] if order else []
    kept = F.max(F.struct(*lead, *rest)).alias("_kept")
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(kept).select(key, *[F.col("_kept")[c].alias(c) for c in lead + rest])
