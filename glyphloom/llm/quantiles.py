"""Percentiles with a guaranteed relative error from counts in logarithmic buckets.

A value v goes to bucket ceil(log_g |v|) of its sign, g = (1 + a) / (1 - a); zero has its own bucket. A bucket's middle,
2 g^i / (g + 1), is within a relative error a of every value in it. Sketches are plain rows, so those of separate
partitions, days or engines are combined by adding the counts of equal buckets; the bound does not change by that.

Nulls, NaN and infinities are not counted. Groups without a counted value have no rows. Repeated rows count as often as they occur.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.operators.order_stats import middle_values, value_counts
from glyphloom.sources.tables import latest

#: Relative error of every reported percentile.
ALPHA = 0.001
#: Larger than the number of any bucket of a double at any sensible error.
SHIFT = 1 << 40
#: How far a stored median may be from the exact one; the rest is room for binary fractions.
TOLERANCE = 0.01
SLACK = 1e-9


def _gamma(alpha: float) -> float:
    if not 0 < alpha < 1:
        raise ValueError("the relative error must lie between 0 and 1")
    return (1 + alpha) / (1 - alpha)


def bucket(value: Column, alpha: float = ALPHA) -> Column:
    """The signed bucket number of a double: it grows with the value, 0 holds only zero; null where the value is not finite."""
    g = math.log(_gamma(alpha))
    size = F.ceil(F.log(F.abs(value)) / F.lit(g)) + F.lit(SHIFT)
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return F.when(finite, F.when(value == 0, F.lit(0).cast("long")).when(value > 0, size).otherwise(-size))


def _bound(b: Column, alpha: float, at: float) -> Column:
    """A value of bucket ``b``: its lower edge in size (at=-1), its upper edge (0) or its middle."""
    g = _gamma(alpha)
    size = F.pow(F.lit(g), F.abs(b) - F.lit(SHIFT) + F.lit(min(at, 0.0))) * F.lit(2 / (g + 1) if at > 0 else 1.0)
    return F.when(b == 0, F.lit(0.0)).otherwise(F.signum(b.cast("double")) * size)


def sketch(df: DataFrame, keys: list[str], value: str, alpha: float = ALPHA) -> DataFrame:
    """``keys, bucket, n``; counting starts before the shuffle, so a hot group sends one row per bucket and task."""
    return df.withColumn("bucket", bucket(F.col(value).cast("double"), alpha)).filter("bucket IS NOT NULL").groupBy(*keys, "bucket").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Combine sketches of finer groups (days, partitions, engines) to one per ``keys``."""
    return sketches.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def _ranked(sketches: DataFrame, keys: list[str]) -> DataFrame:
    by = Window.partitionBy(*keys)
    return sketches.select(*keys, "bucket", "n", F.sum("n").over(by.orderBy("bucket")).alias("_upto"), F.sum("n").over(by).alias("_size"))


def percentiles(sketches: DataFrame, keys: list[str], at: list[float], alpha: float = ALPHA) -> DataFrame:
    """``keys, q, n, estimate, least, most``: the value of rank floor(q (n - 1)) lies between ``least`` and ``most``."""
    if any(not 0 <= q <= 1 for q in at):
        raise ValueError("percentiles are given as fractions from 0 to 1")
    each = _ranked(sketches, keys).withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in at])))
    rank = F.floor(F.col("q") * (F.col("_size") - 1)) + 1
    b = F.col("bucket")
    edges = [_bound(b, alpha, -1.0), _bound(b, alpha, 0.0)]
    return each.filter((F.col("_upto") >= rank) & (F.col("_upto") - F.col("n") < rank)).select(
        *keys, "q", F.col("_size").alias("n"), _bound(b, alpha, 1.0).alias("estimate"), F.least(*edges).alias("least"), F.greatest(*edges).alias("most")
    )


def median_range(sketches: DataFrame, keys: list[str], alpha: float = ALPHA) -> DataFrame:
    """``keys, n, low_bucket, high_bucket, before, least, most``: where the mean of the middle two values must lie,
    the buckets of those two, and the number of values in lower buckets."""
    low, high = F.floor((F.col("_size") + 1) / 2), F.floor(F.col("_size") / 2) + 1
    holds = lambda rank: (F.col("_upto") >= rank) & (F.col("_upto") - F.col("n") < rank)
    found = (
        _ranked(sketches, keys)
        .filter(holds(low) | holds(high))
        .groupBy(*keys)
        .agg(
            F.max("_size").alias("n"),
            F.max(F.when(holds(low), F.col("bucket"))).alias("low_bucket"),
            F.max(F.when(holds(high), F.col("bucket"))).alias("high_bucket"),
            F.max(F.when(holds(low), F.col("_upto") - F.col("n"))).alias("before"),
        )
    )
    lo, hi = F.col("low_bucket"), F.col("high_bucket")
    edge = lambda b, pick: pick(_bound(b, alpha, -1.0), _bound(b, alpha, 0.0))
    return found.withColumn("least", (edge(lo, F.least) + edge(hi, F.least)) / 2).withColumn("most", (edge(lo, F.greatest) + edge(hi, F.greatest)) / 2)


def usable(regions: DataFrame) -> DataFrame:
    """Each region's last delivery, if its confidence is a number from 0 to 1."""
    columns = ["region_id", "video_id", "run_id", "engine", "confidence", "ingested_at"]
    return latest(regions.select(*columns), "region_id", "ingested_at").filter(F.col("confidence").between(0.0, 1.0) & ~F.isnan("confidence"))


def wrong_medians(regions: DataFrame, stats: DataFrame, alpha: float = ALPHA, tolerance: float = TOLERANCE) -> DataFrame:
    """``stats_id, median, exact_low, exact_high``: stored medians that are null or off by more than ``tolerance``.

    The sketch decides wherever its guaranteed range allows; where the range straddles the tolerance, the exact median is
    taken from the values of the one or two buckets that hold the middle, counted by value. Runs without usable values
    give no row, nor do stats whose run is unknown or null. Repeated stats rows count once.
    """
    keys = ["video_id", "run_id"]
    rows = usable(regions)
    partial = sketch(rows.withColumn("arrived", F.to_date("ingested_at")), [*keys, "engine", "arrived"], "confidence", alpha)
    ranges = median_range(merge(partial, keys), keys, alpha)
    stored = stats.select("stats_id", *keys, F.col("median").alias("stored")).distinct()
    judged = stored.join(ranges, keys)
    missing = F.col("stored").isNull() | F.isnan("stored")
    far = F.greatest(F.abs(F.col("stored") - F.col("least")), F.abs(F.col("stored") - F.col("most")))
    near = F.when(F.col("stored").between(F.col("least"), F.col("most")), F.lit(0.0)).otherwise(F.least(F.abs(F.col("stored") - F.col("least")), F.abs(F.col("stored") - F.col("most"))))
    sure = missing | (near > F.lit(tolerance + SLACK))
    open_ = ~missing & (near <= F.lit(tolerance + SLACK)) & (far > F.lit(tolerance))
    slices = judged.filter(open_).select(*keys, "low_bucket", "high_bucket", "before", F.col("n").alias("total")).distinct()
    inside = rows.withColumn("bucket", bucket(F.col("confidence"), alpha)).join(slices, keys).filter(F.col("bucket").between(F.col("low_bucket"), F.col("high_bucket")))
    exact = middle_values(value_counts(inside, [*keys, "before", "total"], "confidence"), [*keys, "before", "total"], "confidence", "before", "total").drop("before", "total")
    checked = judged.filter(open_).join(exact, keys).filter(F.abs(F.col("stored") - F.col("median")) > F.lit(tolerance + SLACK))
    return judged.filter(sure).select("stats_id", F.col("stored").alias("median"), F.col("least").alias("exact_low"), F.col("most").alias("exact_high")).unionByName(
        checked.select("stats_id", F.col("stored").alias("median"), F.col("median").alias("exact_low"), F.col("median").alias("exact_high"))
    )
