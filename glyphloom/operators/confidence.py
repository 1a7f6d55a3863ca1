"""Aggregates over recognition confidences and other measurements. Groups may be of any size: medians and quantiles come from counted values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.operators.order_stats import exact_median, value_counts

THRESHOLD = 0.6
#: Inclusive ranges of the distribution; values between two of them (such as 0.595) are in none.
BUCKETS = [(0.0, 0.59), (0.6, 0.69), (0.7, 0.79), (0.8, 0.89), (0.9, 0.94), (0.95, 1.0)]


def usable(regions: DataFrame, confidence: str = "confidence") -> DataFrame:
    """Regions whose confidence is a number from 0 to 1."""
    return regions.filter(F.col(confidence).between(0.0, 1.0) & ~F.isnan(confidence))


def confidence_stats(regions: DataFrame, keys: list[str], threshold: float = THRESHOLD, digits: int = 9) -> DataFrame:
    """Count, extremes, mean, median and the share below ``threshold`` per group. Nulls are not counted."""
    c = F.col("confidence")
    below = F.count_if(c < F.lit(threshold))
    stats = regions.filter(c.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("region_count"),
        F.min(c).alias("minimum"),
        F.max(c).alias("maximum"),
        F.round(F.avg(c), digits).alias("mean"),
        below.alias("below_threshold_count"),
        F.round(below / F.count("*"), digits).alias("below_threshold_proportion"),
    )
    return stats.join(exact_median(regions, keys, "confidence").withColumn("median", F.round("median", digits)), keys)


def with_empty(stats: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """``stats`` with a row for each of ``groups`` that has none: no regions, null values, and a share of 0 below the threshold."""
    return groups.select(*keys).distinct().join(stats, keys, "left").fillna(0, ["region_count", "below_threshold_count"]).fillna(0.0, ["below_threshold_proportion"])


def nearest_rank(counts: DataFrame, keys: list[str], value: str, at: list[float]) -> DataFrame:
    """``keys, q, value``: the value of 0-based rank (n - 1) q, rounded half to even, from counted values."""
    by = Window.partitionBy(*keys)
    upto, size = F.sum("n").over(by.orderBy(value)), F.sum("n").over(by)
    # The windows come first: in one select a generator would run before them and multiply their rows.
    ranked = counts.select(*keys, F.col(value).alias("value"), "n", upto.alias("_upto"), size.alias("_size")).withColumn("q", F.explode(F.array(*[F.lit(q) for q in at])))
    rank = F.bround((F.col("_size") - 1) * F.col("q"))
    return ranked.filter((F.col("_upto") > rank) & (F.col("_upto") - F.col("n") <= rank)).select(*keys, "q", "value")


def distribution(regions: DataFrame, keys: list[str], digits: int = 9) -> DataFrame:
    """Moments, nearest-rank quartiles and bucket counts per group."""
    c = F.col("confidence")
    rows = regions.filter(c.isNotNull())
    counted = [F.count_if(c.between(a, b)).alias(f"bucket_{k}") for k, (a, b) in enumerate(BUCKETS, 1)]
    base = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(c), digits).alias("mean"), F.min(c).alias("minimum"), F.max(c).alias("maximum"), F.round(F.stddev_pop(c), digits).alias("deviation"), *counted)
    ranks = nearest_rank(value_counts(rows, keys, "confidence"), keys, "confidence", [0.25, 0.75]).groupBy(*keys).agg(
        F.max(F.when(F.col("q") == 0.25, F.col("value"))).alias("lower_quartile"), F.max(F.when(F.col("q") == 0.75, F.col("value"))).alias("upper_quartile")
    )
    return base.join(exact_median(rows, keys, "confidence").withColumn("median", F.round("median", digits)), keys).join(ranks, keys)


def correlation(x: Column, y: Column) -> Column:
    """Pearson's coefficient; null for fewer than two pairs or where one side is constant."""
    varied = (F.count(x) >= 2) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varied, F.corr(x, y))


def measure_summary(runs: DataFrame, keys: list[str], metrics: list[str], digits: int = 9) -> DataFrame:
    """Minimum, median, mean, maximum and sample deviation (0 for one run) of each metric per group, in long form."""
    long = runs.unpivot(keys, [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value").filter(F.col("value").isNotNull())
    by = [*keys, "metric"]
    v = F.col("value")
    base = long.groupBy(*by).agg(
        F.count("*").alias("runs"), F.min(v).alias("minimum"), F.round(F.avg(v), digits).alias("mean"), F.max(v).alias("maximum"), F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), digits).alias("deviation")
    )
    return base.join(exact_median(long, by, "value").withColumn("median", F.round("median", digits)), by)


# The criteria of a variant, in order.
CRITERIA = ["aggregate CER", "aggregate WER", "more improved than worsened", "no severe nearly-perfect regression", "operational runtime", "not one-frame dependent"]


def decision_criteria(summary: DataFrame, variant: str, baseline: str) -> DataFrame:
    """``summary`` (``variant, cer, wer, improved, worsened, seconds``) with ``passed`` and ``failed``, the criteria of each variant against the baseline's row; the baseline itself has ``n/a``.

    Severe regressions are left to a person's look, so that this criterion always passes.
    """
    base = summary.filter(F.col(variant) == baseline).agg(F.max("cer").alias("_c"), F.max("wer").alias("_w"), F.max("seconds").alias("_s"))
    both = summary.join(F.broadcast(base))  # the baseline is one row
    holds = [F.col("cer") < F.col("_c"), F.col("wer") < F.col("_w"), F.col("improved") > F.col("worsened"), F.lit(True), F.col("seconds") <= F.col("_s") * 1.5, F.col("improved") > 1]
    own = F.col(variant) == baseline
    names = lambda good: F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(h, F.lit(False)) == good, F.lit(n)) for h, n in zip(holds, CRITERIA)])), "; ")
    return both.withColumns({"passed": F.when(own, "n/a").otherwise(names(F.lit(True))), "failed": F.when(own, "n/a").otherwise(names(F.lit(False)))}).drop("_c", "_w", "_s")
