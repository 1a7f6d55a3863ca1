"""Queries over confidences and other measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.operators import confidence as ops
from glyphloom.operators.order_stats import exact_median
from glyphloom.plans.base import LATEST_REGIONS, query
from glyphloom.sources.tables import latest, table

STATS = """count(*) AS region_count, min(confidence) AS minimum, max(confidence) AS maximum, round(avg(confidence), 9) AS mean, round(median(confidence), 9) AS median,
 count(*) FILTER (WHERE confidence < 0.6::DOUBLE) AS below_threshold_count, round(count(*) FILTER (WHERE confidence < 0.6::DOUBLE) / count(*), 9) AS below_threshold_proportion"""


def regions(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The last delivery of each region, with the columns that are needed."""
    return latest(table(spark, folder, "regions", "region_id", *columns, "ingested_at"), "region_id", "ingested_at").drop("ingested_at")


@query(f"WITH {LATEST_REGIONS} SELECT video_id, {STATS} FROM u GROUP BY video_id")
def doc_confidence_stats(spark: SparkSession, folder: str) -> DataFrame:
    return ops.confidence_stats(ops.usable(regions(spark, folder, "video_id", "confidence")), ["video_id"])


@query(
    f"""WITH {LATEST_REGIONS}, s AS (SELECT frame_id, {STATS} FROM u GROUP BY frame_id)
SELECT f.frame_id, coalesce(region_count, 0) AS region_count, minimum, maximum, mean, median, coalesce(below_threshold_count, 0) AS below_threshold_count,
 coalesce(below_threshold_proportion, 0.0) AS below_threshold_proportion FROM (SELECT DISTINCT frame_id FROM frames) f LEFT JOIN s USING (frame_id)"""
)
def frame_confidence_stats(spark: SparkSession, folder: str) -> DataFrame:
    stats = ops.confidence_stats(ops.usable(regions(spark, folder, "frame_id", "confidence")), ["frame_id"])
    return ops.with_empty(stats, table(spark, folder, "frames", "frame_id"), ["frame_id"])


@query(
    f"""WITH {LATEST_REGIONS},
o AS (SELECT engine, confidence, row_number() OVER (PARTITION BY engine ORDER BY confidence) - 1 AS rk, count(*) OVER (PARTITION BY engine) AS n FROM u),
q AS (SELECT engine, max(confidence) FILTER (WHERE rk = round_even((n - 1) * 0.25, 0)) AS lower_quartile, max(confidence) FILTER (WHERE rk = round_even((n - 1) * 0.75, 0)) AS upper_quartile FROM o GROUP BY engine)
SELECT u.engine, count(*) AS n, round(avg(confidence), 9) AS mean, min(confidence) AS minimum, max(confidence) AS maximum, round(stddev_pop(confidence), 9) AS deviation, round(median(confidence), 9) AS median,
 any_value(lower_quartile) AS lower_quartile, any_value(upper_quartile) AS upper_quartile,
 count(*) FILTER (WHERE confidence BETWEEN 0::DOUBLE AND 0.59::DOUBLE) AS bucket_1, count(*) FILTER (WHERE confidence BETWEEN 0.6::DOUBLE AND 0.69::DOUBLE) AS bucket_2,
 count(*) FILTER (WHERE confidence BETWEEN 0.7::DOUBLE AND 0.79::DOUBLE) AS bucket_3, count(*) FILTER (WHERE confidence BETWEEN 0.8::DOUBLE AND 0.89::DOUBLE) AS bucket_4,
 count(*) FILTER (WHERE confidence BETWEEN 0.9::DOUBLE AND 0.94::DOUBLE) AS bucket_5, count(*) FILTER (WHERE confidence BETWEEN 0.95::DOUBLE AND 1::DOUBLE) AS bucket_6
FROM u JOIN q ON u.engine = q.engine GROUP BY u.engine"""
)
def confidence_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return ops.distribution(ops.usable(regions(spark, folder, "engine", "confidence")).filter("engine IS NOT NULL"), ["engine"])


@query(
    f"""WITH {LATEST_REGIONS} SELECT engine, count(*) AS regions, count(*) FILTER (WHERE confidence < 0.8::DOUBLE) AS low, min(confidence) AS least, round(avg(confidence), 6) AS mean,
 count(DISTINCT frame_id) AS frames, count(DISTINCT frame_id) FILTER (WHERE confidence < 0.8::DOUBLE) AS frames_with_low FROM u GROUP BY engine"""
)
def diagnostic_confidence_summary(spark: SparkSession, folder: str) -> DataFrame:
    low = F.col("confidence") < 0.8
    rows = ops.usable(regions(spark, folder, "engine", "frame_id", "confidence"))
    return rows.groupBy("engine").agg(
        F.count("*").alias("regions"), F.count_if(low).alias("low"), F.min("confidence").alias("least"), F.round(F.avg("confidence"), 6).alias("mean"), F.countDistinct("frame_id").alias("frames"), F.countDistinct(F.when(low, F.col("frame_id"))).alias("frames_with_low")
    )


@query(f"WITH {LATEST_REGIONS} SELECT region_id, frame_id, confidence FROM l WHERE confidence >= 0.6::DOUBLE AND NOT isnan(confidence)")
def confidence_filter(spark: SparkSession, folder: str) -> DataFrame:
    return regions(spark, folder, "frame_id", "confidence").filter((F.col("confidence") >= 0.6) & ~F.isnan("confidence"))


@query(
    f"""WITH {LATEST_REGIONS}, t AS (SELECT engine, confidence, length(text)::DOUBLE AS n FROM u WHERE text IS NOT NULL)
SELECT engine, count(*) AS pairs, CASE WHEN count(*) >= 2 AND min(n) < max(n) AND min(confidence) < max(confidence) THEN round(corr(confidence, n), 6) END AS correlation FROM t GROUP BY engine"""
)
def confidence_correlation(spark: SparkSession, folder: str) -> DataFrame:
    rows = ops.usable(regions(spark, folder, "engine", "text", "confidence")).filter("text IS NOT NULL").withColumn("n", F.length("text").cast("double"))
    return rows.groupBy("engine").agg(F.count("*").alias("pairs"), F.round(ops.correlation(F.col("confidence"), F.col("n")), 6).alias("correlation"))


@query(
    f"""WITH {LATEST_REGIONS} SELECT count(DISTINCT f.frame_id) AS frame_count, count(DISTINCT u.frame_id) AS frames_with_regions, count(u.region_id) AS region_count, round(avg(u.confidence), 6) AS mean, round(median(u.confidence), 6) AS median
FROM (SELECT DISTINCT frame_id FROM frames) f LEFT JOIN u USING (frame_id)"""
)
def document_evidence(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "frames", "frame_id").distinct().join(ops.usable(regions(spark, folder, "frame_id", "confidence")), "frame_id", "left")
    joined = rows.withColumn("seen", F.when(F.col("region_id").isNotNull(), F.col("frame_id"))).withColumn("every", F.lit(1))
    stats = joined.groupBy("every").agg(F.countDistinct("frame_id").alias("frame_count"), F.countDistinct("seen").alias("frames_with_regions"), F.count("region_id").alias("region_count"), F.round(F.avg("confidence"), 6).alias("mean"))
    middle = exact_median(joined, ["every"], "confidence").withColumn("median", F.round("median", 6))
    return stats.join(middle, "every").drop("every")


METRICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    """WITH t AS (SELECT l_returnflag, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS metric, unnest([l_quantity, l_extendedprice, l_discount, l_tax]::DOUBLE[]) AS value FROM lineitem)
SELECT l_returnflag, metric, count(*) AS runs, min(value) AS minimum, round(avg(value), 4) AS mean, max(value) AS maximum, round(coalesce(stddev_samp(value), 0), 4) AS deviation, round(median(value), 4) AS median FROM t GROUP BY 1, 2"""
)
def performance_summary(spark: SparkSession, folder: str) -> DataFrame:
    return ops.measure_summary(table(spark, folder, "lineitem", "l_returnflag", *METRICS), ["l_returnflag"], METRICS, digits=4)


@query(
    """WITH p AS (SELECT DISTINCT promotion_id, reasons, confidence FROM promotion_records WHERE confidence IS NOT NULL),
c AS (SELECT unnest(reasons) AS category, confidence FROM p UNION ALL SELECT 'all', confidence FROM p)
SELECT category, count(*) AS records, round(avg(confidence), 6) AS mean, min(confidence) AS least, max(confidence) AS most FROM c GROUP BY category"""
)
def category_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    """Categories overlap, so the row over all is a union and no grouping set."""
    p = table(spark, folder, "promotion_records", "promotion_id", "reasons", "confidence").distinct().filter("confidence IS NOT NULL")
    rows = p.select(F.explode("reasons").alias("category"), "confidence").unionByName(p.select(F.lit("all").alias("category"), "confidence"))
    return rows.groupBy("category").agg(F.count("*").alias("records"), F.round(F.avg("confidence"), 6).alias("mean"), F.min("confidence").alias("least"), F.max("confidence").alias("most"))


@query(
    """WITH v AS (SELECT l_returnflag AS variant, count(*) AS images, count(*) FILTER (WHERE l_discount > 0.05::DOUBLE) AS improved, count(*) FILTER (WHERE l_discount < 0.05::DOUBLE) AS worsened, count(*) FILTER (WHERE l_discount = 0.05::DOUBLE) AS unchanged,
 round(median(l_tax), 6) AS median_rate, max(l_tax) AS worst_rate, sum(l_quantity) AS total FROM lineitem GROUP BY 1), b AS (SELECT total AS base FROM v WHERE variant = 'N')
SELECT variant, images, improved, worsened, unchanged, median_rate, worst_rate, round(total / base, 6) AS runtime_multiplier, improved > worsened AS more_improved, total <= 2 * base AS fast_enough FROM v, b"""
)
def variant_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Variants (here: return flags) against the baseline row, which is a single one."""
    rows = table(spark, folder, "lineitem", "l_returnflag", "l_discount", "l_tax", "l_quantity").withColumnRenamed("l_returnflag", "variant")
    d = F.col("l_discount")
    v = rows.groupBy("variant").agg(
        F.count("*").alias("images"), F.count_if(d > 0.05).alias("improved"), F.count_if(d < 0.05).alias("worsened"), F.count_if(d == 0.05).alias("unchanged"), F.max("l_tax").alias("worst_rate"), F.sum("l_quantity").alias("total")
    ).join(exact_median(rows, ["variant"], "l_tax").select("variant", F.round("median", 6).alias("median_rate")), "variant")
    base = v.filter("variant = 'N'").agg(F.max("total").alias("base"))
    both = v.join(F.broadcast(base))
    return both.select("variant", "images", "improved", "worsened", "unchanged", "median_rate", "worst_rate", F.round(F.col("total") / F.col("base"), 6).alias("runtime_multiplier"), (F.col("improved") > F.col("worsened")).alias("more_improved"), (F.col("total") <= 2 * F.col("base")).alias("fast_enough"))
