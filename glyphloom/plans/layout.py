"""Queries over the geometry of regions and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphloom.operators import lines as ops
from glyphloom.plans.base import LATEST_REGIONS, query
from glyphloom.plans.confidence import regions
from glyphloom.sources.tables import table

BOXED = f"""{LATEST_REGIONS},
b AS (SELECT *, CASE WHEN len(box) = 4 AND box[1] <= box[3] AND box[2] <= box[4] THEN box END AS k FROM u),
x AS (SELECT region_id, frame_id, source_index, text, confidence, k[1] AS "left", k[2] AS top, k[3] AS "right", k[4] AS bottom FROM b WHERE confidence >= 0.6::DOUBLE)"""
LINES = """t AS (SELECT DISTINCT line_id, frame_id, line_index, text, line_left, line_right FROM text_lines WHERE text IS NOT NULL AND frame_id IS NOT NULL),
w AS (SELECT *, trim(text) AS s, lag(line_left) OVER o AS before, min(line_left) OVER (PARTITION BY frame_id) AS least, max(line_right) OVER (PARTITION BY frame_id) AS most, row_number() OVER o AS n FROM t WINDOW o AS (PARTITION BY frame_id ORDER BY line_index, line_id)),
k AS (SELECT *, CASE WHEN regexp_matches(s, '^[1-9][0-9]?\\.') THEN 'NUMBERED' WHEN s[1] IN ('•', '-', '*', '▪', '◦', '○') THEN 'BULLET' WHEN line_left - before BETWEEN -15 AND 60 THEN 'BODY'
 WHEN n = 1 AND (abs((line_left + line_right) / 2 - (least + most) / 2) < 40 OR length(s) < 60) THEN 'TITLE' ELSE 'BODY' END AS structure FROM w)""".replace("\\\\", "\\")


def _reading(spark: SparkSession, folder: str) -> DataFrame:
    rows = ops.with_box(regions(spark, folder, "frame_id", "source_index", "text", "confidence", "box"))
    return ops.reading_order(rows.filter(F.col("confidence").between(0, 1) & ~F.isnan("confidence"))).drop("box")


@query(f"WITH {BOXED} SELECT region_id, frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY top NULLS FIRST, \"left\" NULLS FIRST, source_index NULLS FIRST, region_id) AS reading_index FROM x")
def reading_order_sort(spark: SparkSession, folder: str) -> DataFrame:
    return _reading(spark, folder).select("region_id", "frame_id", "reading_index")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    own = table(spark, folder, "text_lines", "line_id", "frame_id", "line_index", "text", "line_left", "line_right").distinct().filter("text IS NOT NULL AND frame_id IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("frame_id").orderBy("line_index", "line_id"))
    return ops.structure(own.withColumn("place", place), "frame_id", "place")


@query(f"WITH {LINES} SELECT line_id, structure, CASE WHEN structure = 'BULLET' AND line_left - least > 40 THEN 1 ELSE 0 END AS indent, CASE WHEN structure = 'BULLET' AND line_left - least > 40 THEN 1 ELSE 0 END AS bullet FROM k")
def structure_flags(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).select("line_id", "structure", "indent", "bullet")


@query(
    f"""WITH {LINES}, p AS (SELECT *, sum(CASE WHEN structure IN ('TITLE', 'NUMBERED', 'BULLET') OR n = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY frame_id ORDER BY n) - 1 AS pi FROM k)
SELECT frame_id, pi::INT AS paragraph_index, first(structure ORDER BY n) AS text_type, count(*)::INT AS line_count, string_agg(CASE WHEN first_n = n THEN text ELSE trim(text) END, ' ' ORDER BY n) AS text
FROM (SELECT *, min(n) OVER (PARTITION BY frame_id, pi) AS first_n FROM p) GROUP BY frame_id, pi"""
)
def paragraph_grouping(spark: SparkSession, folder: str) -> DataFrame:
    return ops.paragraphs(_lines(spark, folder), "frame_id", "place")


@query(
    f"""WITH {BOXED}, y AS (SELECT *, floor(top / 40) AS band, trim(lower(regexp_replace(text, '\\s+', ' ', 'g'))) AS p FROM x WHERE top IS NOT NULL AND text IS NOT NULL AND frame_id IS NOT NULL),
j AS (SELECT a.region_id, b.region_id AS other, a.p AS sp, b.p AS lp, a."left" AS sl, a."right" AS sr, b."left" AS ll, b."right" AS lr,
 greatest(0, least(a."right", b."right") - greatest(a."left", b."left")) * greatest(0, least(a.bottom, b.bottom) - greatest(a.top, b.top)) / greatest(1, (a."right" - a."left") * (a.bottom - a.top)) AS cover
 FROM y a JOIN y b ON a.frame_id = b.frame_id AND a.band = b.band AND a.region_id <> b.region_id AND (a."right" - a."left") * (a.bottom - a.top) < (b."right" - b."left") * (b.bottom - b.top) WHERE a.p <> '' AND length(a.p) <= 12)
SELECT DISTINCT region_id FROM j WHERE cover >= 0.2::DOUBLE AND ((sr <= ll + greatest(1, lr - ll) * 0.25 AND starts_with(lp || ' ', sp || ' ')) OR (sl >= lr - greatest(1, lr - ll) * 0.25 AND suffix(' ' || lp, ' ' || sp)))""".replace("\\\\", "\\")
)
def region_overlap_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Small regions that repeat the edge of a larger one in their line. The SQL knows no lines and looks into bands of 40 px instead, so it misses pairs that straddle one."""
    return ops.reconstruct_lines(_reading(spark, folder)).filter("suppressed IS NOT NULL").select("region_id").distinct()


@query(
    f"""WITH {BOXED}, raw AS (SELECT region_id, frame_id, row_number() OVER (PARTITION BY frame_id, text, confidence, box ORDER BY region_id) AS k, text, confidence, box FROM u),
ord AS (SELECT x.region_id, x.frame_id, l.box, x.text, x.confidence, row_number() OVER (PARTITION BY x.frame_id ORDER BY x.top NULLS FIRST, x."left" NULLS FIRST, x.source_index NULLS FIRST, x.region_id) AS reading_index FROM x JOIN l USING (region_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY frame_id, text, confidence, box ORDER BY region_id) AS k FROM ord)
SELECT raw.region_id, rk.reading_index FROM raw LEFT JOIN rk ON raw.frame_id IS NOT DISTINCT FROM rk.frame_id AND raw.text IS NOT DISTINCT FROM rk.text AND raw.confidence = rk.confidence AND raw.box IS NOT DISTINCT FROM rk.box AND raw.k = rk.k"""
)
def reading_index_rank_match(spark: SparkSession, folder: str) -> DataFrame:
    """Raw regions matched to those in reading order by what they hold, the k-th of equal ones to the k-th."""
    raw = regions(spark, folder, "frame_id", "source_index", "text", "confidence", "box").filter(F.col("confidence").between(0, 1) & ~F.isnan("confidence"))
    ordered = ops.reading_order(ops.with_box(raw))
    mark = lambda df: df.withColumn("_key", F.xxhash64("frame_id", "text", "confidence", "box")).withColumn("_k", F.row_number().over(Window.partitionBy("_key").orderBy("region_id")))
    return mark(raw).select("region_id", "_key", "_k").join(mark(ordered).select("_key", "_k", F.col("reading_index")), ["_key", "_k"], "left").select("region_id", "reading_index")


@query(
    f"""WITH {BOXED} SELECT region_id, list_min([q[1] FOR q IN p]) AS "left", list_min([q[2] FOR q IN p]) AS top, list_max([q[1] FOR q IN p]) AS "right", list_max([q[2] FOR q IN p]) AS bottom
FROM (SELECT region_id, [["right", top], ["left", bottom], ["left", top + 1], ["right" - 1, bottom]] AS p FROM x WHERE top IS NOT NULL)"""
)
def quad_rectangle(spark: SparkSession, folder: str) -> DataFrame:
    rows = _reading(spark, folder).filter("top IS NOT NULL")
    points = F.array(F.array("right", "top"), F.array("left", "bottom"), F.array(F.col("left"), F.col("top") + 1), F.array(F.col("right") - 1, F.col("bottom")))
    return rows.withColumn("k", ops.enclosing_box(points)).select("region_id", *[F.col("k")[i].alias(n) for i, n in enumerate(["left", "top", "right", "bottom"])])


@query(
    f"""WITH {LATEST_REGIONS} SELECT region_id, CASE WHEN text IS NULL THEN 'no text' WHEN confidence IS NULL OR isnan(confidence) OR isinf(confidence) THEN 'confidence is not finite'
 WHEN box IS NULL OR len(box) <> 4 THEN 'box is not four numbers' WHEN box[1] > box[3] OR box[2] > box[4] THEN 'box is not ordered' END AS error FROM l"""
)
def region_validation(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with each region as an engine gave it; a row with an error stays a row."""
    rows = regions(spark, folder, "text", "confidence", "box")
    c, box = F.col("confidence"), F.col("box")
    at = lambda k: F.try_element_at(box, F.lit(k))
    error = (
        F.when(F.col("text").isNull(), "no text")
        .when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), "confidence is not finite")
        .when(box.isNull() | (F.size(box) != 4), "box is not four numbers")
        .when((at(1) > at(3)) | (at(2) > at(4)), "box is not ordered")
    )
    return rows.select("region_id", error.alias("error"))


@query()
def line_reconstruction(spark: SparkSession, folder: str) -> DataFrame:
    """Every region with its line; rows only, as lines grow with their members."""
    return ops.reconstruct_lines(_reading(spark, folder))


@query(
    f"""WITH {BOXED}, f AS (SELECT DISTINCT frame_id, max(width) AS width, max(height) AS height FROM frames GROUP BY frame_id),
c AS (SELECT frame_id, ("left" + "right") / 2 / width AS cx, (top + bottom) / 2 / height AS cy FROM x JOIN f USING (frame_id) WHERE top IS NOT NULL)
SELECT frame_id, count(*) AS regions, round(max(cx) - min(cx), 9) AS horizontal_span, round(max(cy) - min(cy), 9) AS vertical_span FROM c GROUP BY frame_id"""
)
def centre_spans(spark: SparkSession, folder: str) -> DataFrame:
    size = table(spark, folder, "frames", "frame_id", "width", "height").groupBy("frame_id").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    rows = _reading(spark, folder).filter("top IS NOT NULL").join(size, "frame_id")
    cx, cy = (F.col("left") + F.col("right")) / 2 / F.col("width"), (F.col("top") + F.col("bottom")) / 2 / F.col("height")
    span = lambda c: F.round(F.max(c) - F.min(c), 9)
    return rows.groupBy("frame_id").agg(F.count("*").alias("regions"), span(cx).alias("horizontal_span"), span(cy).alias("vertical_span"))
