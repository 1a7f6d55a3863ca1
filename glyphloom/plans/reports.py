"""Queries for what exports and reports show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.functions.text import byte_size, duration, row_height, safe_name
from glyphloom.operators import exports as ops
from glyphloom.plans.base import LATEST_REGIONS, query
from glyphloom.plans.confidence import regions
from glyphloom.sources.tables import latest, table

PARAGRAPHS = "p AS (SELECT DISTINCT paragraph_id, video_id, frame_number, paragraph_index, text, text_type FROM paragraphs)"


def paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "paragraphs", "paragraph_id", "video_id", "frame_number", "paragraph_index", "text", "text_type").distinct()


@query(f"WITH {PARAGRAPHS} SELECT frame_number AS \"Slide Number\", upper(text_type) AS \"Paragraph Type\", text AS \"Paragraph Text\" FROM p WHERE trim(coalesce(text, '')) <> ''")
def csv_export_rows(spark: SparkSession, folder: str) -> DataFrame:
    return ops.csv_rows(paragraphs(spark, folder), "frame_number", "text_type", "text")


MARK = "CASE upper(text_type) WHEN 'TITLE' THEN '## ' || text WHEN 'BULLET' THEN '- ' || text ELSE text END"


@query(f"WITH {PARAGRAPHS} SELECT paragraph_id, {MARK} AS line FROM p WHERE trim(coalesce(text, '')) <> ''")
def markdown_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = paragraphs(spark, folder).filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    return rows.select("paragraph_id", ops.markdown_line(F.col("text_type"), F.col("text")).alias("line"))


@query(
    f"""WITH {PARAGRAPHS}, s AS (SELECT video_id, frame_number, '# Slide ' || frame_number || chr(10) || chr(10) || string_agg({MARK}, chr(10) || chr(10) ORDER BY paragraph_index, paragraph_id) AS part
 FROM p WHERE trim(coalesce(text, '')) <> '' GROUP BY video_id, frame_number) SELECT video_id, string_agg(part, chr(10) || chr(10) ORDER BY frame_number) AS markdown FROM s GROUP BY video_id"""
)
def markdown_documents(spark: SparkSession, folder: str) -> DataFrame:
    return ops.markdown_documents(paragraphs(spark, folder), "video_id", "frame_number", ["paragraph_index", "paragraph_id"], "text_type", "text")


@query(f"WITH {PARAGRAPHS} SELECT paragraph_id, least(300, greatest(15, 15 * list_sum(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: greatest(1, ceil(length(x) / 60))))))::BIGINT AS height FROM p")
def row_height_estimate(spark: SparkSession, folder: str) -> DataFrame:
    return paragraphs(spark, folder).select("paragraph_id", row_height(F.col("text")).cast("long").alias("height"))


@query("WITH f AS (SELECT frame_id, max(frame_number) AS n, max(timestamp_seconds) AS s FROM frames GROUP BY frame_id) SELECT frame_id, format('frame_{:06d}_', n) || printf('%.2f', floor(s)) || 's.png' AS file FROM f")
def frame_file_names(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "frames", "frame_id", "frame_number", "timestamp_seconds").groupBy("frame_id").agg(F.max("frame_number").alias("n"), F.max("timestamp_seconds").alias("s"))
    return rows.select("frame_id", ops.frame_file(F.col("n"), F.floor("s").cast("double")).alias("file"))


@query(
    """WITH t AS (SELECT stats_id, unnest(['minimum', 'maximum', 'mean', 'median']) AS metric, unnest([minimum, maximum, mean, median]) AS value FROM confidence_stats) SELECT stats_id, metric, value FROM t"""
)
def long_report(spark: SparkSession, folder: str) -> DataFrame:
    return ops.long_report(table(spark, folder, "confidence_stats", "stats_id", "minimum", "maximum", "mean", "median"), ["stats_id"], ["minimum", "maximum", "mean", "median"])


@query(
    f"""WITH {LATEST_REGIONS}, o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY region_id) AS place FROM l WHERE video_id IS NOT NULL)
SELECT region_id, place, left(text, 40) AS shown, length(text) > 40 AS cut FROM o WHERE place <= 50"""
)
def prompt_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """The first fifty regions of each video, their texts cut to forty characters: the bound of a prompt."""
    rows = regions(spark, folder, "video_id", "text").filter("video_id IS NOT NULL")
    return ops.top_bounded(rows, "video_id", ["region_id"], "text", 50, 40).select("region_id", F.col("place").cast("long").alias("place"), "shown", "cut")


@query(
    r"""SELECT doc_id, CASE WHEN c = '' THEN 'Untitled' WHEN upper(c) IN ('CON', 'PRN', 'AUX', 'NUL', 'COM1', 'LPT1') THEN c || ' file' ELSE c END AS name FROM (SELECT doc_id, regexp_replace(left(regexp_replace(trim(regexp_replace(regexp_replace(coalesce(source, '') || '/' || coalesce(export_kind, '') || '?' || doc_id, '[<>:"/\\|?*\[\]\x00-\x1f]+', ' ', 'g'), '\s+', ' ', 'g')), '^[ .'']+|[ .'']+$', '', 'g'), 31), '[ .]+$', '') AS c FROM documents)"""
)
def name_sanitise(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("export_kind", F.lit("")), F.lit("?"), F.col("doc_id").cast("string"))
    return table(spark, folder, "documents", "doc_id", "source", "export_kind").select("doc_id", safe_name(raw).alias("name"))


@query(
    """SELECT frame_id, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS duration
FROM (SELECT frame_id, floor(max(timestamp_seconds) * 20)::BIGINT AS s FROM frames GROUP BY frame_id)"""
)
def format_durations(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "frames", "frame_id", "timestamp_seconds").groupBy("frame_id").agg(F.max("timestamp_seconds").alias("s"))
    return rows.select("frame_id", duration(F.floor(F.col("s") * 20)).alias("duration"))


@query("SELECT doc_id, CASE WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0::DOUBLE) WHEN n >= 1024 THEN printf('%.1f KB', n / 1024.0::DOUBLE) ELSE printf('%d B', n) END AS size FROM (SELECT doc_id, n_chars AS n FROM documents WHERE n_chars IS NOT NULL)")
def format_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "n_chars").filter("n_chars IS NOT NULL").select("doc_id", byte_size(F.col("n_chars")).alias("size"))


@query("SELECT stats_id, CASE WHEN isnan(median) OR isinf(median) OR median IS NULL THEN '' ELSE 'value' END AS shown, coalesce(nullif(region_count, 0), -1) AS regions FROM confidence_stats")
def export_values(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers that are not finite are shown as nothing."""
    m = F.col("median")
    shown = F.when(m.isNull() | F.isnan(m) | (F.abs(m) == float("inf")), "").otherwise("value")
    return table(spark, folder, "confidence_stats", "stats_id", "median", "region_count").select("stats_id", shown.alias("shown"), F.coalesce(F.nullif(F.col("region_count"), F.lit(0)), F.lit(-1)).alias("regions"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def content_digest(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "text").filter("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("digest"))


@query(
    """WITH t AS (SELECT row_number() OVER (ORDER BY mix_id, source) - 1 AS place, split_part(source, '.', 1) AS s FROM mix_targets WHERE source IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY lower(s) ORDER BY place) AS k FROM t)
SELECT place::INT AS place, CASE WHEN k = 1 THEN left(s, 31) ELSE left(s, 27) || ' (' || k || ')' END AS sheet FROM k"""
)
def workbook_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Sheet names for the sources of the fixed mix table, in order: a driver-side plan of a few dozen names. (The SQL knows names that occur up to nine times, and no clash of a cut name with another.)"""
    from glyphloom.operators.translation import planned_names

    names = [r[0] for r in table(spark, folder, "mix_targets", "mix_id", "source").filter("source IS NOT NULL").orderBy("mix_id", "source").select(safe_name(F.split_part("source", F.lit("."), F.lit(1)))).collect()]
    return spark.createDataFrame(list(enumerate(planned_names(names))), "place int, sheet string")


@query(
    """WITH f AS (SELECT frame_id, max_by(struct_pack(v := video_id, d := difference_score), ingested_at) AS k FROM frames GROUP BY frame_id), s AS (SELECT frame_id, k.v AS video_id, k.d AS score FROM f WHERE k.d IS NOT NULL AND NOT isnan(k.d))
SELECT video_id, min_by(frame_id, struct_pack(a := score, b := frame_id)) AS calmest, max_by(frame_id, struct_pack(a := score, b := frame_id)) AS liveliest FROM s GROUP BY video_id"""
)
def extremes_by_group(spark: SparkSession, folder: str) -> DataFrame:
    """The frames of least and most difference of each video, ties by id."""
    rows = latest(table(spark, folder, "frames", "frame_id", "video_id", "difference_score", "ingested_at"), "frame_id", "ingested_at").filter("difference_score IS NOT NULL AND NOT isnan(difference_score)")
    order = F.struct("difference_score", "frame_id")
    return rows.groupBy("video_id").agg(F.min_by("frame_id", order).alias("calmest"), F.max_by("frame_id", order).alias("liveliest"))
