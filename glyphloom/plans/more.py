"""Queries for selections, fallbacks, plans and experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphloom.functions.text import collapse
from glyphloom.operators import images, visual
from glyphloom.plans.base import LATEST_REGIONS, query
from glyphloom.plans.confidence import regions
from glyphloom.plans.rules import RELATIONS
from glyphloom.plans.slides import FRAMES, runs
from glyphloom.sources.tables import latest, table


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, max(l_discount) AS l_discount, max(l_tax) AS l_tax FROM lineitem GROUP BY 1, 2), b AS (SELECT l_orderkey, l_discount AS d, l_tax AS t FROM r WHERE l_linenumber = 1)
SELECT r.l_orderkey, r.l_linenumber, CASE WHEN l_discount IS NULL OR l_tax IS NULL OR d IS NULL OR t IS NULL THEN 'unavailable' WHEN l_discount < d OR (l_discount = d AND l_tax < t) THEN 'improved' WHEN l_discount = d AND l_tax = t THEN 'unchanged' ELSE 'worsened' END AS comparison
FROM r LEFT JOIN b USING (l_orderkey)"""
)
def comparison_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Two rates of each order's lines (variants) against those of its first line, in lexicographic order."""
    rows = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_discount", "l_tax").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_discount").alias("l_discount"), F.max("l_tax").alias("l_tax"))
    return images.compared(rows, "l_orderkey", "l_linenumber", ["l_discount", "l_tax"], 1).select("l_orderkey", "l_linenumber", "comparison")


@query(f"WITH {FRAMES}, k AS (SELECT *, row_number() OVER (PARTITION BY video_id, slide_number ORDER BY frame_number DESC, frame_id DESC) AS back FROM b) SELECT video_id, slide_number::BIGINT AS slide_number, build_index::BIGINT AS build_index, frame_id FROM k WHERE back = 1")
def slide_targets(spark: SparkSession, folder: str) -> DataFrame:
    """The last frame of each slide, which shows it whole."""
    back = F.row_number().over(Window.partitionBy("video_id", "slide_number").orderBy(F.desc("place")))
    return runs(spark, folder).withColumn("back", back).filter("back = 1").select("video_id", "slide_number", "build_index", "frame_id")


@query(
    """WITH o AS (SELECT frame_id, combined_text, ingested_at, row_number() OVER (PARTITION BY frame_id ORDER BY ingested_at NULLS FIRST) AS k FROM frames)
SELECT CASE WHEN combined_text IS NULL OR trim(combined_text) = '' THEN 'invalid' WHEN k = 1 THEN 'valid' ELSE 'duplicate' END AS kind, count(*) AS deliveries, count(DISTINCT frame_id) AS frames FROM o GROUP BY 1"""
)
def delivery_partition(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries without text are invalid, the first of each frame is valid, all later ones are duplicates."""
    rows = table(spark, folder, "frames", "frame_id", "combined_text", "ingested_at")
    k = F.row_number().over(Window.partitionBy("frame_id").orderBy(F.asc_nulls_first("ingested_at")))
    blank = F.col("combined_text").isNull() | (F.trim("combined_text") == "")
    kind = F.when(blank, "invalid").when(F.col("k") == 1, "valid").otherwise("duplicate")
    return rows.withColumn("k", k).groupBy(kind.alias("kind")).agg(F.count("*").alias("deliveries"), F.countDistinct("frame_id").alias("frames"))


@query(
    """WITH f AS (SELECT frame_id, max(width) * 2 AS w, max(height) * 2 AS h FROM frames GROUP BY frame_id), s AS (SELECT *, least(1.0::DOUBLE, 1536.0::DOUBLE / greatest(w, h)) AS k FROM f)
SELECT frame_id, greatest(1, round_even(w * k, 0)::INT) AS width, greatest(1, round_even(h * k, 0)::INT) AS height FROM s"""
)
def bounded_dimensions(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of frames at twice their scale, bounded for sending."""
    f = table(spark, folder, "frames", "frame_id", "width", "height").groupBy("frame_id").agg((F.max("width") * 2).alias("w"), (F.max("height") * 2).alias("h"))
    w, h = images.bounded_size(F.col("w"), F.col("h"))
    return f.select("frame_id", w.alias("width"), h.alias("height"))


@query(
    r"""WITH f AS (SELECT frame_id, max_by(struct_pack(t := combined_text), ingested_at) AS k FROM frames WHERE frame_id IS NOT NULL GROUP BY frame_id),
l AS (SELECT frame_id, string_agg(trim(text), ' ' ORDER BY line_index, line_id) AS t FROM (SELECT DISTINCT line_id, frame_id, line_index, text FROM text_lines WHERE text IS NOT NULL AND trim(text) <> '') GROUP BY frame_id)
SELECT f.frame_id, coalesce(CASE WHEN trim(k.t) <> '' THEN k.t END, l.t, '') AS text FROM f LEFT JOIN l USING (frame_id)"""
)
def text_with_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Each frame's text; where it has none, that of its lines in order."""
    f = latest(table(spark, folder, "frames", "frame_id", "combined_text", "ingested_at"), "frame_id", "ingested_at")
    lines = table(spark, folder, "text_lines", "line_id", "frame_id", "line_index", "text").distinct().filter("text IS NOT NULL AND trim(text) <> ''")
    joined = lines.groupBy("frame_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_index", "line_id", F.trim("text").alias("t")))), lambda x: x["t"]), " ").alias("t"))
    own = F.when(F.trim("combined_text") != "", F.col("combined_text"))
    return f.join(joined, "frame_id", "left").select("frame_id", F.coalesce(own, "t", F.lit("")).alias("text"))


@query(f"WITH {RELATIONS}, s AS (SELECT len(list_filter(need, lambda x: list_contains(got, x))) AS r, len(list_filter(need, lambda x: NOT list_contains(got, x))) AS m, len(list_filter(got, lambda x: NOT list_contains(need, x) AND NOT list_contains(may, x))) AS u, len(need) AS n FROM c) SELECT count(*) AS cases, sum(n)::BIGINT AS required, sum(r)::BIGINT AS recovered, sum(m)::BIGINT AS missed, sum(u)::BIGINT AS unsupported, count(*) FILTER (WHERE m = 0 AND u = 0) AS complete FROM s")
def evaluation_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    rows = latest(table(spark, folder, "frames", "frame_id", "shared_lines", "added_lines", "removed_lines", "ingested_at"), "frame_id", "ingested_at")
    found = visual.relation_recall(F.col("added_lines"), F.col("shared_lines"), F.col("removed_lines"))
    s = rows.select(*[F.size(c).alias(n) for n, c in found.items()])
    total = lambda n: F.sum(n).cast("long")
    return s.agg(F.count("*").alias("cases"), total(F.col("recovered") + F.col("missed")).alias("required"), total("recovered").alias("recovered"), total("missed").alias("missed"), total("unsupported").alias("unsupported"), F.count_if((F.col("missed") == 0) & (F.col("unsupported") == 0)).alias("complete"))


@query(
    rf"""WITH {LATEST_REGIONS} SELECT engine, count(*) AS regions, sum(length(coalesce(text, '')))::BIGINT AS characters,
 sum(len(list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '[\p{{Z}}\s]+', ' ', 'g')), ' '), lambda x: x <> '')))::BIGINT AS words, count(DISTINCT video_id) AS videos FROM l GROUP BY engine"""
)
def engine_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = regions(spark, folder, "engine", "video_id", "text").withColumn("t", F.coalesce("text", F.lit("")))
    words = F.size(F.filter(F.split(collapse(F.col("t")), " "), lambda w: w != ""))
    return rows.groupBy("engine").agg(F.count("*").alias("regions"), F.sum(F.length("t")).alias("characters"), F.sum(words).alias("words"), F.countDistinct("video_id").alias("videos"))


@query(
    """WITH i AS (SELECT export_kind AS item, row_number() OVER (ORDER BY export_kind) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT export_kind FROM documents WHERE export_kind IS NOT NULL)), l AS (SELECT unnest(['de', 'fr', 'es']) AS language, unnest([0, 1, 2]) AS k),
g AS (SELECT unnest(['by_language', 'by_source', 'combined', 'individual']) AS grouping_name)
SELECT grouping_name, 'job:workbook:' || CASE grouping_name WHEN 'by_language' THEN 'language:' || language WHEN 'by_source' THEN 'source:' || item WHEN 'combined' THEN 'combined' ELSE 'source:' || item || ':language:' || language END AS workbook_id,
 'job:sheet:' || item || ':' || language AS sheet_id, CASE WHEN grouping_name = 'by_language' THEN k * n + p ELSE p * 3 + k END AS sheet_order FROM i, l, g"""
)
def planned_sheets(spark: SparkSession, folder: str) -> DataFrame:
    """The sheets of each kind of export and language, in the workbooks of every grouping."""
    from functools import reduce

    from glyphloom.operators.sequential import numbered
    from glyphloom.operators.translation import GROUPINGS, planned_workbooks

    items = numbered(table(spark, folder, "documents", "export_kind").filter("export_kind IS NOT NULL").distinct(), ["export_kind"]).withColumn("place", F.col("place") - 1)
    plans = [planned_workbooks(items, ["de", "fr", "es"], g, "job", "export_kind").withColumn("grouping_name", F.lit(g)) for g in GROUPINGS]
    return reduce(DataFrame.unionByName, plans).select("grouping_name", "workbook_id", "sheet_id", "sheet_order")


@query(
    """WITH f AS (SELECT frame_id, max_by(struct_pack(v := video_id, n := frame_number), ingested_at) AS k FROM frames WHERE frame_id IS NOT NULL GROUP BY frame_id), q AS (SELECT frame_id, concat_ws(':', k.v, 'slide', (frame_id % 9)::VARCHAR, 'build', coalesce(CASE WHEN frame_id % 4 > 0 THEN frame_id % 4 END::VARCHAR, 'none'), 'frame', k.n::VARCHAR) AS id FROM f)
SELECT frame_id, id AS request_id, 'evidence/' || sha256(id) || '.png' AS evidence FROM q"""
)
def visual_requests(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of requests about frames, and where their evidence is kept (slides and builds by the frame's id)."""
    from glyphloom.functions.text import evidence_path, visual_request_id

    rows = latest(table(spark, folder, "frames", "frame_id", "video_id", "frame_number", "ingested_at"), "frame_id", "ingested_at")
    build = F.when(F.col("frame_id") % 4 > 0, F.col("frame_id") % 4)
    named = rows.withColumn("request_id", visual_request_id(F.col("video_id"), F.col("frame_id") % 9, build, F.col("frame_number")))
    return named.select("frame_id", "request_id", evidence_path(F.col("request_id")).alias("evidence"))


@query()
def structure_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Edges and straight lines of each image (here: embeddings as images of eight columns); rows only, checked by hand in the tests."""
    pixels = F.transform("embedding", lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.round(x * 100 + 128).cast("int"))))
    rows = table(spark, folder, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("width"), pixels.alias("pixels"), F.lit(None).cast("array<array<double>>").alias("boxes"))
    return images.structure_evidence(rows)


@query()
def preprocessing_experiment(spark: SparkSession, folder: str) -> DataFrame:
    """A measure of each variant of each image (here: embeddings as images of eight columns); rows only, checked by hand in the tests."""
    pixels = F.transform("embedding", lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.round(x * 100 + 128).cast("int"))))
    rows = table(spark, folder, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("width"), pixels.alias("pixels"))
    return images.experiment(rows, lambda a: a.mean())
