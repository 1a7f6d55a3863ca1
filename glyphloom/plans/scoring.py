"""Queries that align and score references and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.functions.similarity import gestalt_ratio
from glyphloom.functions.text import collapse, normalise
from glyphloom.operators import scoring as ops
from glyphloom.plans.base import query
from glyphloom.sources.tables import table

# The candidates' keys are spoilt where the id is divisible by 3, so that both passes of the alignment have work.
SIDES = """r AS (SELECT benchmark_id AS id, video_id, slide_id, frame_index FROM benchmark_slides WHERE reference_text IS NOT NULL),
c AS (SELECT benchmark_id AS id, video_id, CASE WHEN benchmark_id % 3 = 0 THEN slide_id || '*' ELSE slide_id END AS slide_id, frame_index FROM benchmark_slides WHERE candidate_text IS NOT NULL)"""
ALIGNED = f"""{SIDES},
a1 AS (SELECT r.video_id, r.id AS rid, c.id AS cid, 'slide_id' AS method FROM (SELECT *, count(*) OVER (PARTITION BY video_id, slide_id) AS n FROM r WHERE slide_id IS NOT NULL) r
 JOIN (SELECT *, count(*) OVER (PARTITION BY video_id, slide_id) AS n FROM c WHERE slide_id IS NOT NULL) c ON r.video_id = c.video_id AND r.slide_id = c.slide_id WHERE r.n = 1 AND c.n = 1),
r2 AS (SELECT *, count(*) OVER (PARTITION BY video_id, frame_index) AS n FROM r WHERE frame_index IS NOT NULL AND id NOT IN (SELECT rid FROM a1)),
c2 AS (SELECT *, count(*) OVER (PARTITION BY video_id, frame_index) AS n FROM c WHERE frame_index IS NOT NULL AND id NOT IN (SELECT cid FROM a1)),
a2 AS (SELECT r2.video_id, r2.id AS rid, c2.id AS cid, 'frame_index' AS method FROM r2 JOIN c2 USING (video_id, frame_index) WHERE r2.n = 1 AND c2.n = 1),
m AS (SELECT * FROM a1 UNION ALL SELECT * FROM a2)"""
VERIFIED = r"v AS (SELECT benchmark_id, video_id, trim(regexp_replace(reference_text, '[\p{Z}\s]+', ' ', 'g')) AS r, trim(regexp_replace(candidate_text, '[\p{Z}\s]+', ' ', 'g')) AS c FROM benchmark_slides WHERE reference_text IS NOT NULL AND candidate_text IS NOT NULL)"
# DuckDB's distance counts bytes: each pair's characters get numbers of one byte first.
EDITED = rf"""{VERIFIED}, al AS (SELECT *, list_distinct(regexp_extract_all(r || c, '(?s).')) AS a FROM v),
s AS (SELECT *, length(r) AS n, levenshtein(array_to_string(list_transform(regexp_extract_all(r, '(?s).'), lambda x: chr(list_position(a, x)::INT)), ''), array_to_string(list_transform(regexp_extract_all(c, '(?s).'), lambda x: chr(list_position(a, x)::INT)), '')) AS e FROM al)"""


def slides(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark_slides", "benchmark_id", "video_id", "slide_id", "frame_index", "reference_text", "candidate_text")


def _verified(spark: SparkSession, folder: str) -> DataFrame:
    rows = slides(spark, folder).filter("reference_text IS NOT NULL AND candidate_text IS NOT NULL")
    return rows.select("benchmark_id", "video_id", collapse(F.col("reference_text")).alias("r"), collapse(F.col("candidate_text")).alias("c"))


def _edited(spark: SparkSession, folder: str) -> DataFrame:
    """Every verified pair with its length and distance in characters."""
    return _verified(spark, folder).withColumns({"n": F.length("r"), "e": F.levenshtein("r", "c")})


def _rates(edited: DataFrame) -> DataFrame:
    return edited.select("benchmark_id", F.col("e").cast("long").alias("errors"), F.round(F.when(F.col("n") > 0, F.col("e") / F.col("n")), 9).alias("cer"))


def _weighted(edited: DataFrame) -> DataFrame:
    rate = F.when(F.col("n") > 0, F.col("e") / F.col("n"))
    return edited.groupBy("video_id").agg(
        F.sum("e").alias("errors"), F.sum("n").alias("length"), F.round(F.try_divide(F.sum("e"), F.sum("n")), 9).alias("weighted_cer"), F.round(F.avg(rate), 9).alias("mean_cer")
    )


def _worst(edited: DataFrame) -> DataFrame:
    rows = edited.filter("n > 0").withColumn("rate", F.col("e") / F.col("n"))
    return rows.orderBy(F.desc_nulls_last("rate"), "benchmark_id").limit(5).select("benchmark_id", F.round("rate", 9).alias("cer"))


@query(
    f"""WITH {ALIGNED} SELECT video_id, rid AS reference_row, cid AS candidate_row, method FROM m
UNION ALL SELECT video_id, id, NULL, 'missing' FROM r WHERE id NOT IN (SELECT rid FROM m) UNION ALL SELECT video_id, NULL, id, 'unmatched' FROM c WHERE id NOT IN (SELECT cid FROM m)"""
)
def align_unique_keys(spark: SparkSession, folder: str) -> DataFrame:
    rows = slides(spark, folder).withColumnRenamed("benchmark_id", "id")
    spoilt = F.when(F.col("id") % 3 == 0, F.concat("slide_id", F.lit("*"))).otherwise(F.col("slide_id"))
    reference = rows.filter("reference_text IS NOT NULL").select("id", "video_id", "slide_id", "frame_index")
    candidate = rows.filter("candidate_text IS NOT NULL").select("id", "video_id", spoilt.alias("slide_id"), "frame_index")
    return ops.align(reference, candidate, ["video_id"], "id", "slide_id", "frame_index")


@query(
    """WITH a AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY benchmark_id) AS position, reference_text AS t FROM benchmark_slides WHERE reference_text IS NOT NULL),
b AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY benchmark_id) AS position, candidate_text AS t FROM benchmark_slides WHERE candidate_text IS NOT NULL)
SELECT video_id, position::INT AS position, coalesce(a.t, '') AS left_text, coalesce(b.t, '') AS right_text FROM a FULL JOIN b USING (video_id, position)"""
)
def positional_full_outer(spark: SparkSession, folder: str) -> DataFrame:
    rows = slides(spark, folder)
    side = lambda text: rows.filter(F.col(text).isNotNull()).select("video_id", "benchmark_id", F.col(text).alias("text"))
    return ops.positional(side("reference_text"), side("candidate_text"), ["video_id"], "benchmark_id", "text")


@query(f"WITH {EDITED} SELECT benchmark_id, e AS errors, round(CASE WHEN n > 0 THEN e / n END, 9) AS cer FROM s")
def char_error_rate(spark: SparkSession, folder: str) -> DataFrame:
    """The rate of every verified pair, whatever its script."""
    return _rates(_edited(spark, folder))


@query(f"WITH {EDITED} SELECT video_id, sum(e)::BIGINT AS errors, sum(n)::BIGINT AS length, round(sum(e) / nullif(sum(n), 0), 9) AS weighted_cer, round(avg(CASE WHEN n > 0 THEN e / n END), 9) AS mean_cer FROM s GROUP BY video_id")
def weighted_error_rate(spark: SparkSession, folder: str) -> DataFrame:
    """The rates of each video over all its verified pairs."""
    return _weighted(_edited(spark, folder))


@query(f"WITH {EDITED} SELECT benchmark_id, round(e / n, 9) AS cer FROM s WHERE n > 0 ORDER BY e / n DESC NULLS LAST, benchmark_id LIMIT 5")
def worst_slides_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five worst slides, as in the report."""
    return _worst(_edited(spark, folder))


WORD_NUMBERS = "list_transform(string_split({x}, ' '), lambda w: chr(list_position(a, w)::INT))"


@query(
    rf"""WITH {VERIFIED}, al AS (SELECT *, list_distinct(list_concat(string_split(r, ' '), string_split(c, ' '))) AS a, len(list_filter(string_split(r, ' '), lambda w: w <> '')) AS n FROM v),
s AS (SELECT *, levenshtein(array_to_string({WORD_NUMBERS.format(x='r')}, ''), array_to_string({WORD_NUMBERS.format(x='c')}, '')) AS e, len(a) AS kinds FROM al)
SELECT benchmark_id, e AS errors, n AS words, round(CASE WHEN n > 0 THEN e / n END, 9) AS wer FROM s WHERE r <> '' AND c <> ''"""
)
def word_error_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Word errors and their rate for every verified pair of texts that are not empty. The SQL numbers a pair's words by single characters."""
    rows = slides(spark, folder).filter("reference_text IS NOT NULL AND candidate_text IS NOT NULL")
    found = ops.scored(rows, "reference_text", "candidate_text").filter((collapse(F.col("reference_text")) != "") & (collapse(F.col("candidate_text")) != ""))
    return found.select("benchmark_id", F.col("words.errors").cast("long").alias("errors"), F.col("reference_words").cast("long").alias("words"), F.round("wer", 9).alias("wer"))


@query(
    f"WITH {VERIFIED}"
    + r""", o AS (SELECT b.benchmark_id, v.r, v.c, len(string_split(reference_text, chr(10))) AS rn, len(string_split(candidate_text, chr(10))) AS cn,
 regexp_replace(v.r, '\s+', '', 'g') = regexp_replace(v.c, '\s+', '', 'g') AS sp, lower(v.r) = lower(v.c) AS ca,
 trim(regexp_replace(regexp_replace(v.r, '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g')) = trim(regexp_replace(regexp_replace(v.c, '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g')) AS pu FROM v JOIN benchmark_slides b USING (benchmark_id))
SELECT benchmark_id, list_filter([CASE WHEN r <> c AND sp THEN 'spacing' END, CASE WHEN r <> c AND ca THEN 'capitalization' END, CASE WHEN r <> c AND pu THEN 'punctuation' END, CASE WHEN cn < rn THEN 'merged or missed' END,
 CASE WHEN cn > rn THEN 'split or false positive' END, CASE WHEN r <> c AND NOT sp AND NOT ca AND NOT pu AND cn = rn THEN 'text' END], lambda x: x IS NOT NULL) AS labels FROM o"""
)
def difference_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = slides(spark, folder).filter("reference_text IS NOT NULL AND candidate_text IS NOT NULL")
    return rows.select("benchmark_id", ops.difference_labels(F.col("reference_text"), F.col("candidate_text")).alias("labels"))


@query()
def edit_operation_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Substitutions, deletions and insertions by characters and words; rows only."""
    rows = slides(spark, folder).filter("reference_text IS NOT NULL AND candidate_text IS NOT NULL")
    return ops.scored(rows, "reference_text", "candidate_text").select("benchmark_id", "characters.*", F.col("words.errors").alias("word_errors"), "cer", "wer", "coverage", "exact")


@query()
def gestalt_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """The gestalt ratio of every verified pair; rows only, as matching blocks are found one inside the other."""
    rows = _verified(spark, folder).withColumns({"r": normalise(F.col("r")), "c": normalise(F.col("c"))})
    return rows.select("benchmark_id", gestalt_ratio("r", "c").alias("ratio"))


@query("SELECT verification_status, count(*) AS slides, count(reference_text) AS with_reference, count(*) FILTER (WHERE frame_index IS NULL) AS without_frame FROM benchmark_slides GROUP BY verification_status")
def status_progress(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "benchmark_slides", "verification_status", "reference_text", "frame_index")
    return rows.groupBy("verification_status").agg(F.count("*").alias("slides"), F.count("reference_text").alias("with_reference"), F.count_if(F.col("frame_index").isNull()).alias("without_frame"))


@query("SELECT video_id, slide_id, count(*) AS repeats FROM benchmark_slides GROUP BY video_id, slide_id HAVING count(*) > 1")
def duplicate_slide_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark_slides", "video_id", "slide_id").groupBy("video_id", "slide_id").agg(F.count("*").alias("repeats")).filter("repeats > 1")
