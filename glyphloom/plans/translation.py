"""Queries over translation requests and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.functions.text import language_code, language_name, numeric_tokens
from glyphloom.operators import sequential
from glyphloom.operators import translation as ops
from glyphloom.plans.base import query
from glyphloom.sources.tables import table

LANGUAGES = ["de", "fr", "es"]
ROWS = "w AS (SELECT DISTINCT row_id, source_item_id, source_reference, request_id, source_language, target_language, slide_value, original_text, ordering_index FROM workbook_rows)"
NUMBERS = r"list_transform(regexp_extract_all(t, '(?:^|[^\p{L}\p{N}_.])(\d+(?:[.,]\d+)?)', 1), lambda x: replace(x, ',', '.'))"


def workbook(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the workbook, redeliveries once."""
    return table(spark, folder, "workbook_rows").distinct()


@query(
    f"""WITH {ROWS}, l AS (SELECT unnest([0, 1, 2]) AS language_order, unnest(['de', 'fr', 'es']) AS target)
SELECT source_item_id || ':translation:' || target AS request_id, target AS target_language, language_order, ordering_index, original_text AS source_text FROM w, l WHERE original_text IS NOT NULL AND trim(original_text) <> ''"""
)
def translation_requests(spark: SparkSession, folder: str) -> DataFrame:
    records = workbook(spark, folder).select("source_item_id", "ordering_index", F.col("original_text").alias("source_text"))
    return ops.requests(records, LANGUAGES, "source_item_id").select("request_id", "target_language", "language_order", "ordering_index", "source_text")


@query(
    """WITH b AS (SELECT benchmark_id, CASE WHEN reference_text IS NOT NULL AND trim(reference_text) <> '' THEN reference_text WHEN benchmark_id % 2 = 0 AND notes IS NOT NULL AND trim(notes) <> '' THEN notes
 WHEN candidate_text IS NOT NULL AND trim(candidate_text) <> '' THEN candidate_text END AS source_text, CASE WHEN reference_text IS NOT NULL AND trim(reference_text) <> '' THEN 'verified_ocr'
 WHEN benchmark_id % 2 = 0 AND notes IS NOT NULL AND trim(notes) <> '' THEN 'user_edit' WHEN candidate_text IS NOT NULL AND trim(candidate_text) <> '' THEN 'ocr' END AS source_type FROM benchmark_slides)
SELECT * FROM b WHERE source_text IS NOT NULL"""
)
def source_priority(spark: SparkSession, folder: str) -> DataFrame:
    """Verified text, else an accepted edit, else what was recognised; rows without any are dropped."""
    rows = table(spark, folder, "benchmark_slides", "benchmark_id", "reference_text", "candidate_text", "notes")
    text, kind = ops.source_text(F.col("reference_text"), F.col("notes"), F.col("benchmark_id") % 2 == 0, F.col("candidate_text"))
    return rows.select("benchmark_id", text.alias("source_text"), kind.alias("source_type")).filter("source_text IS NOT NULL")


# A deterministic stand-in for a provider: it reverses texts and fails on those with a per cent sign.
RESULTS = f"""{ROWS}, res AS (SELECT request_id, row_id, CASE WHEN contains(coalesce(original_text, ''), '%') THEN NULL ELSE list_aggregate(list_reverse(regexp_extract_all(original_text, '(?s).')), 'string_agg', '') END AS translated_text,
 CASE WHEN contains(coalesce(original_text, ''), '%') THEN 'failure' ELSE 'success' END AS status FROM w WHERE original_text IS NOT NULL)"""


def _results(spark: SparkSession, folder: str) -> DataFrame:
    rows = workbook(spark, folder).filter("original_text IS NOT NULL")
    failed = F.contains(F.col("original_text"), F.lit("%"))
    return rows.select("request_id", "row_id", F.when(~failed, F.reverse("original_text")).alias("translated_text"), F.when(failed, "failure").otherwise("success").alias("status"))


@query(
    f"""WITH {RESULTS} SELECT w.request_id, w.row_id, w.source_item_id, w.target_language, w.original_text, res.status, res.translated_text,
 row_number() OVER (ORDER BY w.source_reference, w.target_language, w.ordering_index, w.row_id) AS place FROM w JOIN res ON w.request_id = res.request_id AND w.row_id = res.row_id"""
)
def export_records(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and results on their key, numbered in export order (over all rows, though no task sees them all)."""
    rows = workbook(spark, folder).join(_results(spark, folder), ["request_id", "row_id"])
    numbered = rows.select("request_id", "row_id", "source_item_id", "target_language", "original_text", "status", "translated_text", "source_reference", "ordering_index")
    return sequential.numbered(numbered, ["source_reference", "target_language", "ordering_index", "row_id"]).drop("source_reference", "ordering_index")


@query(
    f"""WITH {RESULTS}, a AS (SELECT request_id, count(*) AS l FROM w GROUP BY 1), b AS (SELECT request_id, count(*) AS r FROM res GROUP BY 1 UNION ALL SELECT 'req-unknown', 1),
f AS (SELECT request_id, l, r FROM a FULL JOIN b USING (request_id))
SELECT request_id, unnest(list_filter([CASE WHEN r IS NULL THEN 'missing' END, CASE WHEN l IS NULL THEN 'unknown' END, CASE WHEN l > 1 THEN 'repeated on the left' END, CASE WHEN r > 1 THEN 'repeated on the right' END], lambda x: x IS NOT NULL)) AS problem FROM f"""
)
def integrity_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Requests without a result (those without a text), results nobody asked for (one is added), and repeats on either side."""
    results = _results(spark, folder).select("request_id").unionByName(spark.createDataFrame([("req-unknown",)], "request_id string"))
    return ops.key_violations(workbook(spark, folder).select("request_id"), results, "request_id")


@query(f"WITH {RESULTS}, j AS (SELECT w.row_id, coalesce(res.status, 'not submitted') AS status FROM w LEFT JOIN res USING (request_id, row_id)) SELECT status, count(*) AS rows FROM j GROUP BY status")
def status_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = workbook(spark, folder).select("request_id", "row_id").join(_results(spark, folder).select("request_id", "row_id", "status"), ["request_id", "row_id"], "left")
    return rows.withColumn("status", F.coalesce("status", F.lit("not submitted"))).groupBy("status").agg(F.count("*").alias("rows"))


@query(f"WITH {ROWS} SELECT count(DISTINCT source_item_id) AS sources, count(DISTINCT target_language) AS languages, count(*) AS records FROM w")
def export_distinct_counts(spark: SparkSession, folder: str) -> DataFrame:
    return workbook(spark, folder).agg(F.countDistinct("source_item_id").alias("sources"), F.countDistinct("target_language").alias("languages"), F.count("*").alias("records"))


@query(
    f"""WITH v AS (SELECT benchmark_id, reference_text AS a, candidate_text AS b FROM benchmark_slides WHERE reference_text IS NOT NULL AND candidate_text IS NOT NULL),
n AS (SELECT benchmark_id, {NUMBERS.replace('(t,', '(a,')} AS x, {NUMBERS.replace('(t,', '(b,')} AS y FROM v) SELECT benchmark_id FROM n WHERE len(x) > 0 AND list_sort(x) <> list_sort(y)"""
)
def numeric_token_mismatch(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs whose numbers differ as multisets."""
    rows = table(spark, folder, "benchmark_slides", "benchmark_id", "reference_text", "candidate_text").filter("reference_text IS NOT NULL AND candidate_text IS NOT NULL")
    a, b = F.array_sort(numeric_tokens(F.col("reference_text"))), F.array_sort(numeric_tokens(F.col("candidate_text")))
    return rows.filter((F.size(a) > 0) & (a != b)).select("benchmark_id")


@query(
    r"""WITH p AS (SELECT DISTINCT paragraph_id, text FROM paragraphs WHERE text IS NOT NULL), t AS (SELECT paragraph_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS a, list_filter(string_split(replace(text, chr(10), CASE WHEN paragraph_id % 2 = 0 THEN ' ' ELSE chr(10) END), chr(10)), lambda x: trim(x) <> '') AS b FROM p),
c AS (SELECT *, len(list_filter(a, lambda x: regexp_matches(x, '^\s*(?:[-*•▪◦○]|\d+[.)])\s+'))) AS ba, len(list_filter(b, lambda x: regexp_matches(x, '^\s*(?:[-*•▪◦○]|\d+[.)])\s+'))) AS bb FROM t)
SELECT paragraph_id FROM c WHERE (len(a) >= 3 AND len(b) <= floor(len(a) / 2)) OR (ba >= 2 AND bb < ba)"""
)
def structure_warning(spark: SparkSession, folder: str) -> DataFrame:
    """Texts whose lines or bullets got lost (here: where every other paragraph's line ends are dropped)."""
    rows = table(spark, folder, "paragraphs", "paragraph_id", "text").distinct().filter("text IS NOT NULL")
    changed = F.when(F.col("paragraph_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(" "))).otherwise(F.col("text"))
    return rows.filter(F.array_contains(ops.warnings(F.col("text"), changed), "structure_mismatch")).select("paragraph_id")


@query(
    r"""WITH w AS (SELECT DISTINCT row_id, target_language AS t FROM workbook_rows), c AS (SELECT row_id, CASE WHEN regexp_full_match(trim(t), '[A-Za-z]{2}(?:[-_][A-Za-z0-9]{2,8})?') THEN lower(left(trim(t), 2)) END AS code FROM w)
SELECT row_id, code, CASE code WHEN 'de' THEN 'German' WHEN 'en' THEN 'English' WHEN 'es' THEN 'Spanish' WHEN 'fr' THEN 'French' WHEN 'pt' THEN 'Portuguese' WHEN 'ru' THEN 'Russian' END AS name FROM c"""
)
def language_display(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "workbook_rows", "row_id", "target_language").distinct()
    return rows.withColumn("code", language_code(F.col("target_language"))).select("row_id", "code", language_name(F.col("code")).alias("name"))


@query(f"WITH {ROWS}, s AS (SELECT DISTINCT target_language FROM w) SELECT target_language, count(*) AS rows, count(DISTINCT source_reference) AS sheets FROM w JOIN s USING (target_language) GROUP BY target_language")
def sheet_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = workbook(spark, folder).filter("target_language IS NOT NULL")
    return rows.groupBy("target_language").agg(F.count("*").alias("rows"), F.countDistinct("source_reference").alias("sheets"))


@query(f"WITH {ROWS} SELECT row_id, CASE WHEN row_id % 3 = 0 THEN 'Accepted' ELSE 'Unreviewed' END AS review FROM w")
def review_defaults(spark: SparkSession, folder: str) -> DataFrame:
    """Rows without a review get the default one: a left join."""
    rows = workbook(spark, folder).select("row_id")
    reviews = rows.filter("row_id % 3 = 0").select("row_id", F.lit("Accepted").alias("review")).distinct()
    return rows.join(reviews, "row_id", "left").fillna("Unreviewed", ["review"])


def _stand_in(text: str, language: str) -> str:
    if "%" in text:
        raise ValueError("a per cent sign")
    return f"[{language}] {text[::-1]}"


@query(
    f"""WITH {ROWS} SELECT row_id, CASE WHEN contains(original_text, '%') THEN 'failure' ELSE 'success' END AS status,
 CASE WHEN NOT contains(original_text, '%') THEN '[xx] ' || list_aggregate(list_reverse(regexp_extract_all(original_text, '(?s).')), 'string_agg', '') END AS translated_text, CASE WHEN contains(original_text, '%') THEN 'ValueError: a per cent sign' END AS error
FROM w WHERE original_text IS NOT NULL AND trim(original_text) <> ''"""
)
def provider_failure_containment(spark: SparkSession, folder: str) -> DataFrame:
    """A provider that fails on some rows fails those alone."""
    return _contained(workbook(spark, folder))


def _contained(rows: DataFrame) -> DataFrame:
    sources = rows.filter(ops.usable(F.col("original_text"))).select("row_id", F.col("original_text").alias("source_text"), F.lit("xx").alias("target_language"))
    return ops.run_provider(sources, _stand_in).select("row_id", "status", "translated_text", "error")
