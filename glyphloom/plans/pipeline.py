"""Queries over engines, batches, reviews, sheets and totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphloom.functions import similarity
from glyphloom.functions.text import frame_count, join_fragments, letter_words, shared_boundary, unix_lines
from glyphloom.operators import confidence, engines, exports, lines, scoring, translation, visual
from glyphloom.plans.base import LATEST_REGIONS, query
from glyphloom.plans.confidence import regions
from glyphloom.plans.layout import BOXED, _reading
from glyphloom.plans.reports import PARAGRAPHS, paragraphs
from glyphloom.plans.rules import EVIDENCE, evidence
from glyphloom.plans.scoring import EDITED, _edited
from glyphloom.plans.slides import FRAMES, runs
from glyphloom.plans.translation import NUMBERS, ROWS, workbook
from glyphloom.sources.tables import latest, table

SHOWN = "f AS (SELECT frame_id, max_by(struct_pack(t := combined_text), ingested_at).t AS t FROM frames WHERE frame_id IS NOT NULL GROUP BY frame_id)"


def _line_engine() -> engines.Engine:
    """A stand-in engine that reads the lines of a text: it fails on per cent signs, and loses a box where there is a number sign."""

    def read(shown: str) -> engines.Page:
        if "%" in shown:
            raise ValueError("a per cent sign")
        own = [x for x in shown.split("\n") if x.strip(" ")]
        boxes = [[0.0, 40.0 * k, 10.0 * len(x), 40.0 * k + 30] for k, x in enumerate(own)]
        return own, [0.5 + 0.125 * (k % 4) for k in range(len(own))], boxes[1:] if "#" in shown else boxes

    return read


engines.register_engine("lines", _line_engine)


# Engines
@query(
    f"""WITH {SHOWN}, e AS (SELECT frame_id, CASE WHEN contains(t, '%') THEN 'ValueError: a per cent sign' WHEN contains(t, '#') THEN 'inconsistent counts' END AS error, list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '') AS l FROM f WHERE t IS NOT NULL)
SELECT frame_id, (i - 1)::INT AS position, l[i] AS text, 0.5::DOUBLE + 0.125::DOUBLE * ((i - 1) % 4) AS confidence, [0::DOUBLE, 40::DOUBLE * (i - 1), 10::DOUBLE * length(l[i]), 40::DOUBLE * (i - 1) + 30] AS box, NULL AS error FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM e WHERE error IS NULL)
UNION ALL SELECT frame_id, NULL, NULL, NULL, NULL, error FROM e WHERE error IS NOT NULL"""
)
def engine_recognition(spark: SparkSession, folder: str) -> DataFrame:
    """Every frame through an injected engine: its raw regions in the engine's order, or why there are none."""
    shown = latest(table(spark, folder, "frames", "frame_id", "combined_text", "ingested_at"), "frame_id", "ingested_at").select("frame_id", F.col("combined_text").alias("image"))
    return engines.recognise(shown, engines.engine_factory("lines"), ["frame_id"])


@query(
    f"""WITH {LATEST_REGIONS}, p AS (SELECT frame_id, count(*) AS n, bool_or(confidence IS NULL OR isnan(confidence) OR isinf(confidence)) AS c, bool_or(box IS NULL OR len(box) <> 4) AS q, bool_or(box[1] > box[3] OR box[2] > box[4]) AS o FROM l WHERE frame_id IS NOT NULL GROUP BY frame_id)
SELECT frame_id, CASE WHEN frame_id % 7 = 0 THEN 'inconsistent counts' WHEN c THEN 'confidence is not finite' WHEN q THEN 'box is not four numbers' WHEN coalesce(o, false) THEN 'box is not ordered' END AS error, n::INT AS regions FROM p"""
)
def engine_pages(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with each frame's page as an engine returned it (every seventh loses a score on the way)."""
    own = regions(spark, folder, "frame_id", "source_index", "text", "confidence", "box").filter("frame_id IS NOT NULL")
    part = F.sort_array(F.collect_list(F.struct("source_index", "region_id", F.coalesce("text", F.lit("")).alias("text"), "confidence", "box")))
    pages = own.groupBy("frame_id").agg(part.alias("p")).select("frame_id", F.col("p.text").alias("texts"), F.col("p.confidence").alias("scores"), F.col("p.box").alias("boxes"))
    lost = F.when(F.col("frame_id") % 7 == 0, F.slice("scores", 1, F.size("scores") - 1)).otherwise(F.col("scores"))
    return pages.select("frame_id", engines.page_error(F.col("texts"), lost, F.col("boxes")).alias("error"), F.size("texts").alias("regions"))


# Batches
SOURCES = "s AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)"


def _sourced(source: str) -> str:
    if "a" in source[:3]:
        raise RuntimeError(f"no stream in {source}")
    return f"runs/{source}"


def _outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return engines.run_batch(table(spark, folder, "documents", "source").filter("source IS NOT NULL").distinct(), _sourced)


@query(
    f"""WITH {SOURCES} SELECT source, NOT contains(left(source, 3), 'a') AS success, CASE WHEN contains(left(source, 3), 'a') THEN ['Video: ' || source, 'Status: Failed', 'Error: RuntimeError: no stream in ' || source]
 ELSE ['Video: ' || source, 'Status: Success', 'Output workspace: runs/' || source] END AS log FROM s"""
)
def batch_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """A batch over all sources, in which some fail; and what the log says of each."""
    found = _outcomes(spark, folder)
    return found.select("source", "success", engines.batch_log(found).alias("log"))


@query(f"WITH {SOURCES} SELECT count(*) AS selected, count(*) FILTER (WHERE NOT contains(left(source, 3), 'a')) AS completed, count(*) FILTER (WHERE contains(left(source, 3), 'a')) AS failed FROM s")
def batch_summary(spark: SparkSession, folder: str) -> DataFrame:
    return engines.batch_summary(_outcomes(spark, folder))


# Reviews
REVERSED = "list_aggregate(list_reverse(regexp_extract_all(original_text, '(?s).')), 'string_agg', '')"
STATES = "['unreviewed', 'accepted', 'edited_verified', 'flagged'][row_id % 4 + 1]"
WARNED = f"""{ROWS}, o AS (SELECT row_id, source_item_id, source_reference, request_id, target_language, slide_value, original_text, contains(original_text, '%') AS failed, CASE WHEN NOT contains(original_text, '%') THEN {REVERSED} END AS tr FROM w WHERE original_text IS NOT NULL AND trim(original_text) <> ''),
d AS (SELECT *, {NUMBERS.replace('(t,', '(original_text,')} AS na, {NUMBERS.replace('(t,', '(tr,')} AS nb, list_filter(regexp_split_to_array(original_text, '\\r\\n?|\\n'), lambda x: trim(x) <> '') AS la, list_filter(regexp_split_to_array(tr, '\\r\\n?|\\n'), lambda x: trim(x) <> '') AS lb FROM o),
e AS (SELECT *, len(list_filter(la, lambda x: regexp_matches(x, '^\\s*(?:[-*•▪◦○]|\\d+[.)])\\s+'))) AS ba, len(list_filter(lb, lambda x: regexp_matches(x, '^\\s*(?:[-*•▪◦○]|\\d+[.)])\\s+'))) AS bb FROM d),
v AS (SELECT *, CASE WHEN failed THEN ['translation_failed'] ELSE list_filter([CASE WHEN len(na) > 0 AND list_sort(na) <> list_sort(nb) THEN 'numeric_mismatch' END, CASE WHEN (len(la) >= 3 AND len(lb) <= floor(len(la) / 2)) OR (ba >= 2 AND bb < ba) THEN 'structure_mismatch' END], lambda x: x IS NOT NULL) END AS codes FROM e)"""


def _translated(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with a text, translated by a stand-in that reverses texts and fails on per cent signs."""
    rows = workbook(spark, folder).filter(translation.usable(F.col("original_text")))
    failed = F.contains("original_text", F.lit("%"))
    return rows.withColumns({"status": F.when(failed, "failure").otherwise("success"), "translated_text": F.when(~failed, F.reverse("original_text")), "error": F.when(failed, "a per cent sign")})


@query(
    f"""WITH {ROWS}, o AS (SELECT row_id, {STATES} AS state, contains(original_text, '%') AS failed, original_text, {REVERSED} AS tr FROM w WHERE original_text IS NOT NULL AND trim(original_text) <> '')
SELECT row_id, CASE WHEN failed THEN NULL WHEN state = 'edited_verified' THEN '[' || original_text || ']' ELSE tr END AS output_text, NOT failed AND state IN ('accepted', 'edited_verified') AS human_verified FROM o"""
)
def reviewed_texts(spark: SparkSession, folder: str) -> DataFrame:
    """What is put out under each of four states of review (by row), for successes and failures."""
    rows = _translated(spark, folder).withColumn("state", F.element_at(F.array(*[F.lit(s) for s in ("unreviewed", "accepted", "edited_verified", "flagged")]), (F.col("row_id") % 4 + 1).cast("int")))
    text, verified = translation.resolved(F.col("status"), F.col("translated_text"), F.col("state"), F.concat(F.lit("["), "original_text", F.lit("]")))
    return rows.select("row_id", text.alias("output_text"), verified.alias("human_verified"))


@query(f"WITH {WARNED} SELECT row_id, codes AS warnings, CASE WHEN failed THEN 'translation_failed' WHEN len(codes) > 0 THEN 'review_recommended' ELSE 'normal_review' END AS priority FROM v")
def review_warnings(spark: SparkSession, folder: str) -> DataFrame:
    """Warnings about each translation. A reversed text is like its source only if it reads the same backwards, which the SQL leaves out."""
    return translation.assessed(_translated(spark, folder), "original_text", "translated_text").select("row_id", F.col("review_warnings").alias("warnings"), F.col("review_priority").alias("priority"))


@query()
def copied_translations(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates against their references as translations against their source: which are copies; rows only, as the likeness comes from matching blocks."""
    rows = table(spark, folder, "benchmark_slides", "benchmark_id", "reference_text", "candidate_text").filter("reference_text IS NOT NULL AND candidate_text IS NOT NULL").withColumn("status", F.lit("success"))
    found = translation.assessed(rows, "reference_text", "candidate_text")
    return found.select("benchmark_id", F.array_contains("review_warnings", "source_copy_similarity").alias("copied"))


@query(
    r"""WITH p AS (SELECT benchmark_id, regexp_extract_all(lower(reference_text), '\p{L}+') AS a, regexp_extract_all(lower(candidate_text), '\p{L}+') AS b, regexp_matches(reference_text || ' ' || candidate_text, '(?i)https?://|www\.') AS url FROM benchmark_slides WHERE reference_text IS NOT NULL AND candidate_text IS NOT NULL)
SELECT benchmark_id, len(a) AS words, len(a) >= 4 AND len(b) >= 4 AND length(array_to_string(a, '')) >= 20 AND NOT url AS comparable FROM p"""
)
def copy_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs that have enough words, and no address, to be compared at all."""
    rows = table(spark, folder, "benchmark_slides", "benchmark_id", "reference_text", "candidate_text").filter("reference_text IS NOT NULL AND candidate_text IS NOT NULL")
    return rows.select("benchmark_id", F.size(letter_words(F.col("reference_text"))).cast("long").alias("words"), translation.may_be_copied(F.col("reference_text"), F.col("candidate_text")).alias("comparable"))


# Files and sheets
@query(
    f"""WITH {PARAGRAPHS}, s AS (SELECT video_id, max_by(struct_pack(a := region_count, b := minimum, c := maximum, d := mean, e := median, f := below_threshold_count, g := below_threshold_proportion, h := threshold), stats_id) AS k FROM confidence_stats GROUP BY video_id)
SELECT p.frame_number AS "Slide Number", upper(text_type) AS "Paragraph Type", text AS "Paragraph Text", k.a AS ocr_region_count, k.b AS ocr_confidence_minimum, k.c AS ocr_confidence_maximum, k.d AS ocr_confidence_mean, k.e AS ocr_confidence_median,
 k.f AS ocr_below_threshold_count, k.g AS ocr_below_threshold_proportion, k.h AS ocr_confidence_threshold FROM p LEFT JOIN s USING (video_id) WHERE trim(coalesce(text, '')) <> ''"""
)
def csv_rows_with_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the CSV with the statistics of their video (of its last computed run) beside each."""
    columns = ["region_count", "minimum", "maximum", "mean", "median", "below_threshold_count", "below_threshold_proportion", "threshold"]
    last = table(spark, folder, "confidence_stats", "stats_id", "video_id", *columns).groupBy("video_id").agg(F.max_by(F.struct(*columns), "stats_id").alias("k")).select("video_id", "k.*")
    own = paragraphs(spark, folder).filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    placed = own.select("video_id", *[c.alias(n) for c, n in zip((F.col("frame_number"), F.upper("text_type"), F.col("text")), exports.CSV_COLUMNS)])
    return exports.with_statistics(placed, last, "video_id", columns).drop("video_id")


@query(
    f"""WITH {PARAGRAPHS} SELECT regexp_replace(video_id, '[:\\\\/?*\\[\\]]', '_', 'g') AS sheet, paragraph_id, frame_number AS "Slide", text AS "Original Text", '' AS "Initial AI Translation", '' AS "Modified Translation", '' AS "Verified" FROM p WHERE text IS NOT NULL AND video_id IS NOT NULL"""
)
def consolidated_sheets(spark: SparkSession, folder: str) -> DataFrame:
    """One workbook of all videos: the rows of each sheet, under its name. (The videos' names are unique and short, as the SQL takes for granted.)"""
    own = exports.consolidated(paragraphs(spark, folder).filter("text IS NOT NULL AND video_id IS NOT NULL"), "video_id", "video_id")
    return own.select("sheet", "paragraph_id", *exports.sheet_rows(own, "frame_number", "text"))


@query(
    f"""WITH {WARNED} SELECT source_item_id AS "Source Item", coalesce(slide_value, '') AS "Slide", original_text AS "Original Text", coalesce(target_language, '') AS "Target Language", coalesce(tr, '') AS "Initial AI Translation", CASE WHEN failed THEN 'failure' ELSE 'success' END AS "Translation Status",
 'stand-in' AS "Provider", '' AS "Model", coalesce(request_id, '') AS "Request ID", coalesce(source_reference, '') AS "Source Reference", 'ocr' AS "Source Type", CASE WHEN failed THEN 'a per cent sign' ELSE '' END AS "Error",
 CASE WHEN failed THEN 'Translation Failed' WHEN len(codes) > 0 THEN 'Review Recommended' ELSE 'Normal Review' END AS "Review Status", array_to_string(codes, '; ') AS "Review Warnings" FROM v"""
)
def translation_file_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The fourteen columns of the translation file."""
    rows = translation.assessed(_translated(spark, folder), "original_text", "translated_text")
    named = {
        "source_item": "source_item_id",
        "slide": "slide_value",
        "initial_ai_translation": "translated_text",
        "translation_status": "status",
    }
    shown = rows.withColumns({**{n: F.col(c) for n, c in named.items()}, "provider": F.lit("stand-in"), "model": F.lit(None).cast("string"), "source_type": F.lit("ocr"), "review_status": translation.priority_label(F.col("review_priority"))})
    return exports.translation_rows(shown)


@query(
    f"""WITH {ROWS}, m AS (SELECT row_id, unnest(['source_item_id', 'source_reference', 'request_id', 'target_language', 'ordering_index', 'model']) AS field, unnest([source_item_id, source_reference, request_id, target_language, ordering_index::VARCHAR, 'm-' || row_id % 3]) AS value FROM w)
SELECT row_id, field, value FROM m WHERE value IS NOT NULL"""
)
def workbook_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """The hidden sheet of the workbook: what identifies each row, and the provider's metadata without secrets."""
    given = F.create_map(F.lit("model"), F.concat(F.lit("m-"), (F.col("row_id") % 3).cast("string")), F.lit("Api-Key"), F.lit("k"), F.lit("access_token"), F.lit("t"), F.lit("PASSWORD"), F.lit("p"))
    rows = workbook(spark, folder).withColumn("given", given)
    return exports.metadata_rows(rows, "row_id", ["source_item_id", "source_reference", "request_id", "target_language", "ordering_index"], "given")


@query(
    f"""WITH {ROWS}, s AS (SELECT DISTINCT target_language, source_reference FROM w WHERE target_language IS NOT NULL AND source_reference IS NOT NULL),
r AS (SELECT row_id, request_id, CASE WHEN contains(original_text, '%') THEN 'failure' ELSE 'success' END AS status FROM w WHERE original_text IS NOT NULL)
SELECT target_language, source_reference, w.row_id, r.status FROM s JOIN w USING (target_language, source_reference) JOIN r ON w.row_id = r.row_id AND w.request_id = r.request_id"""
)
def sheet_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Sheets, their rows, and the rows' results."""
    rows = workbook(spark, folder)
    sheets = rows.select("target_language", "source_reference").distinct()
    results = rows.filter("original_text IS NOT NULL").select("row_id", "request_id", F.when(F.contains("original_text", F.lit("%")), "failure").otherwise("success").alias("status"))
    return sheets.join(rows, ["target_language", "source_reference"]).join(results, ["row_id", "request_id"]).select("target_language", "source_reference", "row_id", "status")


# Targets and totals
SCOPES = [(visual.RECOMMENDED, "back = 1 AND coalesce(disposition, 'uncertain') <> 'text_dominant'"), (visual.ALL_SLIDES, "back = 1"), (visual.USER_SELECTED, "slide_number = 2 OR frame_number = 3")]


@query(
    f"WITH {FRAMES}, t9 AS (SELECT b.*, disposition, row_number() OVER (PARTITION BY video_id, slide_number ORDER BY frame_number DESC, frame_id DESC) AS back FROM b LEFT JOIN (WITH {EVIDENCE} SELECT frame_id, CASE WHEN dense AND NOT dispersed THEN 'text_dominant' ELSE 'other' END AS disposition FROM t) USING (frame_id)), "
    + "u9 AS ("
    + " UNION ALL ".join(f"SELECT '{scope}' AS scope, video_id, slide_number, build_index, frame_number, frame_id FROM t9 WHERE {test}" for scope, test in SCOPES)
    + ") SELECT scope, video_id, frame_id, row_number() OVER (PARTITION BY scope, video_id ORDER BY slide_number, coalesce(build_index, -1), frame_number, frame_id) AS place FROM u9"
)
def visual_targets(spark: SparkSession, folder: str) -> DataFrame:
    """The targets of each scope in their order: of the slides' last frames those that may show more than text, all of them, or chosen slides and frames."""
    back = F.row_number().over(Window.partitionBy("video_id", "slide_number").orderBy(F.desc("place")))
    judged = visual.disposition(evidence(spark, folder)).select("frame_id", "disposition")
    frames = runs(spark, folder).withColumn("is_default", back == 1).join(judged, "frame_id", "left").fillna(visual.UNCERTAIN, ["disposition"]).drop("place")
    chosen = [visual.select_targets(frames, s, [2] if s == visual.USER_SELECTED else None, [3] if s == visual.USER_SELECTED else None).withColumn("scope", F.lit(s)) for s, _ in SCOPES]
    place = F.row_number().over(Window.partitionBy("scope", "video_id").orderBy(*visual.target_order(), "frame_id"))
    return reduce(DataFrame.unionByName, chosen).withColumn("place", place).select("scope", "video_id", "frame_id", "place")


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, max(l_discount) AS c, max(l_tax) AS w, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2), b AS (SELECT l_orderkey, c AS bc, w AS bw FROM l WHERE l_linenumber = 1),
s AS (SELECT l_linenumber AS variant, round(avg(c), 9) AS cer, round(avg(w), 9) AS wer, count(*) FILTER (WHERE c < bc OR (c = bc AND w < bw)) AS improved, count(*) FILTER (WHERE c > bc OR (c = bc AND w > bw)) AS worsened, sum(q) AS seconds FROM l JOIN b USING (l_orderkey) GROUP BY 1),
o AS (SELECT cer AS oc, wer AS ow, seconds AS os FROM s WHERE variant = 1),
k AS (SELECT variant, [cer < oc, wer < ow, improved > worsened, true, seconds <= os * 1.5, improved > 1] AS ok FROM s, o)
SELECT variant, CASE WHEN variant = 1 THEN 'n/a' ELSE array_to_string(list_filter(list_transform(range(1, 7), lambda i: CASE WHEN ok[i] THEN n[i] END), lambda x: x IS NOT NULL), '; ') END AS passed,
 CASE WHEN variant = 1 THEN 'n/a' ELSE array_to_string(list_filter(list_transform(range(1, 7), lambda i: CASE WHEN NOT ok[i] THEN n[i] END), lambda x: x IS NOT NULL), '; ') END AS failed
FROM (SELECT *, ['aggregate CER', 'aggregate WER', 'more improved than worsened', 'no severe nearly-perfect regression', 'operational runtime', 'not one-frame dependent'] AS n FROM k)"""
)
def decision_criteria(spark: SparkSession, folder: str) -> DataFrame:
    """The criteria that each variant (an order's line) meets against the first one."""
    rows = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_quantity").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_discount").alias("c"), F.max("l_tax").alias("w"), F.max("l_quantity").alias("q"))
    base = rows.filter("l_linenumber = 1").select("l_orderkey", F.struct(F.col("c").alias("c"), F.col("w").alias("w")).alias("_b"))
    own = F.struct(F.col("c").alias("c"), F.col("w").alias("w"))
    summary = rows.join(base, "l_orderkey").groupBy(F.col("l_linenumber").alias("variant")).agg(
        F.round(F.avg("c"), 9).alias("cer"), F.round(F.avg("w"), 9).alias("wer"), F.count_if(own < F.col("_b")).alias("improved"), F.count_if(own > F.col("_b")).alias("worsened"), F.sum("q").alias("seconds")
    )
    return confidence.decision_criteria(summary, "variant", 1).select("variant", "passed", "failed")


@query(
    r"""WITH f AS (SELECT frame_id, max_by(struct_pack(s := shared_lines, a := added_lines, r := removed_lines, d := decision, t := is_duplicate, m := similarity), ingested_at) AS k FROM frames WHERE frame_id IS NOT NULL GROUP BY frame_id),
c AS (SELECT frame_id, list_distinct(list_transform(coalesce(k.a, []), lambda x: trim(regexp_replace(lower(x), '[\p{Z}\s]+', ' ', 'g')))) AS need, list_distinct(list_transform(coalesce(k.s, []), lambda x: trim(regexp_replace(lower(x), '[\p{Z}\s]+', ' ', 'g')))) AS may,
 list_distinct(list_transform(coalesce(k.r, []), lambda x: trim(regexp_replace(lower(x), '[\p{Z}\s]+', ' ', 'g')))) AS got, frame_id % 5 > 0 AS good, ['TimeOut of the call', 'Refusal', 'it DECLINED', 'malformed answer', 'other'][(frame_id // 5) % 5 + 1] AS e, coalesce(k.t, false) AS t, coalesce(k.m < 0.5::DOUBLE, false) AS u FROM f)
SELECT count(*) AS case_count, count(*) AS requests_attempted, count(*) FILTER (WHERE good) AS structured_responses_succeeded, count(*) FILTER (WHERE NOT good) AS failed_responses, count(*) FILTER (WHERE NOT good AND e = 'malformed answer') AS schema_invalid_responses,
 count(*) FILTER (WHERE NOT good AND e = 'TimeOut of the call') AS timeouts, count(*) FILTER (WHERE NOT good AND e IN ('Refusal', 'it DECLINED')) AS refusals, count(*) FILTER (WHERE t) AS content_type_matches, sum(len(need))::BIGINT AS required_relationships_expected,
 sum(len(list_filter(need, lambda x: list_contains(got, x))))::BIGINT AS required_relationships_recovered, sum(len(list_filter(need, lambda x: NOT list_contains(got, x))))::BIGINT AS required_relationships_missed,
 sum(len(list_filter(got, lambda x: NOT list_contains(need, x) AND NOT list_contains(may, x))))::BIGINT AS unsupported_relationships_added, sum(len(list_filter(may, lambda x: NOT list_contains(got, x))))::BIGINT AS required_details_missed,
 sum(len(list_filter(got, lambda x: list_contains(may, x))))::BIGINT AS prohibited_claims_detected, count(*) FILTER (WHERE u AND t) AS uncertain_cases_with_warnings, count(*) FILTER (WHERE NOT good OR u) AS human_review_required_cases FROM c"""
)
def evaluation_totals(spark: SparkSession, folder: str) -> DataFrame:
    """All totals of an evaluation (here: of what frames add, share and remove; every fifth answer fails)."""
    columns = ["shared_lines", "added_lines", "removed_lines", "is_duplicate", "similarity"]
    rows = latest(table(spark, folder, "frames", "frame_id", *columns, "ingested_at"), "frame_id", "ingested_at")
    found = visual.relation_recall(F.col("added_lines"), F.col("shared_lines"), F.col("removed_lines"))
    clean = lambda c: F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t: F.trim(F.regexp_replace(F.lower(t), r"[\p{Z}\s]+", " "))))
    need, may, got = clean("added_lines"), clean("shared_lines"), clean("removed_lines")
    good, unsure = F.col("frame_id") % 5 > 0, F.coalesce(F.col("similarity") < 0.5, F.lit(False))
    error = F.element_at(F.array(*[F.lit(e) for e in ("TimeOut of the call", "Refusal", "it DECLINED", "malformed answer", "other")]), (F.floor(F.col("frame_id") / 5) % 5 + 1).cast("int"))
    match = F.coalesce("is_duplicate", F.lit(False))
    details = rows.select(
        good.alias("success"), error.alias("error"), match.alias("content_type_match"), need.alias("required_relations"), *[c.alias(n) for n, c in found.items()], F.array_except(may, got).alias("missing_details"), F.array_intersect(got, may).alias("prohibited_claims"),
        unsure.alias("expected_uncertainty"), match.alias("uncertainty_warning"), (~good | unsure).alias("human_review"),
    )
    return visual.evaluation_totals(details)


@query(
    f"""WITH {EDITED}, d AS (SELECT s.benchmark_id, e, length(replace(replace(reference_text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS n, len(list_filter(regexp_split_to_array(reference_text, '[\\p{{Z}}\\s]+'), lambda x: x <> '')) AS w FROM s JOIN (SELECT DISTINCT benchmark_id, reference_text FROM benchmark_slides) USING (benchmark_id))
SELECT benchmark_id % 3 AS variant, sum(e)::BIGINT AS character_edits, sum(n)::BIGINT AS reference_characters, sum(w)::BIGINT AS reference_words, round(sum(e) / nullif(sum(n), 0), 9) AS cer FROM d GROUP BY 1""".replace("\\\\", "\\")
)
def preprocessing_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    """Edits and reference sizes summed by variant (here: a third of the slides each), with words counted by plain splitting."""
    texts = table(spark, folder, "benchmark_slides", "benchmark_id", "reference_text").distinct()
    size = F.length(F.regexp_replace("reference_text", r"\r\n?", "\n"))
    words = F.size(F.filter(F.split("reference_text", r"[\p{Z}\s]+"), lambda x: x != ""))
    rows = _edited(spark, folder).select("benchmark_id", "e").join(texts.select("benchmark_id", size.alias("n"), words.alias("w")), "benchmark_id")
    return rows.groupBy((F.col("benchmark_id") % 3).alias("variant")).agg(F.sum("e").alias("character_edits"), F.sum("n").alias("reference_characters"), F.sum("w").alias("reference_words"), F.round(F.try_divide(F.sum("e"), F.sum("n")), 9).alias("cer"))


@query(
    f"""WITH {EDITED}, d AS (SELECT benchmark_id, video_id, e, n, CASE WHEN n > 0 THEN e / n END AS rate FROM s)
SELECT 'all' AS section, 'weighted' AS name, round(sum(e) / nullif(sum(n), 0), 9) AS cer FROM d UNION ALL SELECT 'all', 'mean', round(avg(rate), 9) FROM d
UNION ALL SELECT 'video', video_id, round(sum(e) / nullif(sum(n), 0), 9) FROM d GROUP BY video_id UNION ALL SELECT 'worst', benchmark_id::VARCHAR, round(rate, 9) FROM (SELECT * FROM d WHERE n > 0 ORDER BY rate DESC, benchmark_id LIMIT 5)"""
)
def accuracy_report(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the accuracy report: rates of all slides, of each video, and of the five worst slides."""
    scored = _edited(spark, folder).withColumn("rate", F.when(F.col("n") > 0, F.col("e") / F.col("n")))
    return scoring.report(scored, "video_id", "benchmark_id")


@query(
    f"""SELECT region_id, slide_number::BIGINT AS slide_number, build_index::BIGINT AS build_index FROM (WITH {LATEST_REGIONS} SELECT region_id, frame_id FROM l) JOIN (WITH {FRAMES} SELECT frame_id, slide_number, build_index FROM b) USING (frame_id)"""
)
def region_slides(spark: SparkSession, folder: str) -> DataFrame:
    """The slide and build that each region's frame belongs to."""
    places = runs(spark, folder).select("frame_id", "slide_number", "build_index")
    return regions(spark, folder, "frame_id").join(places, "frame_id").select("region_id", "slide_number", "build_index")


# Names, categories, look-ups
@query(r"""SELECT DISTINCT source, export_kind, CASE WHEN regexp_full_match(lower(trim(source)), '[a-z][a-z0-9_-]*') THEN lower(trim(source)) END AS a, CASE WHEN regexp_full_match(lower(trim(' ' || upper(export_kind))), '[a-z][a-z0-9_-]*') THEN lower(trim(export_kind)) END AS b FROM documents""")
def provider_names(spark: SparkSession, folder: str) -> DataFrame:
    """Sources and kinds of export as names of providers: the one has dots, the other is written large."""
    rows = table(spark, folder, "documents", "source", "export_kind").distinct()
    return rows.select("source", "export_kind", translation.provider_name(F.col("source")).alias("a"), translation.provider_name(F.concat(F.lit(" "), F.upper("export_kind"))).alias("b"))


ERRORS = [(401, "E", "m"), (403, "E", "m"), (429, "E", "m"), (404, "E", "no such Model"), (400, "E", "bad"), (None, "SSLError", "m"), (None, "E", "a TIMEOUT"), (None, "ConnectionError", "m"), (None, "ModelError", "m"), (None, "E", "empty response"), (None, "RateError", "m"), (None, "AuthError", "timeout"), (None, None, None)]
CATEGORIES = ["authentication failed", "account/project access failed", "rate limit reached", "model unavailable", "provider request failed", "TLS/certificate failure", "request timed out", "network request failed", "model unavailable", "invalid provider response", "rate limit reached", "authentication failed", "provider request failed"]


@query("SELECT doc_id, [" + ", ".join(f"'{c}'" for c in CATEGORIES) + f"][doc_id % {len(CATEGORIES)} + 1] AS category FROM documents")
def error_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Thirteen kinds of failures, whose categories are known."""
    kinds = F.array(*[F.struct(F.lit(s).cast("int").alias("status"), F.lit(k).cast("string").alias("kind"), F.lit(m).cast("string").alias("message")) for s, k, m in ERRORS])
    rows = table(spark, folder, "documents", "doc_id").withColumn("e", F.element_at(kinds, (F.col("doc_id") % len(ERRORS) + 1).cast("int")))
    return rows.select("doc_id", translation.error_category(F.col("e.kind"), F.col("e.message"), F.col("e.status")).alias("category"))


@query(
    f"""WITH {ROWS}, c AS (SELECT source_language, target_language, row_id FROM w WHERE row_id % 50 = 0), g AS (SELECT source_language, target_language, count(*) AS n, min(row_id) AS model FROM c GROUP BY 1, 2)
SELECT w.row_id, CASE WHEN n = 1 THEN g.model END AS model, CASE WHEN n IS NULL THEN 'not installed' WHEN n > 1 THEN 'ambiguous' END AS problem FROM w LEFT JOIN g ON w.source_language = g.source_language AND w.target_language = g.target_language"""
)
def exact_models(spark: SparkSession, folder: str) -> DataFrame:
    """The one model of each row's pair of languages (the catalogue: every fiftieth row)."""
    rows = workbook(spark, folder).select("row_id", "source_language", "target_language")
    catalogue = rows.filter("row_id % 50 = 0").withColumnRenamed("row_id", "model")
    return translation.exact_models(rows, catalogue, ["source_language", "target_language"], "model").select("row_id", "model", "problem")


@query(f"WITH {ROWS} SELECT DISTINCT target_language FROM w WHERE source_language IN ('en', 'en-US')")
def installed_targets(spark: SparkSession, folder: str) -> DataFrame:
    return translation.usable_targets(workbook(spark, folder).select("source_language", "target_language"), [], True)


@query("SELECT DISTINCT frame_id, CASE WHEN frame_number - 5 > 0 THEN frame_number - 5 END AS frames FROM frames")
def frame_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts as containers report them, of which some are none."""
    return table(spark, folder, "frames", "frame_id", "frame_number").distinct().select("frame_id", frame_count(F.col("frame_number") - 5).alias("frames"))


@query(
    """WITH s AS (SELECT export_kind, lower(trim(source)) AS k, max(struct_pack(t := exported_at, d := doc_id)) AS m FROM documents WHERE source IS NOT NULL AND export_kind IS NOT NULL AND exported_at IS NOT NULL AND trim(source) <> '' GROUP BY 1, 2)
SELECT export_kind, k AS source, row_number() OVER (PARTITION BY export_kind ORDER BY m DESC) AS place FROM s QUALIFY place <= 10"""
)
def recent_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The ten sources that were used last for each kind of export, each once."""
    rows = table(spark, folder, "documents", "doc_id", "source", "export_kind", "exported_at").filter("source IS NOT NULL AND export_kind IS NOT NULL AND exported_at IS NOT NULL AND trim(source) <> ''")
    last = rows.groupBy("export_kind", F.lower(F.trim("source")).alias("source")).agg(F.max(F.struct("exported_at", "doc_id")).alias("m"))
    return last.withColumn("place", F.row_number().over(Window.partitionBy("export_kind").orderBy(F.desc("m")))).filter("place <= 10").select("export_kind", "source", "place")


# Texts and places of lines
FRAGMENTS = """t AS (SELECT DISTINCT line_id, frame_id, line_index, trim(text) AS text FROM text_lines WHERE text IS NOT NULL AND trim(text) <> ''), n AS (SELECT line_id, text AS a, lead(text) OVER (PARTITION BY frame_id ORDER BY line_index, line_id) AS b FROM t),
o AS (SELECT *, list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda k: k = 0 OR right(lower(a), k) = left(lower(b), k))) AS shared FROM n WHERE b IS NOT NULL)"""


def _fragments(spark: SparkSession, folder: str) -> DataFrame:
    own = table(spark, folder, "text_lines", "line_id", "frame_id", "line_index", "text").filter("text IS NOT NULL AND trim(text) <> ''").withColumn("text", F.trim("text")).distinct()
    after = F.lead("text").over(Window.partitionBy("frame_id").orderBy("line_index", "line_id"))
    return own.withColumn("b", after).filter("b IS NOT NULL").select("line_id", F.col("text").alias("a"), "b")


@query(
    rf"""WITH {FRAGMENTS} SELECT line_id, shared::INT AS shared, CASE WHEN shared > 0 THEN left(a, length(a) - shared) || b WHEN length(a) = 1 AND regexp_matches(a, '^\p{{Lu}}$') AND regexp_matches(b, '^\p{{Ll}}') THEN a || b
 WHEN regexp_matches(b, '^[.,;:!?)\]}}]') OR regexp_matches(a, '[(\[{{]$') THEN a || b ELSE a || ' ' || b END AS joined FROM o"""
)
def boundary_stitches(spark: SparkSession, folder: str) -> DataFrame:
    """Each line of a frame and the next as if their boxes overlapped: what they share at the boundary, and both as one text."""
    return _fragments(spark, folder).select("line_id", shared_boundary(F.col("a"), F.col("b")).alias("shared"), join_fragments(F.col("a"), F.col("b"), F.lit(True)).alias("joined"))


@query(
    rf"""WITH {LATEST_REGIONS} SELECT region_id, trim(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS unix, trim(regexp_replace(nfc_normalize(text), '[\p{{Z}}\s\x1c-\x1f\x85]+', ' ', 'g')) AS composed, regexp_extract_all(lower(text), '\p{{L}}+') AS words FROM l WHERE text IS NOT NULL"""
)
def text_forms(spark: SparkSession, folder: str) -> DataFrame:
    """A region's text with plain line ends, in composed form, and as words of letters."""
    rows = regions(spark, folder, "text").filter("text IS NOT NULL")
    return rows.select("region_id", unix_lines(F.col("text")).alias("unix"), similarity.composed(F.col("text")).alias("composed"), letter_words(F.col("text")).alias("words"))


@query(
    f"""WITH {BOXED}, y AS (SELECT region_id, frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY top NULLS FIRST, "left" NULLS FIRST, source_index NULLS FIRST, region_id) AS i, "left" AS lf, top, (top + bottom) / 2 AS m FROM x),
z AS (SELECT *, floor(top / 40)::BIGINT AS line FROM y WHERE top IS NOT NULL AND frame_id IS NOT NULL),
q AS (SELECT frame_id, line, row_number() OVER (PARTITION BY frame_id ORDER BY median(m), median(top), min(lf), min(i)) AS line_number FROM z GROUP BY frame_id, line)
SELECT region_id, line_number, row_number() OVER (PARTITION BY frame_id, line ORDER BY lf, m, i) AS position FROM z JOIN q USING (frame_id, line)"""
)
def line_positions(spark: SparkSession, folder: str) -> DataFrame:
    """The order of lines and of regions in them, for given lines (here: bands of 40 px)."""
    own = _reading(spark, folder).filter("top IS NOT NULL AND frame_id IS NOT NULL").withColumn("line", F.floor(F.col("top") / 40))
    return lines.order_in_lines(own).select("region_id", "line_number", "position")
