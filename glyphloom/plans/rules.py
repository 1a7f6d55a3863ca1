"""Queries for rules over single values and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphloom.functions.similarity import json_problem
from glyphloom.functions.text import is_safe_relative_path, normalise, redacted, remaining_seconds, version_tuple
from glyphloom.operators import visual
from glyphloom.plans.base import query
from glyphloom.plans.layout import BOXED, _reading
from glyphloom.sources import strings
from glyphloom.sources.tables import table

# Source strings of several kinds, made from the documents' sources in both engines.
VALUE = """v AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN '  ' WHEN 1 THEN 'https://' || source || '/files/' || doc_id || '.mp4' WHEN 2 THEN 'ftp://' || source || '/a.mp4' WHEN 3 THEN 'http:///none.mp4'
 WHEN 4 THEN 'https://youtu.be/' || doc_id WHEN 5 THEN 'https://www.YouTube.com:443/watch/?v=' || doc_id WHEN 6 THEN 'C:/videos/' || doc_id || '.mov' ELSE 'https://youtube.com/files/' || doc_id || '.mp4' END AS value FROM documents)"""
HOST = r"lower(regexp_replace(regexp_replace(regexp_extract(trim(value), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':\d*$', ''))"
PATH = r"lower(regexp_replace(regexp_extract(trim(value), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', ''))"
WATCH = f"({HOST} = 'youtu.be' OR suffix({HOST}, '.youtu.be') OR (({HOST} = 'youtube.com' OR suffix({HOST}, '.youtube.com')) AND {PATH} = '/watch'))"
ERROR = f"""CASE WHEN trim(coalesce(value, '')) = '' THEN 'blank' WHEN contains(value, '://') AND lower(regexp_extract(trim(value), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) NOT IN ('http', 'https') THEN 'unsupported scheme'
 WHEN contains(value, '://') AND {HOST} = '' THEN 'no host' WHEN {WATCH} THEN 'web page' END"""


def _values(spark: SparkSession, folder: str) -> DataFrame:
    s, n = F.col("source"), F.col("doc_id").cast("string")
    kinds = [F.lit("  "), F.concat(F.lit("https://"), s, F.lit("/files/"), n, F.lit(".mp4")), F.concat(F.lit("ftp://"), s, F.lit("/a.mp4")), F.lit("http:///none.mp4"), F.concat(F.lit("https://youtu.be/"), n), F.concat(F.lit("https://www.YouTube.com:443/watch/?v="), n), F.concat(F.lit("C:/videos/"), n, F.lit(".mov"))]
    value = F.concat(F.lit("https://youtube.com/files/"), n, F.lit(".mp4"))
    for k, c in enumerate(kinds):
        value = F.when(F.col("doc_id") % 8 == k, c).otherwise(value)
    return table(spark, folder, "documents", "doc_id", "source").select("doc_id", value.alias("value"))


@query(f"WITH {VALUE} SELECT doc_id, CASE WHEN {ERROR} IS NULL THEN CASE WHEN contains(value, '://') THEN 'http' ELSE 'file' END END AS kind, {ERROR} AS error FROM v")
def source_classification(spark: SparkSession, folder: str) -> DataFrame:
    kind, error = strings.classify(F.col("value"))
    return _values(spark, folder).select("doc_id", kind.alias("kind"), error.alias("error"))


@query(f"WITH {VALUE} SELECT doc_id, value FROM v WHERE {WATCH}")
def url_rejection(spark: SparkSession, folder: str) -> DataFrame:
    return _values(spark, folder).filter(strings.is_watch_page(F.col("value")))


@query("SELECT doc_id, lower(trim(split_part(coalesce(CASE doc_id % 4 WHEN 0 THEN 'Text/HTML; charset=utf-8' WHEN 1 THEN 'video/mp4' WHEN 2 THEN ' application/xhtml+xml' END, ''), ';', 1))) IN ('text/html', 'application/xhtml+xml') AS page FROM documents")
def content_type_rejection(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("doc_id") % 4
    header = F.when(k == 0, "Text/HTML; charset=utf-8").when(k == 1, "video/mp4").when(k == 2, " application/xhtml+xml")
    return table(spark, folder, "documents", "doc_id").select("doc_id", strings.is_page_type(header).alias("page"))


@query("SELECT doc_id, CASE WHEN n > 0 THEN n END AS length FROM (SELECT doc_id, try_cast(CASE doc_id % 4 WHEN 0 THEN 'many' WHEN 1 THEN '-5' WHEN 2 THEN (doc_id * 7)::VARCHAR END AS BIGINT) AS n FROM documents)")
def content_length(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("doc_id") % 4
    header = F.when(k == 0, "many").when(k == 1, "-5").when(k == 2, (F.col("doc_id") * 7).cast("string"))
    return table(spark, folder, "documents", "doc_id").select("doc_id", strings.content_length(header).alias("length"))


@query(
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'talk ' || doc_id || '.mov' WHEN 1 THEN 'a_b.mp4' WHEN 2 THEN 'downloaded_video.mp4' WHEN 3 THEN 'clip-' || doc_id || '.mkv' ELSE 'lesson.mp4' END AS name FROM documents"""
)
def download_filename(spark: SparkSession, folder: str) -> DataFrame:
    """Names from headers and paths, whose results are known."""
    n, k = F.col("doc_id").cast("string"), F.col("doc_id") % 5
    header = F.when(k == 0, F.concat(F.lit("attachment; filename*=UTF-8''talk%20"), n, F.lit(".mov"))).when(k == 1, 'inline; filename="a:b"').otherwise("")
    url = F.when(k == 2, F.lit("https://host.example/")).when(k == 3, F.concat(F.lit("https://host.example/x/clip-"), n, F.lit(".mkv?t=1"))).otherwise(F.lit("https://host.example/a/lesson"))
    return table(spark, folder, "documents", "doc_id").select("doc_id", strings.download_name(header, url).alias("name"))


@query(
    r"""SELECT doc_id, regexp_replace('request ' || doc_id || ' failed: API_KEY=' || coalesce(source, 'none') || ' Authorization: ' || coalesce(lang, 'x') || ' Bearer abc.' || doc_id, '(?i)\b(api[_-]?key|token|secret|password|authorization)\b(\s*[=:]\s*)\S+', '\1\2[redacted]', 'g').regexp_replace('(?i)\bbearer\s+[a-z0-9._-]+', 'Bearer [redacted]', 'g') AS message FROM documents"""
)
def redaction(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat(F.lit("request "), F.col("doc_id").cast("string"), F.lit(" failed: API_KEY="), F.coalesce("source", F.lit("none")), F.lit(" Authorization: "), F.coalesce("lang", F.lit("x")), F.lit(" Bearer abc."), F.col("doc_id").cast("string"))
    return table(spark, folder, "documents", "doc_id", "source", "lang").select("doc_id", redacted(text).alias("message"))


@query(
    """WITH v AS (SELECT doc_id, (doc_id % 3) || '.' || (doc_id % 11) || CASE WHEN doc_id % 2 = 0 THEN '.' || (doc_id % 5) ELSE '' END AS v FROM documents)
SELECT doc_id, v AS version, list_transform(string_split(v || CASE WHEN doc_id % 2 = 0 THEN '.0' ELSE '.0.0' END, '.'), lambda x: x::INT) <= [1, 4, 0, 0] AS compatible FROM v"""
)
def version_compatibility(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("doc_id")
    v = F.concat((d % 3).cast("string"), F.lit("."), (d % 11).cast("string"), F.when(d % 2 == 0, F.concat(F.lit("."), (d % 5).cast("string"))).otherwise(""))
    rows = table(spark, folder, "documents", "doc_id").withColumn("version", v)
    return rows.select("doc_id", "version", (version_tuple(F.col("version")) <= version_tuple(F.lit("1.4.0.0"))).alias("compatible"))


@query(
    r"""WITH p AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'models/' || doc_id || '/weights.bin' WHEN 1 THEN '../' || doc_id WHEN 2 THEN '/etc/' || doc_id WHEN 3 THEN 'a//' || doc_id ELSE 'C:' || doc_id END AS p FROM documents)
SELECT doc_id, len(list_filter(string_split(p, '/'), lambda x: x IN ('', '.', '..'))) = 0 AND NOT contains(p, ':') AND NOT contains(p, chr(92)) AS safe FROM p"""
)
def safe_relative_path(spark: SparkSession, folder: str) -> DataFrame:
    """Of five kinds of paths only the first stays in its folder."""
    n, k = F.col("doc_id").cast("string"), F.col("doc_id") % 5
    p = F.when(k == 0, F.concat(F.lit("models/"), n, F.lit("/weights.bin"))).when(k == 1, F.concat(F.lit("../"), n)).when(k == 2, F.concat(F.lit("/etc/"), n)).when(k == 3, F.concat(F.lit("a//"), n)).otherwise(F.concat(F.lit("C:"), n))
    return table(spark, folder, "documents", "doc_id").select("doc_id", is_safe_relative_path(p).alias("safe"))


# A frame's pixels that its boxes cover: every cell between neighbouring edges is covered or not.
EVIDENCE = f"""{BOXED}, f AS (SELECT frame_id, max(width) AS width, max(height) AS height FROM frames WHERE frame_id IS NOT NULL GROUP BY frame_id),
c AS (SELECT frame_id, text, width, height, ("left" + "right") / 2 / width AS cx, (top + bottom) / 2 / height AS cy, greatest(0, least(width, floor("left")))::BIGINT AS a, greatest(0, least(height, floor(top)))::BIGINT AS b,
 greatest(0, least(width, ceil("right")))::BIGINT AS c, greatest(0, least(height, ceil(bottom)))::BIGINT AS d, coalesce(regexp_full_match(text, '\\s*[+-]?\\d+(?:[.,]\\d+)?%?(?:\\s+[+-]?\\d+(?:[.,]\\d+)?%?)*\\s*'), false) AS lab FROM x JOIN f USING (frame_id) WHERE top IS NOT NULL),
s AS (SELECT * FROM c WHERE a < c AND b < d),
g AS (SELECT frame_id, list({{'a': a, 'b': b, 'c': c, 'd': d}}) AS boxes, list_sort(list_distinct(list_concat(list(a), list(c)))) AS xs, list_sort(list_distinct(list_concat(list(b), list(d)))) AS ys FROM s GROUP BY frame_id),
gx AS (SELECT frame_id, boxes, xs, ys, unnest(range(1, len(xs))) AS i FROM g), gc AS (SELECT *, unnest(range(1, len(ys))) AS j FROM gx),
u2 AS (SELECT frame_id, sum(CASE WHEN len(list_filter(boxes, lambda q: q.a <= xs[i] AND q.c >= xs[i + 1] AND q.b <= ys[j] AND q.d >= ys[j + 1])) > 0 THEN (xs[i + 1] - xs[i]) * (ys[j + 1] - ys[j]) ELSE 0 END) AS area FROM gc GROUP BY frame_id),
e AS (SELECT frame_id, count(*) AS n, count(*) FILTER (WHERE lab) AS labels, coalesce(sum(len(regexp_extract_all(text, '\\d+(?:[.,]\\d+)?%'))) FILTER (WHERE lab), 0)::BIGINT AS percentages, max(width) * max(height) AS whole,
 coalesce(greatest(max(cx) FILTER (WHERE lab) - min(cx) FILTER (WHERE lab), max(cy) FILTER (WHERE lab) - min(cy) FILTER (WHERE lab)), 0) AS span FROM s GROUP BY frame_id),
k AS (SELECT e.*, area, area / whole AS cover FROM e JOIN u2 USING (frame_id)),
t AS (SELECT *, labels >= 3 AND span >= 0.25::DOUBLE AS dispersed, n >= 5 AND cover >= 0.3::DOUBLE AS dense, n <= 2 OR cover <= 0.08::DOUBLE AS sparse, cover <= 0.35::DOUBLE AS large FROM k)""".replace("\\\\", "\\")


@query(f"WITH {EVIDENCE} SELECT frame_id, n AS regions, area::BIGINT AS covered_pixels, labels AS numeric_labels, percentages, round(span, 9) AS label_span FROM k")
def visual_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return evidence(spark, folder).select("frame_id", "regions", "covered_pixels", "numeric_labels", "percentages", F.round("label_span", 9).alias("label_span"))


def evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The evidence of each frame; edges and lines are no columns of the tables and count as none."""
    size = table(spark, folder, "frames", "frame_id", "width", "height").groupBy("frame_id").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    rows = _reading(spark, folder).filter("top IS NOT NULL").join(size, "frame_id")
    return visual.frame_evidence(rows).withColumns({"edge_density": F.lit(0.0), "aligned_lines": F.lit(0)})


@query(
    f"""WITH {EVIDENCE} SELECT frame_id, CASE WHEN dense AND NOT dispersed THEN 'text_dominant' WHEN dispersed THEN 'recommended' ELSE 'uncertain' END AS disposition,
 [CASE WHEN dense AND NOT dispersed THEN '{visual.ONLY_TEXT}' WHEN dispersed THEN '{visual.DISPERSED_LABELS}' ELSE '{visual.NO_EVIDENCE}' END] AS reasons, dense AS dense_text, sparse AS sparse_text, large AS large_non_text FROM t"""
)
def visual_triage(spark: SparkSession, folder: str) -> DataFrame:
    """Which frames are worth a closer look, and why."""
    return visual.disposition(evidence(spark, folder)).select("frame_id", "disposition", "reasons", "dense_text", "sparse_text", "large_non_text")


RELATIONS = r"""f AS (SELECT frame_id, max_by(struct_pack(s := shared_lines, a := added_lines, r := removed_lines), ingested_at) AS k FROM frames GROUP BY frame_id),
c AS (SELECT frame_id, list_distinct(list_transform(coalesce(k.a, []), lambda x: trim(regexp_replace(lower(x), '[\p{Z}\s]+', ' ', 'g')))) AS need, list_distinct(list_transform(coalesce(k.s, []), lambda x: trim(regexp_replace(lower(x), '[\p{Z}\s]+', ' ', 'g')))) AS may,
 list_distinct(list_transform(coalesce(k.r, []), lambda x: trim(regexp_replace(lower(x), '[\p{Z}\s]+', ' ', 'g')))) AS got FROM f)"""


@query(
    f"""WITH {RELATIONS} SELECT frame_id, list_sort(list_filter(need, lambda x: list_contains(got, x))) AS recovered, list_sort(list_filter(need, lambda x: NOT list_contains(got, x))) AS missed,
 list_sort(list_filter(got, lambda x: NOT list_contains(need, x) AND NOT list_contains(may, x))) AS unsupported FROM c"""
)
def relationship_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Required, allowed and returned sets (here: a frame's added, shared and removed lines)."""
    from glyphloom.sources.tables import latest

    rows = latest(table(spark, folder, "frames", "frame_id", "shared_lines", "added_lines", "removed_lines", "ingested_at"), "frame_id", "ingested_at")
    found = visual.relation_recall(F.col("added_lines"), F.col("shared_lines"), F.col("removed_lines"))
    return rows.select("frame_id", *[c.alias(n) for n, c in found.items()])


@query(
    """WITH w AS (SELECT doc_id AS frame_id FROM documents WHERE doc_id % 13 = 0), f AS (SELECT DISTINCT frame_id FROM frames)
SELECT frame_id, true AS found FROM f SEMI JOIN w USING (frame_id) UNION ALL SELECT frame_id, false FROM w ANTI JOIN f USING (frame_id)"""
)
def selection_semi_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Chosen frames, and chosen ids without a frame."""
    chosen = table(spark, folder, "documents", "doc_id").filter("doc_id % 13 = 0").withColumnRenamed("doc_id", "frame_id")
    found, missing = visual.select_keys(table(spark, folder, "frames", "frame_id").distinct(), chosen, "frame_id")
    return found.withColumn("found", F.lit(True)).unionByName(missing.withColumn("found", F.lit(False)))


@query(
    """WITH e AS (SELECT user_id, event_type, min(struct_pack(t := ts, e := event_id)) AS first FROM events GROUP BY user_id, event_type)
SELECT user_id, list(event_type ORDER BY first) AS seen FROM e GROUP BY user_id"""
)
def ordered_union(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct values of each group in the order of their first occurrence."""
    e = table(spark, folder, "events", "user_id", "event_type", "ts", "event_id").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    return e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "event_type"))), lambda x: x["event_type"]).alias("seen"))


@query("SELECT event_id, CASE WHEN event_id % 9 >= 3 AND value >= 5 THEN round(greatest(0.0::DOUBLE, value / (event_id % 9) * greatest(0, 20 - event_id % 9)), 6) END AS remaining FROM events WHERE value IS NOT NULL")
def remaining_time(spark: SparkSession, folder: str) -> DataFrame:
    """The time that is left of twenty steps, unknown before the third and before five seconds."""
    left = remaining_seconds(F.col("value"), F.col("event_id") % 9, F.lit(20), 3, 5.0)
    return table(spark, folder, "events", "event_id", "value").filter("value IS NOT NULL").select("event_id", F.round(left, 6).alias("remaining"))


@query("""SELECT event_id, CASE WHEN props IS NULL THEN 'no text' WHEN event_id % 4 = 0 THEN 'no JSON' WHEN event_id % 4 = 1 THEN 'repeated key' WHEN event_id % 4 = 2 THEN 'other fields' END AS problem FROM events""")
def json_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Whether properties are strict JSON of one field; three of four are spoilt in ways whose outcome is known."""
    k = F.col("event_id") % 4
    spoilt = F.when(k == 0, F.concat("props", F.lit("}"))).when(k == 1, F.lit('{"k": 1, "k": 2}')).when(k == 2, F.lit('{"k": 1, "m": 2}')).otherwise(F.col("props"))
    rows = table(spark, folder, "events", "event_id", "props")
    return rows.select("event_id", json_problem(F.when(F.col("props").isNotNull(), spoilt), F.array(F.lit("k"))).alias("problem"))


@query("SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN ['timeout', 'refusal', 'refusal', 'schema_invalid', 'provider_failure'][event_id % 6] END AS kind FROM events")
def failure_kind(spark: SparkSession, folder: str) -> DataFrame:
    """The kinds of failures, from messages whose kind is known; a sixth are successes."""
    k = F.col("event_id") % 6
    message = F.when(k == 1, "Gateway TIMEOUT").when(k == 2, "a Refusal").when(k == 3, "declined").when(k == 4, "Schema of the answer").otherwise("gone")
    return table(spark, folder, "events", "event_id").select("event_id", visual.failure_kind(k == 0, message).alias("kind"))


@query("SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS leaf FROM events WHERE props IS NOT NULL AND json_valid(props) AND json_exists(props, '$.k') UNION ALL SELECT event_id, 'n.' || i, (event_id % 7 + i)::VARCHAR FROM events, (SELECT unnest([0, 1]) AS i) WHERE props IS NOT NULL")
def flat_properties(spark: SparkSession, folder: str) -> DataFrame:
    """The leaves of JSON properties by dotted path (a nested array is added to each)."""
    from glyphloom.functions.similarity import flat_json

    n = F.col("event_id") % 7
    nested = F.concat(F.expr("left(props, length(props) - 1)"), F.lit(', "n": ['), n.cast("string"), F.lit(", "), (n + 1).cast("string"), F.lit("]}"))
    return table(spark, folder, "events", "event_id", "props").select("event_id", F.explode(flat_json(nested)).alias("path", "leaf"))


@query(
    r"""SELECT line_id, coalesce(nullif(trim(text), ''), '(blank)') AS shown, lag_text IS NOT NULL AND trim(regexp_replace(lower(text), '[\p{Z}\s]+', ' ', 'g')) = trim(regexp_replace(lower(lag_text), '[\p{Z}\s]+', ' ', 'g')) AS repeats FROM (SELECT line_id, text, lag(text) OVER (PARTITION BY frame_id ORDER BY line_index, line_id) AS lag_text FROM (SELECT DISTINCT line_id, frame_id, line_index, text FROM text_lines WHERE text IS NOT NULL))"""
)
def repeated_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that repeat the line above, whatever the case and white space; blank texts are back-filled."""
    rows = table(spark, folder, "text_lines", "line_id", "frame_id", "line_index", "text").distinct().filter("text IS NOT NULL")
    before = F.lag("text").over(Window.partitionBy("frame_id").orderBy("line_index", "line_id"))
    both = rows.withColumn("before", before)
    same = F.coalesce(normalise(F.col("text")) == normalise(F.col("before")), F.lit(False))
    return both.select("line_id", F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.lit("(blank)")).alias("shown"), same.alias("repeats"))


@query(
    """SELECT time_bucket(INTERVAL '1 hour', ts) AS started, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2"""
)
def windowed_events(spark: SparkSession, folder: str) -> DataFrame:
    """The streaming operator's windows over the whole table at once."""
    from glyphloom.streaming.frames import windowed_counts

    rows = windowed_counts(table(spark, folder, "events", "ts", "event_type", "value"), "ts", ["event_type"], "1 hour")
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("started"), "event_type", "n", F.round("mean_value", 6).alias("mean_value"))
