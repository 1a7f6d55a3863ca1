"""Queries over frames, slides and their paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.functions.text import jaccard, normalise, words
from glyphloom.operators import frames as frame_ops
from glyphloom.operators import slides as ops
from glyphloom.operators.sequential import spread, with_previous
from glyphloom.plans.base import query
from glyphloom.plans.layout import LINES, _lines
from glyphloom.sources.tables import latest, table

NORM = r"trim(regexp_replace(lower(coalesce(combined_text, '')), '[\p{Z}\s]+', ' ', 'g'))"
FRAMES = f"""f AS (SELECT frame_id, max_by(struct_pack(video_id := video_id, frame_number := frame_number, combined_text := combined_text), ingested_at) AS k FROM frames WHERE frame_id IS NOT NULL GROUP BY frame_id),
n AS (SELECT frame_id, k.video_id AS video_id, k.frame_number AS frame_number, k.combined_text AS combined_text, {NORM.replace('combined_text', 'k.combined_text')} AS norm FROM f),
g AS (SELECT *, lag(norm) OVER (PARTITION BY video_id ORDER BY frame_number, frame_id) AS before FROM n),
w AS (SELECT *, list_filter(list_distinct(string_split(norm, ' ')), lambda x: x <> '') AS wb, list_filter(list_distinct(string_split(coalesce(before, ''), ' ')), lambda x: x <> '') AS wa FROM g),
j AS (SELECT *, len(list_intersect(wa, wb)) AS both, len(list_distinct(list_concat(wa, wb))) AS every FROM w),
s AS (SELECT *, CASE WHEN before IS NULL OR NOT (starts_with(norm, before) OR CASE WHEN every = 0 THEN true ELSE "both" / every >= 0.6::DOUBLE END) THEN 1 ELSE 0 END AS brk, CASE WHEN before <> norm THEN 1 ELSE 0 END AS chg FROM j),
r AS (SELECT *, sum(brk) OVER (PARTITION BY video_id ORDER BY frame_number, frame_id) AS slide_number FROM s),
b AS (SELECT *, sum(CASE WHEN brk = 1 THEN 0 ELSE chg END) OVER (PARTITION BY video_id, slide_number ORDER BY frame_number, frame_id) AS build_index FROM r)""".replace(" AS both", ' AS "both"')


ORDER = ("frame_number", "frame_id")


def last_frames(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """The last delivery of each frame, with the columns ``more``; ``ORDER`` orders a video's frames."""
    return latest(table(spark, folder, "frames", "frame_id", "video_id", "frame_number", "combined_text", "timestamp_seconds", "ingested_at", *more), "frame_id", "ingested_at")


def runs(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    return ops.slide_runs(last_frames(spark, folder, *more), order=ORDER, counted=table(spark, folder, "frames", "video_id"))


@query(f"WITH {FRAMES} SELECT video_id, slide_number::BIGINT AS slide_number, count(*) AS frames, min(frame_number) AS first_frame, max(frame_number) AS last_frame FROM b GROUP BY video_id, slide_number")
def slide_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs(spark, folder).groupBy("video_id", "slide_number").agg(F.count("*").alias("frames"), F.min("frame_number").alias("first_frame"), F.max("frame_number").alias("last_frame"))


@query(f"WITH {FRAMES} SELECT frame_id, slide_number::BIGINT AS slide_number, build_index::BIGINT AS build_index FROM b")
def build_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs(spark, folder).select("frame_id", "slide_number", "build_index")


@query(f'WITH {FRAMES} SELECT frame_id, round(CASE WHEN every = 0 THEN 1.0 ELSE "both" / every END, 9) AS similarity FROM j WHERE before IS NOT NULL')
def word_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    rows = last_frames(spark, folder).select("frame_id", "video_id", "frame_number", F.coalesce("combined_text", F.lit("")).alias("text"))
    chunks = spread(rows, ["video_id"], list(ORDER), table(spark, folder, "frames", "video_id"))
    return with_previous(chunks, ["video_id"], list(ORDER), "text", "before").filter("before IS NOT NULL").select("frame_id", F.round(jaccard(words(F.col("before")), words(F.col("text"))), 9).alias("similarity"))


@query(
    r"""WITH t AS (SELECT DISTINCT line_id, frame_id, video_id, frame_number, text FROM text_lines WHERE text IS NOT NULL AND frame_id IS NOT NULL AND video_id IS NOT NULL),
k AS (SELECT frame_id, any_value(video_id) AS video_id, any_value(frame_number) AS frame_number, list_sort(list_distinct(list_filter(list(trim(regexp_replace(lower(text), '[\p{Z}\s]+', ' ', 'g'))), lambda x: x <> ''))) AS b FROM t GROUP BY frame_id),
p AS (SELECT *, lag(b) OVER (PARTITION BY video_id ORDER BY frame_number, frame_id) AS a FROM k)
SELECT frame_id, list_sort(list_intersect(a, b)) AS shared_lines, list_sort(list_filter(b, lambda x: NOT list_contains(a, x))) AS added_lines, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS removed_lines,
 round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 9) AS similarity FROM p WHERE a IS NOT NULL"""
)
def frame_compare_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Each frame's lines against those of the frame before: shared, added and removed."""
    lines = table(spark, folder, "text_lines", "line_id", "frame_id", "video_id", "frame_number", "text").distinct().filter("text IS NOT NULL AND frame_id IS NOT NULL AND video_id IS NOT NULL")
    own = lines.withColumn("line", normalise(F.col("text"))).groupBy("frame_id").agg(F.min("video_id").alias("video_id"), F.min("frame_number").alias("frame_number"), F.array_join(F.collect_set("line"), "\n").alias("b"))
    chunks = spread(own, ["video_id"], list(ORDER), table(spark, folder, "frames", "video_id"))
    found = frame_ops.compare_line_sets(F.col("a"), F.col("b"))
    return with_previous(chunks, ["video_id"], list(ORDER), "b", "a").filter("a IS NOT NULL").select("frame_id", *[c.alias(n) if n != "similarity" else F.round(c, 9).alias(n) for n, c in found.items()])


@query(
    f"""WITH {FRAMES}, o AS (SELECT video_id, slide_number, norm, count(*) AS seen, min(struct_pack(frame_id := frame_id, t := combined_text)) AS first FROM b WHERE combined_text IS NOT NULL GROUP BY 1, 2, 3),
x AS (SELECT *, row_number() OVER (PARTITION BY video_id, slide_number ORDER BY seen DESC, length(norm) DESC, first.frame_id) AS k, count(*) OVER (PARTITION BY video_id, slide_number) AS variants FROM o)
SELECT video_id, slide_number::BIGINT AS slide_number, first.t AS best_text, seen AS votes, variants FROM x WHERE k = 1"""
)
def paragraph_vote(spark: SparkSession, folder: str) -> DataFrame:
    """The text that most frames of a slide show."""
    return ops.vote(runs(spark, folder), ["video_id", "slide_number"], "frame_id", "combined_text")


@query(f"WITH {FRAMES} SELECT video_id, count(DISTINCT slide_number) AS slides, count(DISTINCT struct_pack(s := slide_number, b := build_index)) AS builds, count(*) AS frames, count(*) FILTER (WHERE norm <> '') AS frames_with_text FROM b GROUP BY video_id")
def presentation_statistics(spark: SparkSession, folder: str) -> DataFrame:
    rows = runs(spark, folder)
    return rows.groupBy("video_id").agg(F.countDistinct("slide_number").alias("slides"), F.countDistinct("slide_number", "build_index").alias("builds"), F.count("*").alias("frames"), F.count_if(F.col("_norm") != "").alias("frames_with_text"))


@query("SELECT frame_id, count(*) AS deliveries FROM frames GROUP BY frame_id HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "frames", "frame_id").groupBy("frame_id").agg(F.count("*").alias("deliveries")).filter("deliveries > 1")


@query(f"WITH {FRAMES} SELECT frame_id FROM (SELECT frame_id, row_number() OVER (PARTITION BY norm ORDER BY frame_id) AS k FROM n) WHERE k = 1")
def first_occurrence_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The first frame of each text; the least id is found before the shuffle, so a text that many frames share is no burden."""
    rows = last_frames(spark, folder).withColumn("norm", normalise(F.coalesce("combined_text", F.lit(""))))
    return rows.groupBy("norm").agg(F.min("frame_id").alias("frame_id")).select("frame_id")


@query(f"WITH {FRAMES}, m AS (SELECT norm, min(frame_id) AS first_id FROM n GROUP BY norm) SELECT frame_id, first_id FROM n JOIN m USING (norm) WHERE frame_id <> first_id AND norm <> ''")
def duplicate_of_first(spark: SparkSession, folder: str) -> DataFrame:
    """Each later frame with the retained one that it repeats."""
    from glyphloom.session import join_hot, materialize

    rows = last_frames(spark, folder).select("frame_id", normalise(F.coalesce("combined_text", F.lit(""))).alias("norm")).filter("norm <> ''").withColumn("key", F.md5("norm")).drop("norm")
    first = materialize(rows.groupBy("key").agg(F.min("frame_id").alias("first_id"), F.count("*").alias("n")))
    return join_hot(rows, first, "key", "n", "inner").filter("frame_id <> first_id").select("frame_id", "first_id")


@query(
    """WITH e AS (SELECT label, vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings),
d AS (SELECT label, vec_id, unnest(embedding) AS x, unnest(before) AS y FROM e WHERE before IS NOT NULL)
SELECT label, vec_id, round(avg(abs(x::DOUBLE - y::DOUBLE)), 6) AS difference FROM d GROUP BY label, vec_id"""
)
def frame_difference(spark: SparkSession, folder: str) -> DataFrame:
    """The mean absolute difference of consecutive arrays, as of consecutive images."""
    rows = frame_ops.consecutive_differences(table(spark, folder, "embeddings", "label", "vec_id", "embedding"), "label", "vec_id", "embedding")
    return rows.filter("difference IS NOT NULL").select("label", "vec_id", F.round("difference", 6).alias("difference"))


@query("SELECT vec_id, len(list_filter(embedding, lambda x: x > 0)) > 0 AS visible FROM embeddings")
def visible_frames(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings", "vec_id", "embedding").select("vec_id", frame_ops.is_visible(F.col("embedding")).alias("visible"))


def _images(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings", "label", "vec_id", "embedding").select(F.format_string("label-%d", "label").alias("video_id"), F.col("vec_id").alias("frame_number"), F.transform("embedding", lambda x: x.cast("double") * 100).alias("image"))


@query()
def frame_selection(spark: SparkSession, folder: str) -> DataFrame:
    """The frames that show something new, by the scan's state; rows only."""
    return frame_ops.select_frames(_images(spark, folder), fps=5.0)


@query()
def default_visual_frames(spark: SparkSession, folder: str) -> DataFrame:
    images = _images(spark, folder).withColumnRenamed("video_id", "slide")
    return frame_ops.default_frames(images)


@query()
def paragraph_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs of all frames of a slide, each as its best reading; rows only, as readings change while members join."""
    from glyphloom.operators.lines import paragraphs

    slides = runs(spark, folder).select("frame_id", "video_id", "slide_number", "place")
    rows = paragraphs(_lines(spark, folder), "frame_id", "place").join(slides, "frame_id")
    return ops.paragraph_clusters(rows)


@query()
def presentation_end_to_end(spark: SparkSession, folder: str) -> DataFrame:
    """From regions to presented paragraphs: lines, structure, paragraphs, slides, clusters and the evidence for each."""
    from glyphloom.operators.lines import paragraphs, structure
    from glyphloom.plans.layout import _reading
    from glyphloom.operators.lines import reconstruct_lines

    lines = reconstruct_lines(_reading(spark, folder)).filter("line_text IS NOT NULL")
    lines = lines.select("frame_id", "line_number", F.col("line_text").alias("text"), "line_left", "line_top", "line_right", "line_bottom", "confidence").distinct()
    slides = runs(spark, folder, "width", "height").select("frame_id", "video_id", "slide_number", "place", "width", "height")
    rows = paragraphs(structure(lines, "frame_id", "line_number"), "frame_id", "line_number", evidence=True).join(slides, "frame_id")
    shown = ("confidence", "left", "top", "right", "bottom", "width", "height")
    best = ops.paragraph_clusters(rows, shown)
    tiny = ops.tiny_footprint(*[F.col(n) for n in shown[1:]])
    found = ops.assess(F.col("text"), F.col("confidence"), F.col("observations"), tiny, ["Latin"])
    return best.select("video_id", "slide_number", "cluster", "text_type", "text", "observations", *[found[n].alias(n) for n in ("scripts", "withheld", "reasons")])


PROMOTED = r"""p AS (SELECT DISTINCT promotion_id, text, confidence, observation_count FROM promotion_records WHERE text IS NOT NULL),
t AS (SELECT *, list_filter(string_split(trim(regexp_replace(text, '[\p{Z}\s]+', ' ', 'g')), ' '), lambda x: x <> '') AS tk, trim(regexp_replace(text, '[\p{Z}\s]+', ' ', 'g')) AS c FROM p),
q AS (SELECT *, len(tk) > 0 AND len(list_filter(tk, lambda x: NOT regexp_full_match(x, '\p{L}+'))) = 0 AND CASE WHEN len(tk) = 1 THEN length(tk[1]) = 1 ELSE len(list_filter(tk, lambda x: length(x) = 1)) * 2 >= len(tk) END AS fragment,
 regexp_full_match(trim(text), '\S(?:.{0,14}\S)?') AND (regexp_matches(text, '\p{Nd}') OR regexp_full_match(trim(text), '\p{Ll}') OR regexp_full_match(trim(text), '\p{Lu}{2,5}')) AS protected FROM t)"""


@query(f"WITH {PROMOTED} SELECT promotion_id, fragment FROM q")
def fragment_like(spark: SparkSession, folder: str) -> DataFrame:
    from glyphloom.functions.text import is_fragment

    return table(spark, folder, "promotion_records", "promotion_id", "text").distinct().filter("text IS NOT NULL").select("promotion_id", is_fragment(F.col("text")).alias("fragment"))


@query(f"WITH {PROMOTED} SELECT promotion_id, protected FROM q")
def protected_short_content(spark: SparkSession, folder: str) -> DataFrame:
    from glyphloom.functions.text import is_protected_short

    return table(spark, folder, "promotion_records", "promotion_id", "text").distinct().filter("text IS NOT NULL").select("promotion_id", is_protected_short(F.col("text")).alias("protected"))


SCRIPT_TESTS = r"""list_filter([CASE WHEN regexp_matches(x, '\p{Latin}') THEN 'Latin' END, CASE WHEN regexp_matches(x, '\p{Hebrew}') THEN 'Hebrew' END, CASE WHEN regexp_matches(x, '\p{Arabic}') THEN 'Arabic' END,
 CASE WHEN regexp_matches(x, '\p{Cyrillic}') THEN 'Cyrillic' END, CASE WHEN regexp_matches(x, '\p{Hangul}') THEN 'Hangul' END, CASE WHEN regexp_matches(x, '\p{Han}') THEN 'Han' END,
 CASE WHEN regexp_matches(regexp_replace(x, '[\p{Latin}\p{Hebrew}\p{Arabic}\p{Cyrillic}\p{Hangul}\p{Han}]', '', 'g'), '\p{L}') OR x <> y THEN 'Other/Unknown' END], lambda z: z IS NOT NULL)"""


@query(
    r"""WITH p AS (SELECT DISTINCT promotion_id, text FROM promotion_records WHERE text IS NOT NULL), w AS (SELECT promotion_id, regexp_replace(text, '[^\p{L}]', '', 'g') AS y FROM p),
v AS (SELECT promotion_id, y, regexp_replace(y, '[Ａ-Ｚａ-ｚ]', '', 'g') AS x FROM w) SELECT promotion_id, """
    + SCRIPT_TESTS
    + " AS scripts FROM v"
)
def script_observation(spark: SparkSession, folder: str) -> DataFrame:
    from glyphloom.functions.text import observed_scripts

    return table(spark, folder, "promotion_records", "promotion_id", "text").distinct().filter("text IS NOT NULL").select("promotion_id", observed_scripts(F.col("text")).alias("scripts"))


@query(
    f"WITH {PROMOTED}"
    + r""", w AS (SELECT *, regexp_replace(text, '[^\p{L}]', '', 'g') AS y FROM q), v AS (SELECT *, regexp_replace(y, '[Ａ-Ｚａ-ｚ]', '', 'g') AS x FROM w),
s AS (SELECT *, """
    + SCRIPT_TESTS
    + """ AS scripts FROM v), f AS (SELECT *, len(list_filter(scripts, lambda z: z <> 'Latin')) > 0 AS foreign_, coalesce(confidence <= 0.7::DOUBLE, false) AS weak, coalesce(observation_count <= 1, false) AS once FROM s),
h AS (SELECT *, fragment AND weak AND once AND NOT protected AND NOT foreign_ AS withheld FROM f)
SELECT promotion_id, withheld, list_filter([CASE WHEN foreign_ THEN 'Script Mismatch' END, CASE WHEN withheld THEN 'Fragment-like Structure' END, CASE WHEN withheld THEN 'Weak OCR Evidence' END, CASE WHEN withheld AND once THEN 'Uncorroborated Observation' END], lambda z: z IS NOT NULL) AS reasons FROM h"""
)
def promotion_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The evidence for and against each text (no box is known here, so none is tiny)."""
    rows = table(spark, folder, "promotion_records", "promotion_id", "text", "confidence", "observation_count").distinct().filter("text IS NOT NULL")
    found = ops.assess(F.col("text"), F.col("confidence"), F.col("observation_count"), F.lit(False), ["Latin"])
    return rows.select("promotion_id", found["withheld"].alias("withheld"), found["reasons"].alias("reasons"))
