"""Files of references, candidates and cases, with strict schemas; videos of a folder by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.functions.similarity import json_problem
from glyphloom.functions.text import is_safe_relative_path
from glyphloom.operators.sequential import numbered
from glyphloom.session import materialize

VIDEO_ENDINGS = [".mp4", ".avi", ".mov", ".mkv"]
CANDIDATE_SCHEMA = "`Slide Number` int, `Paragraph Type` string, `Paragraph Text` string"


def benchmark_json(spark: SparkSession, path: str, text_field: str) -> DataFrame:
    """``video, slide_id, frame_index, text, notes, place`` of a benchmark file; a file of another shape fails.

    One document per file; slides keep their order in ``place``.
    """
    schema = f"video string, slides array<struct<slide_id string, frame_index long, {text_field} string, notes string>>"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.select("video", F.posexplode("slides").alias("place", "s")).select("video", F.col("s.slide_id").alias("slide_id"), F.col("s.frame_index").alias("frame_index"), F.col(f"s.{text_field}").alias("text"), F.col("s.notes").alias("notes"), "place")


def missing_fields(rows: DataFrame) -> DataFrame:
    """Rows of a benchmark that lack what a slide must have: its id or its text."""
    return rows.filter(F.col("slide_id").isNull() | (F.trim("slide_id") == "") | F.col("text").isNull())


def candidate_csv(spark: SparkSession, path: str) -> DataFrame:
    """``slide_number, text`` of an exported file: the paragraphs of a slide in the file's order, joined by line ends."""
    rows = spark.read.schema(CANDIDATE_SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    placed = rows.select(F.col("Slide Number").alias("slide_number"), F.col("Paragraph Text").alias("text"), F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("k")).alias("place"))
    return placed.groupBy("slide_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n").alias("text"))


def verified_corpus(manifest: DataFrame, truth: DataFrame, key: str = "frame_id", status: str = "verification_status") -> DataFrame:
    """The manifest with its verified texts; raises if a frame has none, has several, or is not verified."""
    counts = truth.groupBy(key).agg(F.count("*").alias("n"), F.max(status).alias("s"))
    bad = manifest.select(key).join(counts, key, "left").filter("n IS NULL OR n > 1 OR s <> 'Verified'").limit(3).collect()
    if bad:
        raise ValueError("frames without one verified text: " + ", ".join(str(r[0]) for r in bad))
    return manifest.join(truth, key)


def videos_in_folder(spark: SparkSession, folder: str) -> DataFrame:
    """``path, place`` of the videos of a folder, not of those below it, by name in lower case; contents are never read. Raises if there are none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path")
    named = files.withColumn("_name", F.lower(F.regexp_extract("path", r"([^/]+)$", 1)))
    own = materialize(named.filter(F.regexp_extract("_name", r"(\.[^.]+)$", 1).isin(VIDEO_ENDINGS)))
    if own.isEmpty():
        raise ValueError(f"no videos in {folder}")
    return numbered(own, ["_name", "path"]).drop("_name")


# The layouts that a frame of the preprocessing benchmark may have.
LAYOUTS = (
    "title heading large_text high_contrast nearly_perfect anti_aliased structured_sections headings small_text fragmented_regions dense_text body_paragraph lower_contrast "
    "evolving_content sparse_text known_errors citations punctuation"
).split()
FRAME = "struct<frame_id string, image string, reference_text string, selection_reason string, layout_categories array<string>, notes string>"


def frame_manifest(spark: SparkSession, path: str, layouts: list[str] | None = None) -> DataFrame:
    """``frame_id, image, reference_text, selection_reason, layout_categories, notes`` of a manifest of version 1, by ``frame_id``; images get the manifest's folder in front.

    Raises for another version, for fields that are missing or empty, for an id that occurs twice, and, where ``layouts`` are given, for a category that is none of them.
    """
    whole = spark.read.schema(f"schema_version int, frames array<{FRAME}>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    if not whole.filter("schema_version <> 1 OR schema_version IS NULL OR frames IS NULL").isEmpty():
        raise ValueError(f"{path} is no manifest of version 1")
    rows = materialize(whole.select(F.inline("frames")))
    lacks = F.lit(False)
    for name in ("frame_id", "image", "reference_text", "selection_reason"):
        lacks = lacks | F.col(name).isNull() | (F.col(name) == "")
    lacks = lacks | F.col("layout_categories").isNull()
    if layouts is not None:
        lacks = lacks | (F.size(F.array_except("layout_categories", F.array(*[F.lit(x) for x in layouts]))) > 0)
    again = rows.groupBy("frame_id").agg(F.count("*").alias("n")).filter("n > 1")
    bad = [r[0] for r in rows.filter(lacks).select("frame_id").limit(3).collect()] + [r[0] for r in again.select("frame_id").limit(3).collect()]
    if bad:
        raise ValueError("frames with missing, unknown or repeated values: " + ", ".join(map(str, bad)))
    base = path.rstrip("/").rpartition("/")[0]
    return rows.withColumns({"image": F.concat(F.lit(base + "/"), "image"), "notes": F.coalesce("notes", F.lit(""))}).orderBy("frame_id")


# The fields of a case of the visual evaluation.
CASE_FIELDS = (
    "schema_version case_id category image ocr_context allowed_content_types required_relationships allowed_relationships required_details allowed_facts prohibited_claims "
    "expected_uncertainty human_review_required notes"
).split()


def visual_cases(spark: SparkSession, folder: str) -> DataFrame:
    """``file, case_id, document`` of the cases of a folder (one JSON file each), by file name in lower case.

    Raises without cases, and names the files whose text is no strict JSON object of exactly the fields of version 1, whose image leaves the folder, or whose id another one has.
    """
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(folder).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("document"))
    image = F.get_json_object("document", "$.image")
    problem = F.coalesce(json_problem("document", F.lit(CASE_FIELDS)), F.when(F.get_json_object("document", "$.schema_version") != "1", "another version"), F.when(~F.coalesce(is_safe_relative_path(image), F.lit(False)), "image outside of the folder"))
    rows = materialize(files.withColumns({"case_id": F.get_json_object("document", "$.case_id"), "problem": problem}))
    again = rows.groupBy("case_id").agg(F.count("*").alias("n"), F.min("file").alias("file")).filter("n > 1")
    bad = [f"{r[0]} ({r[1]})" for r in rows.filter("problem IS NOT NULL").orderBy("file").limit(3).select("file", "problem").collect()] + [f"{r[0]} (repeated id)" for r in again.select("file").limit(3).collect()]
    if bad or rows.isEmpty():
        raise ValueError("cases that cannot be read: " + (", ".join(bad) or "none there"))
    return rows.drop("problem").orderBy(F.lower("file"))
