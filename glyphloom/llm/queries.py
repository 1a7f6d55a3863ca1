"""The queries pN_... of this subpackage, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm import languages, lookalikes, mixing, near_duplicates, packing, quality, quantiles, repeated_lines, scans, splitting
from glyphloom.functions.text import observed_scripts
from glyphloom.llm.oracles import ORACLES  # noqa: F401
from glyphloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# 1: look-alike characters
@query
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes.disguised(table(spark, folder, "regions", "region_id", "text"), table(spark, folder, "promotion_records", "promotion_id", "text", "observed_scripts"))


@query
def p1_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every region's text in consistent form, with its scripts."""
    formed = lookalikes.consistent(table(spark, folder, "regions", "region_id", "text").distinct())
    return formed.select("region_id", "text", "canonical", observed_scripts(F.col("canonical")).alias("scripts"))


# 2: scanned pages
def _scan_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, folder, "regions"), table(spark, folder, "paragraphs", "paragraph_id", "video_id", "text"), table(spark, folder, "benchmark_slides", "benchmark_id", "video_id", "candidate_text")


@query
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return scans.scan_noise(*_scan_tables(spark, folder))


@query
def p2_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """The regions of each frame, and paragraph and candidate texts, as continuous readable paragraphs."""
    return scans.readable_paragraphs(*_scan_tables(spark, folder))


# 3: quality statistics
@query
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality.shapes(table(spark, folder, "documents", "doc_id", "source", "text"), table(spark, folder, "promotion_records", "promotion_id", "text"))
    return rows.filter("text_shape <> 'prose'").select("record_kind", "record_id", "text_shape").distinct()


STATISTICS = (
    "n_characters n_words n_visible n_symbols n_lines n_ended_lines n_readable n_common n_sentence_ends n_tokens n_numbers n_paragraphs mean_word_length symbol_share ended_line_share common_word_share "
    "readable_share sound_share duplicate_line_share duplicate_paragraph_share dominant_bigram_share dominant_trigram_share dominant_4gram_share"
).split()


@query
def p3_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """All statistics of every document and promotion record text."""
    own = table(spark, folder, "documents", "doc_id", "text").select(F.lit("document").alias("record_kind"), F.col("doc_id").alias("record_id"), "text")
    other = table(spark, folder, "promotion_records", "promotion_id", "text").select(F.lit("promotion").alias("record_kind"), F.col("promotion_id").alias("record_id"), "text")
    return quality.statistics(own.unionByName(other.distinct()), drop=True).select("record_kind", "record_id", *STATISTICS)


# 4: near-duplicates
@query
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    classes, members = near_duplicates.word_classes(table(spark, folder, "frames", "frame_id", "combined_text"), "frame_id", "combined_text")
    linked = near_duplicates.similar_classes(classes)
    return near_duplicates.record_pairs(classes, members, linked).select(F.col("record_a").alias("frame_id_a"), F.col("record_b").alias("frame_id_b"))


@query
def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row per frame: its class of equal texts, its group of similar ones and its number of links."""
    return near_duplicates.groups(table(spark, folder, "frames", "frame_id", "combined_text"), "frame_id", "combined_text").withColumnRenamed("record", "frame_id")


# 5: percentiles
@query
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return quantiles.wrong_medians(table(spark, folder, "regions"), table(spark, folder, "confidence_stats")).select("stats_id")


@query
def p5_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles per video, run and engine, from sketches of each day's arrivals."""
    keys = ["video_id", "run_id", "engine"]
    rows = quantiles.usable(table(spark, folder, "regions")).withColumn("arrived", F.to_date("ingested_at"))
    daily = quantiles.sketch(rows, [*keys, "arrived"], "confidence")
    return quantiles.percentiles(quantiles.merge(daily, keys), keys, [0.05, 0.25, 0.5, 0.75, 0.95])


# 6: languages
def _language_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "documents", "doc_id", "source", "lang", "text"), table(spark, folder, "workbook_rows", "row_id", "source_language", "original_text")


@query
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return languages.mislabelled(languages.recognised(*_language_tables(spark, folder)))


@query
def p6_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Every segment with its language and confidence."""
    return languages.recognised(*_language_tables(spark, folder), details=True)


# 7: repeated lines
@query
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_lines.repeated_records(table(spark, folder, "documents"), table(spark, folder, "text_lines", "line_id", "video_id", "frame_id", "line_index", "text"))


@query
def p7_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """The frequent line sequences of each source."""
    patterns, _ = repeated_lines.repeated_document_lines(table(spark, folder, "documents"))
    return patterns.select("source", F.transform("pattern", lambda h: F.hex(h)).alias("pattern"), "support", "total")


@query
def p7_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """The documents without their repeated lines."""
    documents = table(spark, folder, "documents", "doc_id", "source", "text")
    _, lines = repeated_lines.repeated_document_lines(documents)
    return repeated_lines.without_lines(documents, lines)


# 8: packing
@query
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return packing.split_documents(packing.pack(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "container_specs")))


@query
def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every container with its fill."""
    return packing.containers(packing.pack(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "container_specs")))


@query
def p8_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """What holds for the containers of each spec: every byte is in one of them, none is overfull, and there are no more than two per cent, or two, above the least number."""
    return packing.bounds(packing.pack(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "container_specs")))


# 9: mixing
@query
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    _, report = mixing.mix(table(spark, folder, "documents", "doc_id", "source", "text"), table(spark, folder, "mix_targets"))
    return report.filter("short").select("mix_id", "source")


@query
def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares reached by the chosen documents."""
    _, report = mixing.mix(table(spark, folder, "documents", "doc_id", "source", "text"), table(spark, folder, "mix_targets"))
    return report.select("mix_id", "source", "target_share", "reached_share", "target_bytes", "reached_bytes", "documents", "most_repeats", "short")


@query
def p9_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each source comes within two per cent, or its smallest document with any bytes, of its target (a source of a dozen documents or less: its largest one). All do that are not short."""
    documents = table(spark, folder, "documents", "doc_id", "source", "text")
    _, report = mixing.mix(documents, table(spark, folder, "mix_targets"))
    size = F.octet_length("text")
    own = documents.filter("text <> ''").groupBy("source").agg(F.min(size).alias("_least"), F.max(size).alias("_most"))
    step = F.coalesce(F.when(F.col("source_documents") <= mixing.LEFT, F.col("_most")).otherwise(F.col("_least")), F.lit(0))
    off = F.abs(F.col("reached_bytes") - F.col("target_bytes"))
    return report.join(own, "source", "left").select("mix_id", "source", (off <= F.greatest(step, F.col("target_bytes") * 0.02)).alias("met"))


@query
def p9_chosen(spark: SparkSession, folder: str) -> DataFrame:
    """The chosen documents with their repeats."""
    return mixing.mix(table(spark, folder, "documents", "doc_id", "source", "text"), table(spark, folder, "mix_targets"))[0]


# 10: splitting
@query
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    pieces = splitting.split_oversized(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "container_specs"))
    return pieces.filter("piece_number = 2").select("spec_id", "doc_id").distinct()


@query
def p10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document, with its text."""
    return splitting.split_oversized(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "container_specs"))
