"""What reports and files hold, as rows; and writing them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphloom.operators.sequential import per_group
from glyphloom.session import if_small, join_hot, materialize

# The columns of files and sheets.
CSV_COLUMNS = ["Slide Number", "Paragraph Type", "Paragraph Text"]
STATISTICS_COLUMNS = "ocr_region_count ocr_confidence_minimum ocr_confidence_maximum ocr_confidence_mean ocr_confidence_median ocr_below_threshold_count ocr_below_threshold_proportion ocr_confidence_threshold".split()
SHEET_COLUMNS = ["Slide", "Original Text", "Initial AI Translation", "Modified Translation", "Verified"]
TRANSLATION_COLUMNS = ["Source Item", "Slide", "Original Text", "Target Language", "Initial AI Translation", "Translation Status", "Provider", "Model", "Request ID", "Source Reference", "Source Type", "Error", "Review Status", "Review Warnings"]
#: Names whose first so many characters differ (in lower case, up to a number in brackets) stay different when they are cut and numbered.
NAME_BLOCK = 16


def csv_rows(paragraphs: DataFrame, slide: str, kind: str, text: str) -> DataFrame:
    """One row per paragraph with text."""
    return paragraphs.filter(F.trim(F.coalesce(text, F.lit(""))) != "").select(F.col(slide).alias(CSV_COLUMNS[0]), F.upper(kind).alias(CSV_COLUMNS[1]), F.col(text).alias(CSV_COLUMNS[2]))


def with_statistics(rows: DataFrame, statistics: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` with the eight statistics of their document beside each row; ``statistics`` has one row per ``key``, whose ``columns`` come in the order of the file."""
    named = statistics.select(key, *[F.col(c).alias(n) for c, n in zip(columns, STATISTICS_COLUMNS)])
    return rows.join(named, key, "left")


def sheet_rows(paragraphs: DataFrame, slide: str, text: str) -> list[Column]:
    """The columns of a sheet for translators: only the original text is filled in."""
    return [F.col(slide).alias(SHEET_COLUMNS[0]), F.col(text).alias(SHEET_COLUMNS[1]), *[F.lit("").alias(c) for c in SHEET_COLUMNS[2:]]]


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("_name", "_low", "_block")]))
def sheet_name(document: pd.Series) -> pd.DataFrame:
    """A document's name as a sheet may have it, not yet unique; as it is cut, in lower case; and what it shares with every name that it may clash with, numbered or not."""
    names = [re.sub(r"[:\\/?*\[\]]", "_", str(d)).strip() or "Video" for d in document]
    lows = [n[:31].lower() for n in names]
    return pd.DataFrame({"_name": names, "_low": lows, "_block": [low.replace("ς", "σ").split(" (")[0][:NAME_BLOCK] for low in lows]})


def _named(_: tuple, rows: Iterable[tuple]) -> Iterator[tuple]:
    from glyphloom.operators.translation import planner

    plan = planner()
    return ((document, count, plan(name)) for _, _, document, count, name in rows)


def consolidated(rows: DataFrame, document: str, place: str) -> DataFrame:
    """``rows`` with ``sheet``, the unique name of their document's sheet in one workbook, in the order of ``place`` (the first of each document's); raises without documents, of which there may be any number.

    Names that no other is like, and that do not end with a number as given to names that are, stay as they are. All others are planned in order, those
    of one block (see ``sheet_name``) together, as names of different blocks never clash.
    """
    each = rows.filter(F.col(document).isNotNull()).groupBy(F.col(document).alias("_document")).agg(F.min(place).alias("_place"), F.count("*").alias("_rows"))
    named = materialize(each.withColumn("_n", sheet_name("_document")).select("_document", "_place", "_rows", "_n.*"))
    if named.isEmpty():
        raise ValueError("a workbook has at least one sheet")
    like = (F.count("*").over(Window.partitionBy("_low")) > 1) | F.col("_low").rlike(r" \([0-9]+\)$")
    told = named.withColumn("_like", like)
    alone = told.filter(~F.col("_like")).select("_document", "_rows", F.left("_name", F.lit(31)).alias("sheet"))
    others = told.filter("_like").select("_block", "_place", "_document", "_rows", "_name")
    planned = per_group(others, ["_block"], ["_place", "_document"], _named, f"_document {rows.schema[document].dataType.simpleString()}, _rows long, sheet string")
    names = materialize(alone.unionByName(planned)).withColumnRenamed("_document", document)
    return join_hot(rows, if_small(names), document, "_rows", "inner")


def translation_rows(records: DataFrame) -> DataFrame:
    """The fourteen columns of a translation file, of ``records`` with those values in snake case (``source_item`` ... ``review_warnings`` as an array of codes); nulls are empty texts."""
    value = lambda c: F.array_join("review_warnings", "; ") if c == "review_warnings" else F.coalesce(F.col(c).cast("string"), F.lit(""))
    return records.select(*[value(n.lower().replace(" ", "_")).alias(n) for n in TRANSLATION_COLUMNS])


def metadata_rows(rows: DataFrame, key: str, fields: list[str], metadata: str) -> DataFrame:
    """``key, field, value``: the hidden sheet of a workbook, a row per field of each row, and per entry of its ``metadata`` map whose key names no secret. Null values have no row."""
    from glyphloom.operators.translation import safe_metadata

    own = F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.col(f).cast("string") for f in fields]))
    every = F.map_concat(own, F.coalesce(safe_metadata(F.col(metadata)), F.create_map().cast("map<string,string>")))
    return rows.select(key, F.explode(every).alias("field", "value")).filter("value IS NOT NULL")


def markdown_line(kind: Column, text: Column) -> Column:
    """A paragraph in Markdown: titles as headings, bullets as items, all else as it is."""
    return F.when(F.upper(kind) == "TITLE", F.concat(F.lit("## "), text)).when(F.upper(kind) == "BULLET", F.concat(F.lit("- "), text)).otherwise(text)


def markdown_documents(paragraphs: DataFrame, document: str, slide: str, order: list[str], kind: str, text: str) -> DataFrame:
    """``document, markdown``: one text per document, with a heading for each slide."""
    filled = paragraphs.filter(F.trim(F.coalesce(text, F.lit(""))) != "")
    line = F.struct(F.col(slide).alias("s"), *[F.col(o).alias(f"o{k}") for k, o in enumerate(order)], markdown_line(F.col(kind), F.col(text)).alias("t"))
    slides = filled.groupBy(document, slide).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    part = F.concat(F.lit("# Slide "), F.col(slide).cast("string"), F.lit("\n\n"), F.array_join(F.transform("lines", lambda x: x["t"]), "\n\n"))
    return slides.groupBy(document).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(slide).alias("s"), part.alias("p")))), lambda x: x["p"]), "\n\n").alias("markdown"))


def long_report(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Metrics of wide rows in long form; nulls stay, as a report shows them."""
    return rows.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(keys, metrics, "metric", "value")


def frame_file(number: Column, seconds: Column) -> Column:
    return F.format_string("frame_%06d_%.2fs.png", number, seconds)


def top_bounded(regions: DataFrame, group: str, order: list[str], text: str, most: int = 50, width: int = 500) -> DataFrame:
    """The first ``most`` regions of each group with texts cut to ``width`` and a mark where they were: a prompt's bounds."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return regions.withColumn("place", place).filter(F.col("place") <= most).withColumns({"shown": F.left(text, F.lit(width)), "cut": F.length(text) > width})


def write_csv(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    rows.write.mode("overwrite" if overwrite else "errorifexists").csv(path, header=True, escape='"')


def write_json(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = rows.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def write_text(rows: DataFrame, path: str, column: str) -> None:
    rows.select(column).write.mode("errorifexists").text(path)


#: The writers by format name.
WRITERS = {"csv": write_csv, "json": write_json, "parquet": lambda rows, path: rows.write.mode("errorifexists").parquet(path), "orc": lambda rows, path: rows.write.mode("errorifexists").orc(path)}


def export_all(rows: DataFrame, folder: str, formats: list[str]) -> dict[str, str]:
    """Write ``rows`` in each format, each to its own path below ``folder``; unknown formats are refused before anything is written."""
    unknown = sorted(set(formats) - set(WRITERS))
    if unknown:
        raise ValueError("unknown formats: " + ", ".join(unknown))
    out = {}
    for name in formats:
        out[name] = f"{folder}/{name}"
        WRITERS[name](rows, out[name])
    return out
