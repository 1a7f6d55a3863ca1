"""Statistics of each text, repetition included, and its shape: prose, list, table or junk.

All statistics come from one pass of ``measures`` over Arrow batches; nothing is shuffled but the counts of repeated lines. Shapes follow from combined rules over
them, in this order; ``body`` is the text without its source's notices:

* junk: few of its tokens are readable words (two letters or more, not consonants alone, no digits or signs inside) or numbers;
* list: most characters stand in lines that start with a bullet, number or letter;
* table: most characters stand in lines that are cut into cells, with as many cells in most of these lines;
* junk again: few readable words, whatever the numbers;
* list: most characters stand in such lines or in blocks of short lines in which no sentence ends;
* junk, boilerplate: the text says the same again and again, as most of its lines or paragraphs repeat earlier ones, or one run of two to four words covers most of it (texts of ``REPEATING_WORDS`` or more);
* prose: all else.

Full-width forms are mapped and invisible characters dropped first, so that disguised prose isn't taken for junk.

Null and empty texts have zero counts, null shares and no shape; texts under ``LEAST_CHARACTERS`` have no shape. Repeated rows give repeated rows. A column of the same name as a
statistic is replaced; all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from glyphloom.llm.lookalikes import wide_maps
from glyphloom.llm.measures import FIELDS, SHARES, measure
from glyphloom.llm.repeated_lines import without_notices

LEAST_CHARACTERS = 40
READABLE = 0.4
MOST = 0.5
#: Words that a text must have to be said to repeat itself.
REPEATING_WORDS = 30
WIDE = r"[\x{a0}-\x{ffff}](?<=[\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\x{ff01}-\x{ff5e}\p{Cf}])"


def _share(part: str | Column, whole: str) -> Column:
    part = F.col(part) if isinstance(part, str) else part
    return F.when(F.col(whole) > 0, part / F.col(whole))


def measured(texts: DataFrame, text: str = "text", drop: bool = False) -> DataFrame:
    """``texts`` with the counts and shares of ``measures`` for column ``text``, which is left out if ``drop`` is given. Each text is read once, whatever is asked of the result."""
    names = [c for c in texts.columns if c not in (*FIELDS, *SHARES) or c == text]
    own = texts.select(*names)
    kept = [f for f in own.schema.fields if not (drop and f.name == text)]
    schema = StructType(kept + [StructField(n, LongType()) for n in FIELDS] + [StructField(n, DoubleType()) for n in SHARES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure([t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()])
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            columns += [pa.array(found[n], pa.int64()) for n in FIELDS] + [pa.array(found[n], pa.float64(), from_pandas=True) for n in SHARES]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return own.mapInArrow(run, schema)


def shares(counted: DataFrame) -> DataFrame:
    """The shares that follow from the counts."""
    return counted.withColumns(
        {
            "mean_word_length": _share("n_visible", "n_words"),
            "symbol_share": _share("n_symbols", "n_visible"),
            "ended_line_share": _share("n_ended_lines", "n_lines"),
            "common_word_share": _share(F.least("n_common", "n_words"), "n_words"),
            "readable_share": _share(F.least("n_readable", "n_words"), "n_words"),
            "sound_share": _share(F.col("n_readable") + F.col("n_numbers"), "n_tokens"),
            "duplicate_line_share": _share("repeated_lines", "n_lines"),
            "duplicate_paragraph_share": _share("repeated_paragraphs", "n_paragraphs"),
            "bullet_share": _share("bullet_visible", "n_visible"),
            "list_share": _share(F.col("bullet_visible") + F.col("plain_visible"), "n_visible"),
            "table_share": _share("table_visible", "n_visible"),
        }
    ).drop("repeated_lines", "repeated_paragraphs", "bullet_visible", "plain_visible", "table_visible")


def statistics(texts: DataFrame, text: str = "text", drop: bool = False) -> DataFrame:
    """``texts`` with all statistics of column ``text``; other columns stay."""
    return shares(measured(texts, text, drop))


def shape(characters: Column) -> Column:
    """The shape of a text of so many ``characters``, from the statistics of its body."""
    repeats = F.greatest("dominant_bigram_share", "dominant_trigram_share", "dominant_4gram_share", "duplicate_line_share", "duplicate_paragraph_share")
    return (
        F.when((characters < LEAST_CHARACTERS) | characters.isNull() | (F.col("n_visible") == 0), F.lit(None).cast("string"))
        .when(F.coalesce("sound_share", F.lit(0.0)) < READABLE, "junk")
        .when((F.col("bullet_share") > MOST) & (F.col("readable_share") >= READABLE), "list")
        .when(F.col("table_share") > MOST, "table")
        .when(F.col("readable_share") < READABLE, "junk")
        .when(F.col("list_share") > MOST, "list")
        .when((F.col("n_words") >= REPEATING_WORDS) & (repeats > MOST), "junk")
        .otherwise("prose")
    )


def shaped(texts: DataFrame, text: str = "text", body: str = "body") -> DataFrame:
    """``texts`` without ``text`` and ``body``, with the statistics of ``body`` and ``text_shape``."""
    wide = F.regexp_replace(F.translate(F.col(body), *wide_maps()), r"\p{Cf}+", "")
    clear = F.when(F.col(body).rlike(r"[^\x00-\x7f]") & F.col(body).rlike(WIDE), wide).otherwise(F.col(body))
    own = texts.withColumns({body: clear, "_characters": F.char_length(text)}).drop(*([] if text == body else [text]))
    return statistics(own, body, drop=True).withColumn("text_shape", shape(F.col("_characters"))).drop("_characters")


def shapes(documents: DataFrame, promotions: DataFrame) -> DataFrame:
    """``record_kind, record_id, text_shape`` and statistics of every document and promotion record; repeated rows give repeated rows."""
    own = without_notices(documents, ["doc_id", "text"]).select(F.lit("document").alias("record_kind"), F.col("doc_id").alias("record_id"), "text", "body")
    other = promotions.select(F.lit("promotion").alias("record_kind"), F.col("promotion_id").alias("record_id"), "text", F.col("text").alias("body"))
    return shaped(own.unionByName(other))
