"""Aligning references with candidates, and scoring them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.functions.similarity import character_edits, error_rate, word_edits
from glyphloom.functions.text import collapse
from glyphloom.session import materialize


def unique_keys(rows: DataFrame, group: list[str], key: str, marker: str) -> DataFrame:
    """``rows`` with ``marker``: the key where it is not null and occurs once in its group, else null. Counted before the shuffle, so a hot key is no burden."""
    once = rows.filter(F.col(key).isNotNull()).groupBy(*group, key).agg(F.count("*").alias("_n")).filter("_n = 1").drop("_n").withColumn(marker, F.col(key))
    return rows.join(once, [*group, key], "left")


def align(reference: DataFrame, candidate: DataFrame, group: list[str], row: str, first: str, second: str) -> DataFrame:
    """``group, reference_row, candidate_row, method``: rows matched on ``first`` where it is unique on both sides; those left, on ``second`` likewise.

    Rows without a match have null on the other side. ``row`` identifies rows on each side.
    """

    def step(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
        a = unique_keys(left, group, key, "_k").filter("_k IS NOT NULL").select(*group, "_k", F.col(row).alias("reference_row"))
        b = unique_keys(right, group, key, "_k").filter("_k IS NOT NULL").select(*group, "_k", F.col(row).alias("candidate_row"))
        return a.join(b, [*group, "_k"]).select(*group, "reference_row", "candidate_row", F.lit(key).alias("method"))

    reference, candidate = materialize(reference), materialize(candidate)
    one = materialize(step(reference, candidate, first))
    rest = reference.join(one.select(F.col("reference_row").alias(row)), row, "left_anti"), candidate.join(one.select(F.col("candidate_row").alias(row)), row, "left_anti")
    matched = materialize(one.unionByName(step(*rest, second)))
    missing = reference.join(matched.select(F.col("reference_row").alias(row)), row, "left_anti").select(*group, F.col(row).alias("reference_row"), F.lit(None).cast(candidate.schema[row].dataType).alias("candidate_row"), F.lit("missing").alias("method"))
    extra = candidate.join(matched.select(F.col("candidate_row").alias(row)), row, "left_anti").select(*group, F.lit(None).cast(reference.schema[row].dataType).alias("reference_row"), F.col(row).alias("candidate_row"), F.lit("unmatched").alias("method"))
    return matched.unionByName(missing).unionByName(extra)


def positional(left: DataFrame, right: DataFrame, group: list[str], order: str, text: str) -> DataFrame:
    """Two lists side by side by position in their group; what one side lacks is an empty text."""
    place = lambda df, name: df.select(*group, F.row_number().over(Window.partitionBy(*group).orderBy(order)).alias("position"), F.col(text).alias(name))
    return place(left, "left_text").join(place(right, "right_text"), [*group, "position"], "full").fillna("", ["left_text", "right_text"])


def scored(pairs: DataFrame, reference: str, candidate: str) -> DataFrame:
    """Character and word edits of pairs and their rates; rates of empty references are null, and coverage is what no deletion lacks."""
    r, c = collapse(F.col(reference)), collapse(F.col(candidate))
    both = pairs.withColumns({"_r": r, "_c": c}).withColumns({"characters": character_edits("_r", "_c"), "words": word_edits("_r", "_c")})
    n, w = F.length("_r"), F.size(F.filter(F.split("_r", " "), lambda x: x != ""))
    return both.withColumns(
        {
            "reference_characters": n,
            "reference_words": w,
            "cer": error_rate(F.col("characters.errors"), n),
            "wer": error_rate(F.col("words.errors"), w),
            "coverage": F.when(n > 0, F.greatest(F.lit(0.0), 1 - F.col("characters.deletions") / n)),
            "exact": F.col("_r") == F.col("_c"),
        }
    ).drop("_r", "_c")


def difference_labels(reference: Column, candidate: Column) -> Column:
    """What sets two texts apart, from the least to the most; an empty list for equal texts."""
    tight = lambda t: F.regexp_replace(t, r"\s+", "")
    bare = lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}\s]", "")
    r, c = collapse(reference), collapse(candidate)
    lines = F.size(F.split(reference, "\n")), F.size(F.split(candidate, "\n"))
    spacing, capitals = (r != c) & (tight(r) == tight(c)), (r != c) & (F.lower(r) == F.lower(c))
    punctuation = (r != c) & (collapse(bare(r)) == collapse(bare(c)))
    named = [
        (spacing, "spacing"),
        (capitals, "capitalization"),
        (punctuation, "punctuation"),
        (lines[1] < lines[0], "merged or missed"),
        (lines[1] > lines[0], "split or false positive"),
    ]
    generic = (r != c) & ~spacing & ~capitals & ~punctuation & (lines[0] == lines[1])
    return F.array_compact(F.array(*[F.when(x, F.lit(n)) for x, n in named], F.when(generic, F.lit("text"))))


def report(scored_pairs: DataFrame, group: str, key: str, worst: int = 5) -> DataFrame:
    """``section, name, cer`` of an accuracy report, from ``e`` errors, ``n`` characters and the ``rate`` of each pair: over all (weighted by length, and the mean), per group, and of the ``worst`` pairs, ties by key."""
    weighted = F.round(F.try_divide(F.sum("e"), F.sum("n")), 9)
    whole = scored_pairs.agg(weighted.alias("w"), F.round(F.avg("rate"), 9).alias("m")).select(F.inline(F.array(F.struct(F.lit("all").alias("section"), F.lit("weighted").alias("name"), F.col("w").alias("cer")), F.struct(F.lit("all").alias("section"), F.lit("mean").alias("name"), F.col("m").alias("cer")))))
    groups = scored_pairs.groupBy(F.col(group).alias("name")).agg(weighted.alias("cer")).select(F.lit("video").alias("section"), "name", "cer")
    top = scored_pairs.filter("n > 0").orderBy(F.desc("rate"), key).limit(worst).select(F.lit("worst").alias("section"), F.col(key).cast("string").alias("name"), F.round("rate", 9).alias("cer"))
    return whole.unionByName(groups).unionByName(top)
