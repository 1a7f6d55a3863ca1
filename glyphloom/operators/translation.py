"""Planning requests, running providers without losing a row to a failure, and joining results with a check of their keys."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.functions.similarity import gestalt_ratio
from glyphloom.functions.text import filled_lines, letter_words, numeric_tokens

BULLET_LINE = r"^\s*(?:[-*•▪◦○]|\d+[.)])\s+"


def usable(text: Column) -> Column:
    return text.isNotNull() & (F.trim(text) != "")


def source_text(verified: Column, edited: Column, accepted: Column, canonical: Column) -> tuple[Column, Column]:
    """The text to use and where it comes from: verified, else an accepted edit, else the canonical one; null if none is usable."""
    edit = F.coalesce(accepted, F.lit(False)) & usable(edited)
    text = F.when(usable(verified), verified).when(edit, edited).when(usable(canonical), canonical)
    kind = F.when(usable(verified), "verified_ocr").when(edit, "user_edit").when(usable(canonical), "ocr")
    return text, kind


def requests(records: DataFrame, languages: list[str], reference: str = "source_reference", text: str = "source_text") -> DataFrame:
    """A request for each usable record and language, in the order of languages, then records. The languages (a handful) become one array beside each record."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("language_order"), F.lit(c).alias("target_language")) for k, c in enumerate(languages)]))
    rows = records.filter(usable(F.col(text))).select("*", each.alias("_l")).select("*", "_l.*").drop("_l")
    return rows.withColumn("request_id", F.concat_ws(":", reference, F.lit("translation"), "target_language"))


def run_provider(rows: DataFrame, translate: Callable[[str, str], str], text: str = "source_text", language: str = "target_language") -> DataFrame:
    """``rows`` with ``status``, ``translated_text`` and ``error``: a row on which the provider fails is a failure row, and all others go on."""
    schema = rows.select("*", F.lit("").alias("status"), F.lit("").alias("translated_text"), F.lit("").alias("error")).schema
    for field in schema.fields[-3:]:
        field.nullable = True
    names = schema.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t, code in zip(batch[text], batch[language]):
                try:
                    out.append(("success", translate(t, code), None))
                except Exception as failure:  # noqa: BLE001 - any failure of a provider is its row's
                    out.append(("failure", None, f"{type(failure).__name__}: {failure}"))
            status = pd.DataFrame(out, columns=names[-3:], index=batch.index)
            yield pd.concat([batch, status], axis=1)[names]

    return rows.mapInPandas(run, schema)


def key_violations(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``key, problem``: keys that one side lacks, and keys that a side has more than once. Empty if the key sets are equal."""
    a, b = left.groupBy(key).agg(F.count("*").alias("l")), right.groupBy(key).agg(F.count("*").alias("r"))
    both = a.join(b, key, "full")
    problems = F.array_compact(F.array(F.when(F.col("r").isNull(), "missing"), F.when(F.col("l").isNull(), "unknown"), F.when(F.col("l") > 1, "repeated on the left"), F.when(F.col("r") > 1, "repeated on the right")))
    return both.select(key, F.explode(problems).alias("problem"))


def strict_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The inner join of two sides with equal sets of unique keys; raises where they are not."""
    bad = key_violations(left, right, key).limit(5).collect()
    if bad:
        raise ValueError("keys do not agree: " + ", ".join(f"{r[0]} ({r[1]})" for r in bad))
    return left.join(right, key)


def warnings(source: Column, result: Column) -> Column:
    """What is odd about a translation: numbers that differ, and lines or bullets that are lost; in this order."""
    numbers, translated = F.array_sort(numeric_tokens(source)), F.array_sort(numeric_tokens(result))
    numeric = (F.size(numbers) > 0) & (numbers != translated)
    a, b = filled_lines(source), filled_lines(result)
    bullets = lambda lines: F.size(F.filter(lines, lambda t: t.rlike(BULLET_LINE)))
    structure = ((F.size(a) >= 3) & (F.size(b) <= F.floor(F.size(a) / 2))) | ((bullets(a) >= 2) & (bullets(b) < bullets(a)))
    return F.array_compact(F.array(F.when(numeric, "numeric_mismatch"), F.when(structure, "structure_mismatch")))


def may_be_copied(source: Column, result: Column) -> Column:
    """Whether a translation has enough words, and of the right lengths, to be worth comparing with its source."""
    a, b = letter_words(source), letter_words(result)
    enough = (F.size(a) >= 4) & (F.size(b) >= 4) & (F.length(F.array_join(a, "")) >= 20)
    return enough & ~source.rlike(r"(?i)https?://|www\.") & ~result.rlike(r"(?i)https?://|www\.")


def planner(most: int = 31) -> Callable[[str], str]:
    """Gives each name in turn a unique one: a name that was used (whatever its case) gets the next free number, its stem cut to fit. Numbers that a stem has found taken are not tried again."""
    used: set[str] = set()
    last: dict[str, int] = {}

    def plan(name: str) -> str:
        stem = name[:most]
        k = last.get(stem, 1)
        while True:
            end = f" ({k})" if k > 1 else ""
            candidate = stem[: most - len(end)] + end
            if candidate.lower() not in used:
                break
            k += 1
        last[stem] = k
        used.add(candidate.lower())
        return candidate

    return plan


def planned_names(names: list[str], most: int = 31) -> list[str]:
    """Unique names in order, by ``planner``. A plan has a few dozen names at most, and each depends on all before."""
    return list(map(planner(most), names))


# States of a review, labels of its priority, and the least likeness to its source of a translation that may be a copy.
ACCEPTED, EDITED = "accepted", "edited_verified"
PRIORITIES = {"normal_review": "Normal Review", "review_recommended": "Review Recommended", "translation_failed": "Translation Failed"}
COPIED = 0.96


def resolved(status: Column, translated: Column, state: Column, edited: Column) -> tuple[Column, Column]:
    """The text to put out and whether a person has verified it: nothing for failures, the edit where one was verified, else the provider's text."""
    success = status == "success"
    text = F.when(success & (state == EDITED), edited).when(success, translated)
    return text, F.coalesce(success & state.isin(ACCEPTED, EDITED), F.lit(False))


def assessed(rows: DataFrame, source: str, translated: str, status: str = "status") -> DataFrame:
    """``rows`` with ``review_warnings`` (codes in order: a copy of the source, numbers, structure) and ``review_priority``. Only pairs that may be copies are compared in Python."""
    s, t = F.col(source), F.coalesce(translated, F.lit(""))
    joined = lambda c: F.array_join(letter_words(c), " ")
    ratio = gestalt_ratio(F.when(may_be_copied(s, t), joined(s)), F.when(may_be_copied(s, t), joined(t)))
    compared = rows.withColumn("_ratio", ratio)
    copy = F.when(F.coalesce(F.col("_ratio") >= COPIED, F.lit(False)), F.array(F.lit("source_copy_similarity"))).otherwise(F.array().cast("array<string>"))
    failed = F.col(status) != "success"
    codes = F.when(failed, F.array(F.lit("translation_failed"))).otherwise(F.concat(copy, warnings(s, t)))
    priority = F.when(failed, "translation_failed").when(F.size("review_warnings") > 0, "review_recommended").otherwise("normal_review")
    return compared.withColumn("review_warnings", codes).drop("_ratio").withColumn("review_priority", priority)


def priority_label(priority: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in PRIORITIES.items() for x in pair]), priority)


def provider_name(name: Column) -> Column:
    """A provider's name in lower case without white space around it; null if it is no name."""
    clean = F.lower(F.trim(name))
    return F.when(clean.rlike(r"^[a-z][a-z0-9_-]*$"), clean)


def error_category(kind: Column, message: Column, status: Column) -> Column:
    """What a provider's failure was about, from the name of its kind, its message and its status code; the first that fits."""
    k, m = F.lower(F.coalesce(kind, F.lit(""))), F.lower(F.coalesce(message, F.lit("")))
    has = lambda c, word: F.contains(c, F.lit(word))
    either = lambda word: has(k, word) | has(m, word)
    code = lambda *n: F.coalesce(status.isin(*n), F.lit(False))
    return (
        F.when(code(401) | has(k, "auth"), "authentication failed")
        .when(code(403) | has(k, "permission"), "account/project access failed")
        .when(code(429) | has(k, "rate"), "rate limit reached")
        .when(code(404, 400) & has(m, "model"), "model unavailable")
        .when(either("certificate") | either("ssl"), "TLS/certificate failure")
        .when(either("timeout"), "request timed out")
        .when(has(k, "network") | has(k, "connection") | has(m, "connect"), "network request failed")
        .when(either("model"), "model unavailable")
        .when(has(m, "response") | has(m, "refusal"), "invalid provider response")
        .otherwise("provider request failed")
    )


def exact_models(requests_: DataFrame, catalogue: DataFrame, keys: list[str], model: str) -> DataFrame:
    """``requests_`` with ``model`` and ``problem``: the one model of exactly these keys; ``not installed`` where there is none, ``ambiguous`` where there are several."""
    found = catalogue.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(model).alias(model))
    joined = requests_.join(found, keys, "left")
    problem = F.when(F.col("_n").isNull(), "not installed").when(F.col("_n") > 1, "ambiguous")
    return joined.withColumn("problem", problem).withColumn(model, F.when(F.col("_n") == 1, F.col(model))).drop("_n")


def usable_targets(pairs: DataFrame, codes: list[str], local: bool, sources: tuple[str, ...] = ("en", "en-US")) -> DataFrame:
    """``target_language`` that a provider can serve: all of ``codes``, or, for a local one, the targets of its installed pairs from ``sources``."""
    if local:
        return pairs.filter(F.col("source_language").isin(*sources)).select("target_language").distinct()
    return pairs.sparkSession.createDataFrame([(c,) for c in dict.fromkeys(codes)], "target_language string")


#: Metadata whose key says that it is secret.
SECRET_KEY = r"(?i)api.?key|token|secret|password|credential|authorization"


def safe_metadata(metadata: Column) -> Column:
    """A map without the entries whose keys name secrets."""
    return F.map_filter(metadata, lambda k, _: ~k.rlike(SECRET_KEY))


#: Providers by name: factories that are called once in each Python worker.
_PROVIDERS: dict[str, Callable[[], Callable[[str, str], str]]] = {}


def register_provider(name: str, factory: Callable[[], Callable[[str, str], str]]) -> None:
    """Make a provider known by its name in lower case; a name that is none, or is taken, is refused."""
    clean = name.strip().lower()
    if not re.fullmatch(r"[a-z][a-z0-9_-]*", clean) or clean in _PROVIDERS:
        raise ValueError(f"no name for a new provider: {name!r}")
    _PROVIDERS[clean] = factory


def provider_factory(name: str) -> Callable[[], Callable[[str, str], str]]:
    if name.strip().lower() not in _PROVIDERS:
        raise ValueError(f"unknown provider: {name!r}; there are " + (", ".join(sorted(_PROVIDERS)) or "none"))
    return _PROVIDERS[name.strip().lower()]


# How workbooks are grouped.
GROUPINGS = ["by_language", "by_source", "combined", "individual"]


def planned_workbooks(items: DataFrame, languages: list[str], grouping: str, job: str, item: str = "source_item_id", place: str = "place") -> DataFrame:
    """``workbook_id, sheet_id, item, target_language, sheet_order``: a sheet for each item and language, in the order of its workbook's grouping. ``place`` is the items' order, from 0; the languages are a handful."""
    if grouping not in GROUPINGS:
        raise ValueError(f"unknown grouping: {grouping}")
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("_k"), F.lit(c).alias("target_language")) for k, c in enumerate(languages)]))
    rows = items.select(item, F.col(place).cast("long").alias("_p"), each.alias("_l")).select(item, "_p", "_l.*")
    n = items.count()
    at = F.col("_k") * n + F.col("_p") if grouping == "by_language" else F.col("_p") * len(languages) + F.col("_k")
    book = {"by_language": ["language", F.col("target_language")], "by_source": ["source", F.col(item)], "combined": ["combined"], "individual": ["source", F.col(item), "language", F.col("target_language")]}[grouping]
    parts = [c if isinstance(c, Column) else F.lit(c) for c in book]
    return rows.select(F.concat_ws(":", F.lit(job), F.lit("workbook"), *parts).alias("workbook_id"), F.concat_ws(":", F.lit(job), F.lit("sheet"), F.col(item), "target_language").alias("sheet_id"), F.col(item), "target_language", at.alias("sheet_order"))
