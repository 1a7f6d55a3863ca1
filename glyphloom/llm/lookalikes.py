"""One consistent form for texts that look the same.

1. Characters that a viewer cannot tell apart are mapped, in the JVM: full-width forms, unusual spaces, ligatures and digraphs by rule from
   the Unicode database; look-alike letters of other scripts only inside words that are of one script otherwise.
2. Mapped values are grouped in SQL under the accent-sensitive ``UNICODE`` collation, which ignores invisible characters and equates composed
   with decomposed accents, but not letters with and without accents, nor capitals with small letters.
3. Of each class, the member with the fewest unusual characters, then the shortest, then the first in binary order, is the canonical one. The ordinary
   form of each member (invisible characters dropped, accents composed) is a member as well, so a class never lacks a clean one.
4. The canonical member is joined back to the texts.

Only texts with some unusual character, or with Latin letters beside Cyrillic or Greek ones, can change; all others are their own form
and skip the grouping. Null stays null, an empty text stays empty, and repeated rows get the same form.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.functions.similarity import nfc as composed
from glyphloom.functions.text import observed_scripts
from glyphloom.session import join_hot, materialize

# Letters that look like Latin ones, in pairs.
CYRILLIC_LATIN = "аa еe оo рp сc уy хx іi ѕs јj ԁd һh ԛq ԝw ѵv АA ВB ЕE ЗZ КK МM НH ОO РP СC ТT УY ХX ІI ЅS ЈJ ԚQ ԜW"
GREEK_LATIN = "αa ιi νv οo ρp υu γy χx ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX"
LATIN_LATIN = "ɑa ɡg"
# Latin letters that look like Cyrillic ones.
LATIN_CYRILLIC = "aа eе oо pр cс yу xх AА BВ EЕ KК MМ HН OО PР CС TТ XХ"
# Characters without a mark of their own that are not in Unicode's category of format characters.
UNSEEN = "͏ᅟᅠ᠎ㅤ"
#: Scripts in which joiners are part of the spelling, and emoji, which they join.
JOINING = r"\p{IsArabic}\p{IsDevanagari}\p{IsBengali}\p{IsGurmukhi}\p{IsGujarati}\p{IsOriya}\p{IsTamil}\p{IsTelugu}\p{IsKannada}\p{IsMalayalam}\p{IsSinhala}\p{IsMongolian}\p{So}\p{Sk}\x{fe0f}"


def _pairs(text: str) -> tuple[str, str]:
    return "".join(p[0] for p in text.split()), "".join(p[1] for p in text.split())


def _ranges(points: list[int]) -> str:
    """A regular expression's character class for code points, which come in order."""
    out: list[list[int]] = []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(f"\\x{{{a:x}}}" + (f"-\\x{{{b:x}}}" if b > a else "") for a, b in out)


def wide_maps() -> tuple[str, str]:
    """Full-width forms of ASCII characters, and unusual spaces."""
    spaces = [chr(c) for c in range(0x10000) if unicodedata.category(chr(c)) == "Zs" and c != 0x20]
    return "".join(map(chr, range(0xFF01, 0xFF5F))) + "".join(spaces), "".join(map(chr, range(0x21, 0x7F))) + " " * len(spaces)


@lru_cache(1)
def single_maps() -> tuple[str, str]:
    """Characters with a one-character ordinary form: full-width forms and unusual spaces (compatibility decomposition), and canonical twins."""
    wide = [c for c in range(0xFF01, 0xFFE7) if not 0xFF5F <= c <= 0xFFDF]
    spaces = [c for c in range(0x10000) if unicodedata.category(chr(c)) == "Zs" and c != 0x20]
    twins = [c for c in range(0x20000) if not 0xAC00 <= c <= 0xD7A3 and not 0xD800 <= c <= 0xDFFF and len(f := unicodedata.normalize("NFC", chr(c))) == 1 and f != chr(c)]
    old = {chr(c): " " if c in spaces else unicodedata.normalize("NFKC", chr(c)) for c in [*wide, *spaces, *twins]}
    old |= {chr(c): unicodedata.normalize("NFC", chr(c)) for c in twins if c not in spaces}
    old |= dict(zip(*_pairs(LATIN_LATIN)))
    kept = {a: b for a, b in old.items() if len(b) == 1 and a != b}
    return "".join(kept), "".join(kept.values())


@lru_cache(1)
def multiple_maps() -> dict[str, str]:
    """Ligatures, digraphs and numeral letters: one character that looks like several ordinary letters, or like one."""
    chars = [*range(0xFB00, 0xFB07), 0x132, 0x133, *range(0x1C7, 0x1CD), *range(0x1F1, 0x1F3), *range(0x2160, 0x2180)]
    return {chr(c): f for c in chars if (f := unicodedata.normalize("NFKC", chr(c))) != chr(c)}


@lru_cache(1)
def unusual() -> str:
    """A character class of all characters that some step may change or drop."""
    odd = {ord(c) for c in single_maps()[0]} | {ord(c) for c in multiple_maps()} | {ord(c) for c in UNSEEN}
    odd |= {*range(0x00, 0x09), *range(0x0E, 0x20), 0x7F, *range(0x80, 0xA0)}
    return r"[\p{Cf}\p{Mn}" + _ranges(sorted(odd)) + "]"


LATIN, OTHER = r"[\p{IsLatin}&&\p{L}]", r"[\p{L}&&[\p{IsCyrillic}\p{IsGreek}]]"


def may_change(text: Column) -> Column:
    """Whether ``text`` has anything that another form could replace: a cheap test that all other texts fail."""
    # One class: an alternation of two would cost ten times as much at each character.
    return text.rlike(r"[\x{80}-\x{10ffff}\x00-\x08\x0e-\x1f\x7f]") & (text.rlike(unusual()) | (text.rlike(LATIN) & text.rlike(OTHER)))


def mapped(text: Column) -> Column:
    """``text`` with look-alikes mapped; invisible characters and accents are left to the collation."""
    out = F.translate(text, *single_maps())
    for char, form in multiple_maps().items():
        out = F.replace(out, F.lit(char), F.lit(form))
    sources = [_pairs(t) for t in (CYRILLIC_LATIN, GREEK_LATIN)]
    old, new = "".join(s[0] for s in sources), "".join(s[1] for s in sources)
    back = _pairs(LATIN_CYRILLIC)
    own = rf"(?:[\p{{IsCyrillic}}\p{{IsGreek}}&&\p{{L}}&&[^{old}]])"  # a letter that has no Latin look-alike
    foreign = rf"(?:[\p{{IsLatin}}&&\p{{L}}&&[^{back[0]}]])"
    # Only where both kinds of letters meet is there anything to decide word by word.
    both = out.rlike(LATIN) & out.rlike(OTHER)
    bound = r"(?<=[^\p{L}\p{M}\p{Cf}])|(?=[^\p{L}\p{M}\p{Cf}])"
    # A word of look-alikes alone is taken for Latin where all else in the text is Latin.
    all_latin = ~out.rlike(own)

    def word(w: Column) -> Column:
        mixed = w.rlike(LATIN) & w.rlike(OTHER)
        to_latin = (mixed & ~w.rlike(own)) | (~mixed & w.rlike(OTHER) & all_latin & ~w.rlike(own))
        to_cyrillic = mixed & w.rlike(own) & ~w.rlike(foreign) & ~w.rlike(r"\p{IsGreek}")
        return F.when(to_latin, F.translate(w, old, new)).when(to_cyrillic, F.translate(w, *back)).otherwise(w)

    return F.when(both, F.array_join(F.transform(F.split(out, bound), word), "")).otherwise(out)


def visible(text: Column) -> Column:
    """``text`` without characters that cannot be seen; joiners stay beside letters of scripts that need them."""
    # Joiners that belong are put aside as noncharacters: a look-behind would see half of a character beyond the basic plane.
    aside = text
    for joiner, stand_in in zip("\u200c\u200d", "\ufdd0\ufdd1"):
        aside = F.regexp_replace(aside, rf"([{JOINING}]){joiner}(?=[{JOINING}])", f"$1{stand_in}")
    shown = F.regexp_replace(aside, r"[\p{Cf}\x00-\x08\x0e-\x1f\x7f\x{80}-\x{9f}" + _ranges(sorted(map(ord, UNSEEN))) + "]", "")
    return F.translate(shown, "\ufdd0\ufdd1", "\u200c\u200d")


def canonical_forms(texts: DataFrame) -> DataFrame:
    """``text, canonical, n`` for the distinct values of ``texts.text`` that may change; ``n`` is the number of rows of each."""
    spark = texts.sparkSession
    values = texts.filter(may_change(F.col("text"))).groupBy("text").agg(F.count("*").alias("n"))
    values = values.withColumn("mapped", mapped(F.col("text")))
    values = materialize(values.withColumn("ordinary", composed(visible(F.col("mapped")))))
    members = values.select("mapped", F.explode(F.array("text", "mapped", "ordinary")).alias("member"))
    ranked = members.select("mapped", F.struct(F.length(F.regexp_replace("member", rf"[^{unusual()[1:-1]}]", "")).alias("odd"), F.octet_length("member").alias("size"), "member").alias("rank"), "member")
    # A raw member may differ from its mapped value by more than the collation ignores: only members of the class itself stand for it.
    classes = spark.sql(
        """
        SELECT mapped COLLATE UNICODE AS class, min(rank).member AS canonical
        FROM {ranked} WHERE member COLLATE UNICODE = mapped COLLATE UNICODE
        GROUP BY mapped COLLATE UNICODE
        """,
        ranked=ranked,
    )
    return spark.sql(
        "SELECT v.text, c.canonical, v.n FROM {v} v JOIN {c} c ON v.mapped COLLATE UNICODE = c.class",
        v=values,
        c=classes,
    )


def consistent(records: DataFrame, text: str = "text") -> DataFrame:
    """``records`` with ``canonical``, the consistent form of ``text``; all rows and other columns stay, but a column of that name is replaced."""
    records = records.drop("canonical")
    names = records.columns
    changes = may_change(F.col(text))
    forms = materialize(canonical_forms(records.select(F.col(text).alias("text")))).withColumnsRenamed({"text": text, "n": "__rows"})
    changed = join_hot(records.filter(changes), forms, text, "__rows")
    same = records.filter(F.col(text).isNull() | ~changes).withColumn("canonical", F.col(text))
    return changed.select(*names, "canonical").unionByName(same)


def disguised(regions: DataFrame, promotions: DataFrame) -> DataFrame:
    """``record_kind, record_id``: regions whose text is not in consistent form, and promotion records whose observed scripts are not those of it."""
    rows = regions.select(F.lit("region").alias("record_kind"), F.col("region_id").alias("record_id"), "text", F.lit(None).cast("array<string>").alias("observed")).unionByName(
        promotions.select(F.lit("promotion").alias("record_kind"), F.col("promotion_id").alias("record_id"), "text", F.col("observed_scripts").alias("observed"))
    )
    formed = consistent(rows)
    other = F.array_sort(F.coalesce("observed", F.array().cast("array<string>"))) != F.array_sort(observed_scripts(F.col("canonical")))
    found = F.when(F.col("record_kind") == "region", F.col("text") != F.col("canonical")).otherwise(other)
    return formed.filter(found).select("record_kind", "record_id").distinct()
