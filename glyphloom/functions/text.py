"""Scalar rules over text as column expressions. Null in, null out, unless a docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\p{Z}\s\x1c-\x1f\x85]+"


def collapse(text: Column) -> Column:
    """Runs of any white space become one space; none is left at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normalise(text: Column) -> Column:
    """Lower case, white space collapsed: the form in which observations are compared."""
    return collapse(F.lower(text))


def unix_lines(text: Column) -> Column:
    """Line ends as a single newline, blanks at both ends dropped; case and inner blanks stay."""
    return F.trim(F.regexp_replace(text, r"\r\n?", "\n"))


def words(text: Column) -> Column:
    """The set of words of the normalised text, in order of first occurrence."""
    return F.array_distinct(F.filter(F.split(normalise(text), " "), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words of two word sets: 1 if both are empty, 0 if one is."""
    both, every = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(1.0)).otherwise(both / F.greatest(every, F.lit(1)))


def is_numbered(text: Column) -> Column:
    """Whether a line starts with 1. to 99. (so ``1.5 mg`` does, and ``100.`` does not)."""
    return text.rlike(r"^[1-9][0-9]?\.")


# Bullet signs.
BULLETS = ["•", "-", "*", "▪", "◦", "○"]


def is_bullet(text: Column) -> Column:
    return F.substring(text, 1, 1).isin(BULLETS)


# Script names in the order of listing, with their Unicode properties.
SCRIPTS = [("Latin", "IsLatin"), ("Hebrew", "IsHebrew"), ("Arabic", "IsArabic"), ("Cyrillic", "IsCyrillic"), ("Hangul", "IsHangul"), ("Han", "IsHan")]


def observed_scripts(text: Column) -> Column:
    """The scripts of the letters of ``text``; letters of no listed script count as Other/Unknown. Full-width Latin letters are of none. Null has no scripts."""
    wide = r"\x{ff21}-\x{ff3a}\x{ff41}-\x{ff5a}"
    listed = "".join(rf"\p{{{p}}}" for _, p in SCRIPTS)
    tests = [(name, rf"[\p{{L}}&&\p{{{p}}}&&[^{wide}]]") for name, p in SCRIPTS] + [("Other/Unknown", rf"[[\p{{L}}&&[^{listed}]]{wide}]")]
    return F.array_compact(F.array(*[F.when(text.rlike(test), F.lit(name)) for name, test in tests]))


def is_protected_short(text: Column) -> Column:
    """Compact content of up to 16 characters that shortness alone must not discard: any digit, one small letter, or 2 to 5 capitals."""
    t = F.regexp_replace(text, rf"^{SPACE}|{SPACE}$", "")
    compact = t.rlike(r"^\S(?:.{0,14}\S)?$")
    return compact & (t.rlike(r"\p{Nd}") | t.rlike(r"^\p{Ll}$") | t.rlike(r"^\p{Lu}{2,5}$"))


def is_fragment(text: Column) -> Column:
    """Whether all tokens are letters and either the only one, or at least half of several, are single letters."""
    tokens = F.filter(F.split(collapse(text), " "), lambda w: w != "")
    single = F.size(F.filter(tokens, lambda w: F.length(w) == 1))
    alphabetic = F.forall(tokens, lambda w: w.rlike(r"^\p{L}+$"))
    n = F.size(tokens)
    return (n > 0) & alphabetic & F.when(n == 1, single == 1).otherwise(single * 2 >= n)


def numeric_tokens(text: Column) -> Column:
    """Numbers that do not continue a word or another number, decimal commas as points."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_.])\d+(?:[.,]\d+)?"), F.lit(0)), lambda t: F.replace(t, F.lit(","), F.lit(".")))


def letter_words(text: Column) -> Column:
    """Runs of letters, in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0)), F.lower)


def filled_lines(text: Column) -> Column:
    return F.filter(F.split(text, r"\r\n?|\n"), lambda line: F.trim(line) != "")


def shared_boundary(left: Column, right: Column) -> Column:
    """The length of the longest suffix of ``left`` that is a prefix of ``right``, whatever the case."""
    a, b = F.lower(left), F.lower(right)
    most = F.least(F.length(a), F.length(b))
    sizes = F.filter(F.sequence(F.lit(0), most), lambda k: (k == 0) | (F.right(a, k) == F.left(b, k)))
    return F.array_max(sizes)


def join_fragments(left: Column, right: Column, overlap: Column) -> Column:
    """Two neighbouring regions' texts as one: where boxes overlap, shared characters once, and a split capital rejoined; else a space unless punctuation binds."""
    a, b = F.trim(left), F.trim(right)
    shared = shared_boundary(a, b)
    stitched = F.when(shared > 0, F.concat(F.left(a, F.length(a) - shared), b)).when((F.length(a) == 1) & a.rlike(r"^\p{Lu}$") & b.rlike(r"^\p{Ll}"), F.concat(a, b))
    bound = b.rlike(r"^[.,;:!?)\]}]") | a.rlike(r"[(\[{]$")  # fixed values: signs that bind to what is before or behind them
    plain = F.when(bound, F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b))
    return F.when(a == "", b).when(b == "", a).when(overlap, F.coalesce(stitched, plain)).otherwise(plain)


def row_height(*cells: Column, width: int = 60, unit: int = 15, most: int = 300) -> Column:
    """The height of a row whose cells wrap at ``width`` characters: the largest of its cells', within limits."""
    lines = [F.aggregate(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda t: F.greatest(F.lit(1), F.ceil(F.length(t) / width))), F.lit(0).cast("long"), lambda s, n: s + n) for c in cells]
    top = F.greatest(*lines) if len(lines) > 1 else lines[0]
    return F.least(F.lit(most), F.greatest(F.lit(unit), top * unit))


# Names that a file system keeps for itself.
RESERVED = ["CON", "PRN", "AUX", "NUL", *[f"COM{k}" for k in range(1, 10)], *[f"LPT{k}" for k in range(1, 10)]]


def safe_name(text: Column, most: int = 31) -> Column:
    """A name without signs that file systems or sheets refuse; reserved and empty names get a word more."""
    clean = F.regexp_replace(collapse(F.regexp_replace(text, r"[<>:\"/\\|?*\[\]\x00-\x1f]+", " ")), r"^[ .']+|[ .']+$", "")
    cut = F.regexp_replace(F.left(clean, F.lit(most)), r"[ .]+$", "")
    return F.when(cut == "", F.lit("Untitled")).when(F.upper(cut).isin(RESERVED), F.concat(cut, F.lit(" file"))).otherwise(cut)


def duration(seconds: Column) -> Column:
    """Hours, minutes and seconds, as many as needed."""
    s = F.floor(F.greatest(seconds, F.lit(0.0))).cast("long")
    h, m, r = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def byte_size(n: Column) -> Column:
    """Bytes in the largest unit that leaves at least one, with one decimal from KB on."""
    out = F.format_string("%d B", n.cast("long"))
    for power, unit in enumerate(["KB", "MB", "GB", "TB"], 1):
        out = F.when(n >= 1024**power, F.format_string(f"%.1f {unit}", n / float(1024**power))).otherwise(out)
    return out


def redacted(text: Column) -> Column:
    """Values behind words that name secrets, and bearer tokens, are hidden."""
    keyed = F.regexp_replace(text, r"(?i)\b(api[_-]?key|token|secret|password|authorization)\b(\s*[=:]\s*)\S+", "$1$2[redacted]")
    return F.regexp_replace(keyed, r"(?i)\bbearer\s+[a-z0-9._-]+", "Bearer [redacted]")


# Display names of languages.
LANGUAGE_NAMES = {"de": "German", "en": "English", "es": "Spanish", "fr": "French", "pt": "Portuguese", "ru": "Russian"}


def language_code(label: Column) -> Column:
    """The code of a language identifier such as ``en``, ``en-US`` or ``en_GB``; null for anything else."""
    c = F.trim(label)
    return F.when(c.rlike(r"^[A-Za-z]{2}(?:[-_][A-Za-z0-9]{2,8})?$"), F.lower(F.left(c, F.lit(2))))


def language_name(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair])
    return F.try_element_at(known, code)


def version_tuple(version: Column) -> Column:
    """A version's first four numbers as an array that compares by value; missing ones are 0, non-numbers null."""
    parts = F.slice(F.split(version, r"\."), 1, 4)
    numbers = F.transform(parts, lambda p: p.try_cast("int"))
    padded = F.slice(F.concat(numbers, F.array_repeat(F.lit(0), 4)), 1, 4)
    return F.when(~F.exists(numbers, lambda n: n.isNull()), padded)


def is_safe_relative_path(path: Column) -> Column:
    """Whether a path stays inside its folder: relative, with forward slashes, no empty, ``.`` or ``..`` parts, no drive."""
    return (path != "") & ~path.rlike(r"^/|\\|:|//|(^|/)\.{1,2}(/|$)|/$")


def frame_count(reported: Column) -> Column:
    """The number of frames that a container reports, or null where it reports none."""
    return F.when(reported.cast("long") > 0, reported.cast("long"))


def remaining_seconds(elapsed: Column, current: Column, total: Column, least_current: int = 3, least_elapsed: float = 0.0) -> Column:
    """The time that is left at the pace so far; null before a stage has done ``least_current`` steps in ``least_elapsed`` seconds, and without a total."""
    known = (current >= least_current) & (elapsed >= least_elapsed) & (total > 0) & (current > 0)
    return F.when(known, F.greatest(F.lit(0.0), elapsed / current * F.greatest(F.lit(0), total - current)))


def evidence_path(request: Column) -> Column:
    """Where the evidence of a request is kept: by the digest of its id."""
    return F.concat(F.lit("evidence/"), F.sha2(request, 256), F.lit(".png"))


def visual_request_id(source: Column, slide: Column, build: Column, frame: Column) -> Column:
    """The id of a request about one frame; a build that is unknown is named so."""
    return F.concat_ws(":", source, F.lit("slide"), slide.cast("string"), F.lit("build"), F.coalesce(build.cast("string"), F.lit("none")), F.lit("frame"), frame.cast("string"))
