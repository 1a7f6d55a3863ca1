"""Cutting oversized texts at natural boundaries.

Sizes are UTF-8 bytes. A text is cut at the coarsest separators first (section, paragraph, line, sentence, word, character): a part
that still exceeds the room is cut at the next finer ones. Parts are then packed greedily to the limit. Each piece after the
first repeats the end of the one before: the longest run of whole words within ``overlap`` bytes, or of whole characters where a
word is longer. Pieces without their overlap, joined, are the text again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From coarse to fine; a cut falls behind each match, except that a section starts with its heading.
SEPARATORS = [re.compile(p) for p in (rb"\n(?=#{1,6} )|\f", rb"\n[ \t]*\n+", rb"\n", rb"(?:[.!?]|\xe2\x80\xa6|\xe3\x80\x82)[\"')\]]*\s+", rb"\s+")]
NO_ROOM = "a piece must have room for a character beside its overlap"
LEVELS = ["section", "paragraph", "line", "sentence", "word", "character"]


def _parts(data: bytes, start: int, end: int, room: int, level: int = 0) -> Iterator[tuple[int, int]]:
    """Consecutive parts of data[start:end] of at most ``room`` bytes, with the level of the cut before each."""
    if end - start <= room:
        yield end, level
        return
    if level == len(SEPARATORS):
        while end - start > room:
            cut = start + room
            while cut > start + 1 and data[cut] & 0xC0 == 0x80:
                cut -= 1
            if data[cut] & 0xC0 == 0x80:
                raise ValueError("the capacity is less than one character")
            yield cut, level
            start = cut
        yield end, level
        return
    at = start
    for m in SEPARATORS[level].finditer(data, start, end):
        if m.end() > at:
            yield from _parts(data, at, m.end(), room, level + 1)
            at = m.end()
    if at < end:
        yield from _parts(data, at, end, room, level + 1)


def _tail(data: bytes, start: int, end: int, overlap: int) -> int:
    """Where the repeated end of data[start:end] begins."""
    if overlap <= 0:
        return end
    least = max(start, end - overlap)
    if least == start or data[least - 1 : least].isspace():
        at = least
    elif m := SEPARATORS[-1].search(data, least, end - 1):
        at = m.end()
    else:
        at = least
    if at >= end:
        at = least
    while at < end and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def pieces(text: str, capacity: int, overlap: int) -> list[tuple[int, int, int]]:
    """Byte ranges (start, end of overlap, end) of the pieces of ``text``: the first has no overlap, an empty text one empty piece."""
    if capacity < 4 or not 0 <= overlap < capacity - 3:
        raise ValueError(NO_ROOM)
    data = text.encode("utf-8", "surrogatepass")
    if len(data) <= capacity:
        return [(0, 0, len(data))]
    out, start, fresh, last = [], 0, 0, 0
    for end, _ in _parts(data, 0, len(data), capacity - overlap):
        if end - start > capacity:
            out.append((start, fresh, last))
            start, fresh = _tail(data, start, last, overlap), last
        last = end
    out.append((start, fresh, last))
    return out


def split_oversized(documents: DataFrame, specs: DataFrame) -> DataFrame:
    """``spec_id, doc_id, piece_number, start_byte, fresh_byte, end_byte, piece_bytes, text, error`` for every document and ``split`` spec.

    A spec whose pieces have no room for a character beside their overlap cannot cut anything: documents above its capacity are a row each with ``error``, without a piece. A document within the capacity is one piece and never leaves the JVM; a null text counts 0 bytes and is one piece with
    null text. ``start_byte`` to ``fresh_byte`` is the overlap. Repeated rows give repeated pieces. Specs come from a table of fixed
    size. Only ``doc_id`` and ``text`` are read; extra columns are ignored.
    """
    wanted = specs.filter("purpose = 'split'").select("spec_id", "capacity_tokens", "overlap_tokens").distinct()
    sized = documents.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("_bytes"))
    each = _with_specs(sized, wanted)
    fits = each.filter(F.col("_bytes") <= F.col("capacity_tokens")).select(
        "spec_id", "doc_id", F.lit(1).alias("piece_number"), F.lit(0).cast("long").alias("start_byte"), F.lit(0).cast("long").alias("fresh_byte"), F.col("_bytes").alias("end_byte"), F.col("_bytes").alias("piece_bytes"), "text", F.lit(None).cast("string").alias("error")
    )
    large = each.filter(F.col("_bytes") > F.coalesce("capacity_tokens", F.lit(-1))).select("spec_id", "doc_id", "text", "capacity_tokens", "overlap_tokens")
    sound = F.coalesce((F.col("capacity_tokens") >= 4) & (F.col("overlap_tokens") >= 0) & (F.col("overlap_tokens") < F.col("capacity_tokens") - 3), F.lit(False))
    nothing = [F.lit(None).cast(fits.schema[c].dataType).alias(c) for c in fits.columns[2:-1]]
    failed = large.filter(~sound).select("spec_id", "doc_id", *nothing, F.lit(NO_ROOM).alias("error"))
    return fits.unionByName(large.filter(sound).mapInPandas(_cut, fits.schema)).unionByName(failed)


def _with_specs(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every document with every spec: the specs (a handful of rows) become one array beside each document."""
    specs = [r.asDict() for r in wanted.orderBy("spec_id").collect()]
    if not specs:
        return sized.select(F.lit(None).cast("int").alias("spec_id"), "*", F.lit(None).cast("int").alias("capacity_tokens"), F.lit(None).cast("int").alias("overlap_tokens")).limit(0)
    rows = F.array(*[F.struct(*[F.lit(s[c]).alias(c) for c in wanted.columns]) for s in specs])
    return sized.select("*", F.explode(rows).alias("_spec")).select("*", "_spec.*").drop("_spec")


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for spec, doc, text, capacity, overlap in batch.itertuples(index=False):
            data = text.encode("utf-8", "surrogatepass")
            for k, (start, fresh, end) in enumerate(pieces(text, int(capacity), int(overlap)), 1):
                rows.append((spec, doc, k, start, fresh, end, end - start, data[start:end].decode("utf-8", "surrogatepass"), None))
        yield pd.DataFrame(rows, columns=["spec_id", "doc_id", "piece_number", "start_byte", "fresh_byte", "end_byte", "piece_bytes", "text", "error"])
