"""Counts of many texts at once, over arrays of their characters: no step goes through a text character by character.

The texts of a slice are joined, each character gets its properties from one table, and words, lines, blocks and n-grams are stretches between positions. Equal stretches
are found by a polynomial hash of 64 bits, whose prefix sums give the hash of any stretch by one subtraction. Time and memory grow with the number of characters
(and the sort of a text's word pairs); a slice holds ``SLICE`` characters or one longer text.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

#: Characters of a slice.
SLICE = 1 << 21
#: Visible characters that a cell of a table's row has on average at most, and those of a line of a list without marks.
CELL, SHORT = 22, 80

# Frequent function words of the six languages.
COMMON_WORDS = (
    "the of and to a in is that it for on with as this our each every another one from by at or "
    "der die das und den von zu mit ein eine einen nicht auf dem des im "
    "le la les de des du et un une en que pour dans sur à au "
    "el los las del y que una por con para se su al "
    "o os as do da e um uma com não na no dos das "
    "и в не на что с по это как из за для от к"
).split()
# Letters that are no vowels in any of the six languages.
CONSONANTS = "bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZбвгджзйклмнпртуфхцчшщБВГДЖЗЙКЛМНПРТФХЦЧШЩ".replace("у", "")
# What ends a sentence, what may end a line, what may stand behind either, and the signs of list items.
ENDS, STOPS, CLOSERS, BULLETS = ".!?…", ".!?…:;", "\"'”’»)]", "•◦▪○●‣·*–—-"
# What separates cells, and how many cells a row has at least; two spaces or more are the last of them.
CELLS = [("\t", 2), ("|", 2), (";", 2), (",", 3), ("  ", 2)]
MARKER = re.compile(r"\(?(?:\d{1,3}|[A-Za-zа-я]|[ivx]{1,4})[.)]")

SPACE, LETTER, NUMBER, SYMBOL, CONSONANT, END, STOP, CLOSER, BULLET, DIGIT, JOINS, PARTS, ROUND = (1 << k for k in range(13))
FIELDS = (
    "n_characters n_words n_visible n_symbols n_lines n_ended_lines n_readable n_common n_sentence_ends n_tokens n_numbers n_paragraphs repeated_lines repeated_paragraphs bullet_visible plain_visible table_visible"
).split()
SHARES = ["dominant_bigram_share", "dominant_trigram_share", "dominant_4gram_share"]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The properties of each code point, and its small letter where that is one character."""
    flags, low = np.zeros(0x110000, np.uint16), np.arange(0x110000, dtype=np.uint32)
    kinds = {"L": LETTER, "N": NUMBER, "S": SYMBOL, "Z": SPACE}
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        flags[c] = kinds.get(kind[0], 0)
        if kind in ("Lu", "Lt") and len(s := chr(c).lower()) == 1:
            low[c] = ord(s)
    for chars, flag in (("\t\n\v\f\r", SPACE), (CONSONANTS, CONSONANT), (ENDS, END), (STOPS, STOP), (CLOSERS, CLOSER), (BULLETS, BULLET), ("0123456789", DIGIT), (".:/-%", JOINS), ("|;,", PARTS), ("()", ROUND)):
        flags[[ord(c) for c in chars]] |= flag
    return flags, low


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * _BASE
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _powers(n: int, of: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, of, np.uint64)]))


class _Powers:
    """Powers of the base and of its inverse, kept as long as the longest slice needs."""

    up = down = np.zeros(0, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= n:
            cls.up, cls.down = _powers(n, _BASE), _powers(n, _INVERSE)
        return cls.up[: n + 1], cls.down[: n + 1]


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches of true begin and end; the last entry is false."""
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        change = np.concatenate([[0], change])
    return change[::2], change[1::2]


def _upto(mask: np.ndarray) -> np.ndarray:
    """How many are true before each position."""
    out = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=out[1:])
    return out


def _hash_of_word(word: str) -> int:
    h, at = 0, 1
    for c in word:
        h, at = (h + (ord(c) + 1) * at) & (2**64 - 1), at * int(_BASE) & (2**64 - 1)
    return h


@lru_cache(1)
def _common() -> np.ndarray:
    return np.array(sorted({_hash_of_word(w) for w in COMMON_WORDS}), np.uint64)


def _repeats(key: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each owner, the number of keys that equal another, earlier one of it."""
    _, first = np.unique(key ^ _mixed(owner.astype(np.uint64)), return_index=True)
    return np.bincount(owner, minlength=n) - np.bincount(owner[first], minlength=n)


def _dominant(hashes: np.ndarray, size: np.ndarray, doc: np.ndarray, whole: np.ndarray, texts: int) -> list[np.ndarray]:
    """For runs of 2, 3 and 4 words: the share of a text's characters that its most covering repeated run covers; NaN for fewer words.

    A longer run can only repeat where the shorter one at its beginning does, so each length looks at what is left of the one before.
    """
    words = np.bincount(doc, minlength=texts)
    at, key, width = np.arange(len(doc)), hashes, size
    out = []
    for n in (2, 3, 4):
        fits = at + n - 1 < len(doc)
        at, key, width = at[fits], key[fits], width[fits]
        fits = doc[at + n - 1] == doc[at]
        at, key, width = at[fits], key[fits], width[fits]
        with np.errstate(over="ignore"):
            key = _mixed(key * np.uint64(31) + hashes[at + n - 1])
        width = width + 1 + size[at + n - 1]
        best = np.zeros(texts)
        if len(at):
            own = key ^ _mixed(doc[at].astype(np.uint64))
            order = np.argsort(own, kind="quicksort")
            ranked = own[order]
            bounds = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1], [True]]))
            count = np.diff(bounds)
            again = count > 1
            one = order[bounds[:-1][again]]
            np.maximum.at(best, doc[at[one]], count[again] * width[one])
            keep = np.zeros(len(at), bool)
            keep[order[np.repeat(again, count)]] = True
            at, key, width = at[keep], key[keep], width[keep]
        out.append(np.where(words >= n, np.minimum(1.0, best / np.maximum(whole, 1)), np.nan))
    return out


def _slice(texts: list[str]) -> dict[str, np.ndarray]:
    flags, low = _tables()
    n = len(texts)
    length = np.array([len(t) for t in texts], np.int64)
    p = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.concatenate([[0], np.cumsum(length[:-1] + 1)])
    f = flags[p]
    up, down = _Powers.upto(len(p))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(p) + 1, np.uint64)
        np.cumsum((low[p].astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        hashed = lambda a, b: (sums[b] - sums[a]) * down[a]
        doc_of = lambda at: np.searchsorted(first, at, side="right") - 1
        per = lambda doc, weight=None: np.bincount(doc, weight, n)
        shown = (f & SPACE) == 0
        seen = _upto(shown)
        each = lambda upto: upto[first + length] - upto[first]
        out = {"n_characters": length, "n_visible": each(seen), "n_symbols": each(_upto(shown & ((f & (LETTER | NUMBER)) == 0)))}

        a, b = _runs(shown)
        doc = doc_of(a)
        out["n_words"] = per(doc)
        whole = per(doc, b - a) + np.maximum(out["n_words"] - 1, 0)
        shares = _dominant(hashed(a, b), b - a, doc, whole, n)

        # Readable words: letters alone, not all of them consonants.
        la, lb = _runs((f & (LETTER | NUMBER | SYMBOL)) != 0)
        odd, vowels = _upto((f & (NUMBER | SYMBOL)) != 0), _upto((f & (LETTER | CONSONANT)) == LETTER)
        good = (lb - la >= 2) & (odd[lb] == odd[la]) & (vowels[lb] > vowels[la])
        out["n_readable"] = per(doc_of(la[good]))
        ca, cb = _runs((f & (LETTER | NUMBER)) != 0)
        few = cb - ca <= max(map(len, COMMON_WORDS))
        ca, cb = ca[few], cb[few]
        known, own = _common(), hashed(ca, cb)
        out["n_common"] = per(doc_of(ca[known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own]))

        ta, tb = _runs(shown & ((f & PARTS) == 0))
        out["n_tokens"] = per(doc_of(ta))
        na, nb = _runs(shown & ((f & (PARTS | ROUND)) == 0))
        other = _upto((f & (DIGIT | JOINS)) == 0)
        digits = ((f[na] & DIGIT) != 0) & (other[na] == other[nb])
        out["n_numbers"] = per(doc_of(na[digits]))

        # A sentence ends where its marks follow a character, and a space follows them and what may close behind them.
        end = np.flatnonzero((f & END) != 0)
        end = end[end > 0]
        end = end[(f[end - 1] & (SPACE | END)) == 0]
        behind = end + 1
        for kind in (END, CLOSER):
            going = np.flatnonzero((f[behind] & kind) != 0)
            while len(going):
                behind[going] += 1
                going = going[(f[behind[going]] & kind) != 0]
        end = end[(f[behind] & SPACE) != 0]
        out["n_sentence_ends"] = per(doc_of(end))

        # Lines.
        stop = np.flatnonzero(p == 10)
        begin = np.concatenate([[0], stop[:-1] + 1])
        filled = seen[stop] > seen[begin]
        sentences = np.bincount(np.searchsorted(stop, end), minlength=len(stop))
        number = np.flatnonzero(filled)
        begin, stop, sentences = begin[filled], stop[filled], sentences[filled]
        size = (seen[stop] - seen[begin]).astype(np.int64)
        word = np.searchsorted(a, begin)
        last = np.searchsorted(a, stop) - 1
        la, lb = a[word], b[last]
        doc = doc_of(begin)
        out["n_lines"] = per(doc)
        out["repeated_lines"] = _repeats(hashed(la, lb), doc, n)
        at = lb - 1
        going = np.flatnonzero(((f[at] & CLOSER) != 0) & (at > la))
        while len(going):
            at[going] -= 1
            going = going[((f[at[going]] & CLOSER) != 0) & (at[going] > la[going])]
        out["n_ended_lines"] = per(doc[(f[at] & STOP) != 0])
        new = np.ones(len(doc), bool)
        new[1:] = (number[1:] != number[:-1] + 1) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(new)
        tail = np.concatenate([head[1:], [len(doc)]]) - 1 if len(head) else head
        out["n_paragraphs"] = per(doc[head])
        out["repeated_paragraphs"] = _repeats(hashed(la[head], lb[tail]), doc[head], n)

        # Items of lists begin with a mark that something follows; a single one is none.
        mark = b[word] - la
        marked = (mark == 1) & ((f[la] & BULLET) != 0)
        maybe = np.flatnonzero((mark <= 6) & (mark > 1) & np.isin(p[b[word] - 1], [ord("."), ord(")")]))
        marked[maybe] = [MARKER.fullmatch("".join(map(chr, p[x:y].tolist()))) is not None for x, y in zip(la[maybe].tolist(), b[word[maybe]].tolist())]
        marked &= last > word
        marked &= per(doc, marked)[doc] > 1
        out["bullet_visible"] = per(doc, np.where(marked, size, 0))
        block = np.cumsum(new) - 1
        rest = ~marked
        blocks = len(head)
        lines, held, ended = (np.bincount(block, np.where(rest, x, 0), blocks) for x in (np.ones(len(doc)), size, sentences))
        plain = (lines >= 3) & (held <= lines * SHORT) & (ended == 0)
        out["plain_visible"] = per(doc[head], np.where(plain, held, 0))

        # Rows of a table: lines of the most usual number of cells, for the separator that serves best.
        best = np.zeros(n)
        for sign, least in CELLS:
            if sign == "  ":
                gap = np.flatnonzero((a[1:] - b[:-1] >= 2) & (p[b[:-1]] == 32) & (p[a[1:] - 1] == 32))
                at = np.searchsorted(begin, a[gap], side="right") - 1
                same = at == np.searchsorted(begin, a[gap + 1], side="right") - 1
                cells = np.bincount(at[same], minlength=len(doc)) + 1
            else:
                cut = np.flatnonzero(p == ord(sign))
                at = np.searchsorted(stop, cut)
                inside = at < len(stop)
                at, cut = at[inside], cut[inside]
                cells = np.bincount(at[cut >= begin[at]], minlength=len(doc)) + 1
            rows = np.flatnonzero((cells >= least) & (size <= cells * CELL))
            if not len(rows):
                continue
            order = rows[np.lexsort((cells[rows], doc[rows]))]
            bounds = np.flatnonzero(np.concatenate([[True], doc[order][1:] != doc[order][:-1]]))
            many = np.diff(np.append(bounds, len(order)))
            usual = np.zeros(n, np.int64)
            usual[doc[order[bounds]]] = cells[order[bounds + many // 2]]
            same = rows[cells[rows] == usual[doc[rows]]]
            best = np.maximum(best, np.where(per(doc[same]) >= 2, per(doc[same], size[same]), 0))
        out["table_visible"] = best
    return {**{k: np.asarray(out[k]).astype(np.int64) for k in FIELDS}, **dict(zip(SHARES, shares))}


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    """All counts (``FIELDS``) and shares (``SHARES``, NaN where a text has too few words) of each text."""
    parts, at = [], 0
    while at < len(texts):
        size, to = 0, at
        while to < len(texts) and (to == at or size + len(texts[to]) <= SLICE):
            size += len(texts[to]) + 1
            to += 1
        parts.append(_slice(texts[at:to]))
        at = to
    if not parts:
        return {k: np.zeros(0, np.int64 if k in FIELDS else float) for k in [*FIELDS, *SHARES]}
    return {k: np.concatenate([x[k] for x in parts]) for k in parts[0]}
