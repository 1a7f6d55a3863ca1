"""Noise of scanned pages: words broken at line ends, misread characters, and page furniture; found, and repaired into paragraphs.

Words are counted over all texts. Those with at least ``LEAST`` occurrences and ``RARE`` of all words are the lexicon: there can be no more than 1 / ``RARE`` of them,
which bounds what is broadcast. A text loses its line ends and becomes a stream of characters and gaps, in which the cheapest path of words is found (Viterbi). From each place
where a word may begin, the words of the lexicon that the stream can be read as are followed character by character, together with

* confused characters (``CONFUSIONS``, a price and a demand on the word's frequency for each),
* spaces within a word (a merge), unless all its parts are words,
* marks at line ends within a word, which are dropped or are the word's own hyphen,
* ends and beginnings within a token that is no word itself (a split),

in any number and together. A token as it stands is a step too (the rarer, the dearer; unknown ones cost more than any known word). Tokens that are known words away from unknown ones
and marks are settled beforehand, as no other path can be cheaper there. A word that is broken between two regions of a frame is decoded with both parts.

Furniture is known by repetition. Page numbers are known by their form. Lines that stand in too many frames of a video (see ``repeated_lines``), and lines with a running number at their edge,
are what heads, footers and notices are learned from: a template is such a line with one to three capitalised words left open, if each open place was filled in ``FILLERS`` ways
in as many videos. Lines that fit a template are furniture everywhere. A region is furniture if the line that it is part of is.

Paragraph boundaries are chosen by dynamic programming over the lines: a boundary is cheap behind a short line that ends a sentence, before a capital,
and dear elsewhere; blank lines are boundaries; a paragraph may have any number of lines. Texts are brought to one consistent form first. Null and empty texts have no noise and no paragraphs.
"""

from __future__ import annotations

import itertools
import math
import re
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.llm.lookalikes import composed, mapped, may_change, visible
from glyphloom.llm.repeated_lines import LEAST_LETTERS, frequent_lines, letters
from glyphloom.session import if_small, materialize
from glyphloom.sources.tables import latest

# Characters as recognised, and what they were.
CONFUSIONS = "0 o, 1 l, 1 i, ! i, ! l, | l, | i, 5 s, 6 b, 8 b, 9 g, 3 e, rn m, m rn, vv w, cl d, d cl, ii u, u ii, ri n, n ri, nn m, c e, e c, b h, h b, f t, t f, q g, g q, u v, v u, i l, l i, ı i"
ALTERNATIVES: dict[str, list[tuple[str, str]]] = {}
for _pair in CONFUSIONS.split(", "):
    _seen, _was = _pair.split()
    ALTERNATIVES.setdefault(_seen[0], []).append((_seen, _was))
MARKS = "-¬=‐\xad"
#: Stands between the texts of a line's regions.
PART = "\x1f"
LEAST, RARE = 3, 1e-6
#: How much more frequent a word must be than a token that is taken for a misreading of it, for each confused place.
RATIO = 15.0
SPLIT, MERGE, JOIN = 6.0, 6.0, 0.2
#: What an unknown token costs more than the rarest word, and for each of its characters.
UNKNOWN, STRANGE = 1.2, 0.7
#: A template's open places: how many at most, how many fillers each needs and videos, and that share of all videos.
OPEN, FILLERS, TEMPLATE_SHARE = 3, 4, 1e-3

# The forms of page numbers.
_PAGE = re.compile(
    r"(?i)\s*(?:(?:page|pg\.?|p\.|seite|s\.|página|pagina|pág\.|slide|folie|стр\.?|страница)\s*\d{1,4}(?:\s*(?:of|/|von|de|sur|из)\s*\d{1,4})?|\d{1,3}|[-–—]\s*\d{1,4}\s*[-–—]|\[\s*\d{1,4}\s*\]|\d{1,4}\s*/\s*\d{1,4})\s*"
)
_DIGIT = re.compile(r"\d")
_EDGE = re.compile(r"^\d{1,4}\s{2,}|\s+\d{1,4}$")
_PARTS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+|[^\w\s]")
_TOKEN = re.compile(r"(?:[^\W_]|[!|])(?:[^\s\"“”«»(){}\[\],;:?…]*(?:[^\W_]|[!|]))?")
_MARKED = re.compile(rf"[^\W\d_][{MARKS}][ \t]*(?:\n|$)")
_LINE_END = re.compile(rf"([^\W\d_]+)[{MARKS}][ \t]*$")
_END = re.compile(r"[.!?…][\"'”’»)\]]*\s*$")
WORDS = rf"\p{{L}}+(?:['’-]\p{{L}}+)*(?![\p{{L}}{MARKS}])"


def templates(line: str) -> Iterator[tuple[str, tuple[str, ...]]]:
    """``line`` with numbers open and up to ``OPEN`` of its first eight capitalised words as well: each template that still has a word, and its fillers."""
    parts = _PARTS.findall(line)
    low = ["#" if x[0].isdigit() else x.lower() for x in parts]
    names = [k for k, x in enumerate(parts) if x[0].isupper()][:8]
    for n in range(1, OPEN + 1):
        for places in itertools.combinations(names, n):
            form = list(low)
            for k in places:
                form[k] = "@"
            if any(x[0].isalpha() for x in form):
                yield " ".join(form), tuple(low[k] for k in places)


class Furniture:
    """What lines are furniture: page numbers, and those that fit a learned template."""

    def __init__(self, known: list[str] | tuple[str, ...] = ()) -> None:
        self.known = set(known)
        # A line that has no word of a template's fitting rarest one cannot fit it.
        words = [[w for w in form.split(" ") if w[0].isalpha()] for form in self.known]
        often: dict[str, int] = {}
        for w in itertools.chain.from_iterable(words):
            often[w] = often.get(w, 0) + 1
        self.keys = {max(own, key=lambda w: (often[w], len(w), w)) for own in words if own}
        self.cache: dict[str, bool] = {}

    def __contains__(self, line: str) -> bool:
        text = line.strip()
        if not text:
            return False
        found = self.cache.get(text)
        if found is None:
            found = (_DIGIT.search(text) is not None and _PAGE.fullmatch(text) is not None) or self._fits(text)
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[text] = found
        return found

    def _fits(self, text: str) -> bool:
        low = text.lower()
        if len(self.keys) < 64 and not any(key in low for key in self.keys):
            return False
        if self.keys.isdisjoint(x.lower() for x in _PARTS.findall(text)):
            return False
        return any(form in self.known for part in {text, _EDGE.sub("", text)} for form, _ in templates(part))


class Step(NamedTuple):
    """A word of a decoded stream: its first and last token, where in them it begins and ends, its text, what it is, the tokens with confused characters, and the gaps within it (token before, kind)."""

    first: int
    last: int
    begin: int
    end: int
    text: str
    kind: str
    confused: tuple[int, ...] = ()
    gaps: tuple[tuple[int, str], ...] = ()


class Found(NamedTuple):
    end: int
    word: str
    places: tuple[tuple[int, int], ...]
    gaps: tuple[tuple[int, str], ...]


#: Gaps in a stream: a space, a hyphen at a line end, another mark there, and what no word reaches over.
SPACE, HYPHEN, MARK, WALL = " ", "\x01", "\x02", "\x00"
GAPS = SPACE + HYPHEN + MARK + WALL


class Lexicon:
    """Known words with their counts, and decoding by them."""

    def __init__(self, counts: dict[str, int], total: int) -> None:
        self.counts, self.total = counts, max(total, 2)
        self.words = sorted(counts)
        self.fronts: dict[str, int] = {}
        for word, n in counts.items():
            at = word.find("-")
            while at > 0:
                self.fronts[word[:at]] = self.fronts.get(word[:at], 0) + n
                at = word.find("-", at + 1)
        #: More places than these would need a more frequent word than there is.
        self.places = int(math.log(max(2 * max(counts.values(), default=1), 1)) / math.log(RATIO))
        self.unknown = math.log(self.total) + UNKNOWN
        self.cache: dict[str, tuple[float, str, int]] = {}
        self.clean: set[str] = set()
        self.prefixes: dict[str, bool] = {}

    def cost(self, word: str) -> float | None:
        n = self.counts.get(word)
        return None if n is None else math.log(self.total / n)

    def begins(self, prefix: str) -> bool:
        """Whether any word begins with ``prefix``."""
        known = self.prefixes.get(prefix)
        if known is None:
            at = bisect_left(self.words, prefix)
            known = at < len(self.words) and self.words[at].startswith(prefix)
            if len(self.prefixes) > 300_000:
                self.prefixes.clear()
            self.prefixes[prefix] = known
        return known

    def follow(self, stream: str, start: int, places: int) -> Iterator[Found]:
        """Every word that ``stream`` can be read as from ``start``, with up to so many confused places, over any gaps but walls."""
        stack = [(start, "", (), ())]
        while stack:
            at, prefix, confused, gaps = stack.pop()
            if prefix in self.counts and stream[at - 1] not in GAPS:
                yield Found(at, prefix, confused, gaps)
            c = stream[at] if at < len(stream) else WALL
            if c == WALL:
                continue
            if c in GAPS:
                if at > start:
                    stack.append((at + 1, prefix, confused, (*gaps, (at, "merged" if c == SPACE else "broken"))))
                    if c == HYPHEN and self.begins(prefix + "-"):
                        stack.append((at + 1, prefix + "-", confused, (*gaps, (at, "own"))))
                continue
            if self.begins(prefix + c):
                stack.append((at + 1, prefix + c, confused, gaps))
            if len(confused) < places:
                for seen, was in ALTERNATIVES.get(c, ()):
                    if stream.startswith(seen, at) and self.begins(prefix + was):
                        stack.append((at + len(seen), prefix + was, (*confused, (at, at + len(seen) - 1)), gaps))

    def _likely(self, word: str, places: int, seen: str) -> bool:
        """The word must be as many times more frequent than what was seen as its places say, with something unseen at half an occurrence."""
        return not places or (len(word) > 2 and self.counts[word] >= RATIO**places * max(self.counts.get(seen, 0), 0.5))

    def read(self, token: str) -> tuple[float, str, int]:
        """The cheapest reading of one token: cost, word, confused places. A reading with fewer confused places goes first."""
        known = self.cache.get(token)
        if known is not None:
            return known
        low = token.lower()
        if not low.isupper() and any(a.islower() and b == "I" for a, b in zip(token, token[1:])):
            other = "".join("l" if k and c == "I" and token[k - 1].islower() else c.lower() for k, c in enumerate(token))
            if self.counts.get(other, 0) >= RATIO:
                return self._kept(token, (self.cost(other) + math.log(RATIO), other, 1))
        plain = self.cost(low)
        best = (self.unknown + STRANGE * len(low) if plain is None else plain, low, 0)
        if len(low) > 2 and any(c.isalpha() for c in low):
            fits = [(len(f.places), self.cost(f.word), f.word) for f in self.follow(low, 0, self.places if plain is None else 1) if f.end == len(low) and f.places and self._likely(f.word, len(f.places), low)]
            if fits:
                n, price, word = min(fits)
                best = (price + math.log(RATIO) * n * 0.5, word, n)
        return self._kept(token, best)

    def _kept(self, token: str, best: tuple[float, str, int]) -> tuple[float, str, int]:
        if len(self.cache) > 200_000:
            self.cache.clear()
        self.cache[token] = best
        return best

    def lost(self, token: str) -> bool:
        """Whether a token has letters and no reading of its own. A known word with an exclamation mark has one."""
        if self.read(token)[0] < self.unknown or len(token) < 3 or not any(c.isalpha() for c in token):
            return False
        return token[-1] != "!" or token.rstrip("!").lower() not in self.counts

    def decode(self, tokens: list[tuple[str, str]]) -> list[Step]:
        """The cheapest path over (token, gap behind it). A gap is a space, a mark at a line end, or one that no word reaches over ('')."""
        n = len(tokens)
        open_ = [False] * n
        for k, (token, gap) in enumerate(tokens):
            if self.lost(token):
                open_[max(0, k - 2) : k + 3] = [True] * len(open_[max(0, k - 2) : k + 3])
            if gap and gap in MARKS and k + 1 < n:
                open_[k] = open_[k + 1] = True
        steps, k = [], 0
        while k < n:
            if open_[k]:
                end = k
                while end < n and open_[end]:
                    end += 1
                steps += self._window(tokens[k:end], k)
                k = end
            else:
                steps.append(self._single(tokens[k][0], k))
                k += 1
        return steps

    def _single(self, token: str, k: int) -> Step:
        _, word, n = self.read(token)
        return Step(k, k, 0, len(token), _cased(word, token) if n else token, "misread" if n else "plain", (k,) if n else ())

    def _window(self, tokens: list[tuple[str, str]], base: int) -> list[Step]:
        signs = [(SPACE if gap == " " else HYPHEN if gap == "-" else MARK if gap else WALL) for _, gap in tokens]
        signs[-1] = WALL
        shown = "".join(token + sign for (token, _), sign in zip(tokens, signs))
        stream = shown.lower() if len(shown.lower()) == len(shown) else "".join(low if len(low := c.lower()) == 1 else c for c in shown)
        owner, head = [], []
        for k, (token, _) in enumerate(tokens):
            head.append(len(owner))
            owner += [k] * (len(token) + 1)
        starts = {at: k for k, at in enumerate(head)}
        lost = [self.lost(token) for token, _ in tokens]
        best: list[tuple[float, int, Step | None]] = [(math.inf, -1, None)] * (len(stream) + 1)
        best[0] = (0.0, -1, None)
        for at in range(len(stream)):
            so_far = best[at][0]
            if so_far == math.inf:
                continue
            whole = starts.get(at)
            if whole is not None:
                token = tokens[whole][0]
                end, price = at + len(token) + 1, so_far + self.read(token)[0]
                if price < best[end][0]:
                    best[end] = (price, at, self._single(token, base + whole))
            k = owner[at]
            for f in self.follow(stream, at, self.places):
                last = owner[f.end - 1]
                inside_end = stream[f.end] not in GAPS
                if (whole is not None and not inside_end and not f.gaps) or (inside_end and not lost[last]):
                    continue
                cut = inside_end or whole is None
                seen = "".join(c for c in stream[at : f.end] if c not in GAPS)
                if (cut and (len(f.word) < 2 or self.counts[f.word] < RATIO)) or not self._likely(f.word, len(f.places) + (cut and len(f.places) > 0), seen):
                    continue
                kinds = [kind for _, kind in f.gaps]
                if "merged" in kinds and all(self.cost(tokens[x][0].lower()) is not None for x in range(k, last + 1)):
                    continue
                price = so_far + self.cost(f.word) + math.log(RATIO) * 0.5 * len(f.places) + sum(MERGE if kind == "merged" else JOIN for kind in kinds) + SPLIT * inside_end
                end = f.end if inside_end else f.end + 1
                if price < best[end][0]:
                    text = "".join("-" if (x, "own") in f.gaps else "" if stream[x] in GAPS else shown[x] for x in range(at, f.end))
                    kind = "broken" if "broken" in kinds else "own" if "own" in kinds else "merged" if kinds else "split"
                    confused = tuple(sorted({base + owner[x] for place in f.places for x in place}))
                    step = Step(base + k, base + last, at - head[k], f.end - head[last], _cased(f.word, text) if f.places else text, kind, confused, tuple((base + owner[x], kind) for x, kind in f.gaps))
                    best[end] = (price, at, step)
        steps, at = [], len(stream)
        while at:
            _, at, step = best[at]
            steps.append(step)
        return steps[::-1]

    def sound(self, token: str) -> bool:
        """Whether ``token`` is as it stands what any path would take it for: a known word, or without letters to decode."""
        if token in self.clean:
            return True
        if self.read(token)[2] or self.lost(token):
            return False
        if len(self.clean) > 200_000:
            self.clean.clear()
        self.clean.add(token)
        return True


def _cased(word: str, token: str) -> str:
    return word.upper() if token.isupper() and len(token) > 1 else word[:1].upper() + word[1:] if token[:1].isupper() else word


def tokens_of(text: str) -> list[tuple[str, str, int, int]]:
    """Tokens with the gap behind them and where they begin and end; line ends count as spaces unless a mark stands there."""
    found = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text)]
    out = []
    for k, (token, a, b) in enumerate(found):
        after = text[b : found[k + 1][1]] if k + 1 < len(found) else text[b:]
        mark = re.match(rf"([{MARKS}])[ \t]*(?:\n|$)", after)
        gap = mark.group(1) if mark and token[-1].isalpha() else " " if not after.strip() else ""
        out.append((token, gap, a, b))
    return out


def noise(lexicon: Lexicon, text: str, before: str = "", after: str = "") -> tuple[bool, bool, list]:
    """Whether words of ``text`` are broken at a line end, and whether any is misread; and the steps of its decoding, with their places.

    ``before`` is the part of a word that the text continues, with its mark left out; ``after`` is the token that follows the text.
    """
    if not before and not _MARKED.search(text) and all(map(lexicon.sound, _TOKEN.findall(text))):
        return False, False, []
    own = tokens_of(text)
    if not own:
        return False, False, []
    lead = [(before, "-", -1, -1)] if before else []
    tail = [(after, "", -1, -1)] if after and own[-1][1] in MARKS and own[-1][1] else []
    every = lead + own + tail
    steps = lexicon.decode([(t, g) for t, g, _, _ in every])
    mine = range(len(lead), len(lead) + len(own))
    broken = misread = False
    placed = []
    for step in steps:
        # Of a word in two records, the misread character may be in the other one.
        misread |= any(k in mine for k in step.confused)
        broken |= any(kind == "broken" and k in mine for k, kind in step.gaps)
        token, gap, start, _ = every[step.last]
        if gap and gap in MARKS and step.last in mine and step.end == len(token):
            # Without a known whole the mark divides the word, unless words begin with this part and their own hyphen.
            follows = every[step.last + 1][0] if step.last + 1 < len(every) else ""
            fronts = lexicon.fronts.get(token.lower(), 0) >= LEAST
            broken |= gap != "-" or (not fronts and (not follows or follows[:1].islower()))
        if every[step.first][2] >= 0 and start >= 0:
            placed.append((every[step.first][2] + step.begin, start + step.end, (" " if step.begin else "") + step.text, step.kind))
    return broken, misread, placed


def page_lines(furniture: Furniture, text: str) -> tuple[list[str], bool]:
    """The lines of a page without furniture, and whether there was any."""
    lines = text.split("\n")
    kept = [line for line in lines if line not in furniture]
    return kept, len(kept) < len(lines)


#: Lines of a paragraph up to which it costs nothing to be long, and the price of each further one.
LONG, FURTHER = 12, 0.02


def boundaries(lines: list[str]) -> list[list[str]]:
    """The paragraphs of ``lines`` (none blank) of least cost, of any length: beginnings further back than ``LONG`` lines differ by a constant, so that the best of them is carried along."""
    if not lines:
        return []
    width = sorted(len(x.strip()) for x in lines)[len(lines) * 3 // 4]

    def between(a: str, b: str) -> float:
        price = 4.0 - 3.0 * bool(_END.search(a)) - 2.0 * (len(a.strip()) < 0.6 * width) - 1.0 * b.strip()[:1].isupper()
        if _LINE_END.search(a) or b.strip()[:1].islower():
            price += 8.0
        return price

    cut = [0.0] + [between(a, b) for a, b in zip(lines, lines[1:])]
    best = [0.0] + [math.inf] * len(lines)
    start = [0] * (len(lines) + 1)
    opened = lambda i: best[i] + (cut[i] if i else 0.0)
    far = (math.inf, 0)
    for j in range(1, len(lines) + 1):
        if j > LONG:
            i = j - LONG - 1
            far = min(far, (opened(i) - FURTHER * (i + LONG), i))
        best[j], start[j] = far[0] + FURTHER * j, far[1]
        for i in range(max(0, j - LONG), j):
            price = opened(i) + 0.5 * (j - i == 1)
            if price < best[j]:
                best[j], start[j] = price, i
    out, j = [], len(lines)
    while j:
        out.append(lines[start[j] : j])
        j = start[j]
    return out[::-1]


def repaired(lexicon: Lexicon, furniture: Furniture, text: str) -> list[str]:
    """The paragraphs of a page, in continuous and corrected words."""
    return repaired_lines(lexicon, page_lines(furniture, text)[0])


def frame_lines(furniture: Furniture, lines: list[str]) -> list[str]:
    """The lines of a frame without furniture and blank ones. Each is its regions' texts with ``PART`` between them; a mark at a region's end is one at a line end."""
    own = [line.split(PART) for line in lines]
    kept = ["".join(p + ("\n" if _LINE_END.search(p) else " ") for p in parts).rstrip() for parts in own if " ".join(parts) not in furniture]
    return [line for line in kept if line]


def repaired_lines(lexicon: Lexicon, kept: list[str]) -> list[str]:
    """The paragraphs of lines without furniture, in continuous and corrected words."""
    out = []
    for block in re.split(r"\n[ \t]*\n", "\n".join(kept)):
        for lines in boundaries([x for x in block.split("\n") if x.strip()]):
            joined = "\n".join(x.rstrip() for x in lines)
            _, _, placed = noise(lexicon, joined)
            parts, at = [], 0
            for a, b, word, _ in placed:
                if a < 0:
                    continue
                parts += [joined[at:a], word]
                at = b
            out.append(re.sub(r"\s+", " ", "".join(parts) + joined[at:]).strip())
    return out


def consistent_form(text: Column) -> Column:
    """The consistent form of single texts, for decoding; no grouping is needed where the form isn't compared with others.

    The condition stands inside the Python function's argument: around it, it would not keep any row from being mapped and sent.
    """
    return F.coalesce(composed(F.when(may_change(text), visible(mapped(text)))), text)


def region_context(regions: DataFrame) -> DataFrame:
    """``region_id, video_id, frame, text, before, after, line_text, frame_id, source_index, line, item``: the neighbours of a region in reading order, and its line with its number and identifier.

    A region is on the line of the one before if they overlap by half in height and it begins behind its end. Regions without a frame stand alone.
    """
    rows = latest(regions.select("region_id", "video_id", "frame_id", "source_index", "text", "box", "ingested_at"), "region_id", "ingested_at")
    rows = rows.withColumns({"text": consistent_form(F.col("text")), "frame": F.coalesce(F.col("frame_id"), -F.col("region_id"))})
    order = Window.partitionBy("frame").orderBy("source_index", "region_id")
    left, top, right, bottom = (F.try_element_at("box", F.lit(k)) for k in (1, 2, 3, 4))
    rows = rows.withColumns({"_l": left, "_t": top, "_r": right, "_b": bottom})
    shared = F.least("_b", F.lag("_b").over(order)) - F.greatest("_t", F.lag("_t").over(order))
    height = F.least(F.col("_b") - F.col("_t"), F.lag("_b").over(order) - F.lag("_t").over(order))
    same = (shared >= height * 0.5) & (F.col("_l") >= F.lag("_r").over(order) - 4)
    rows = rows.withColumns({"_new": F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1), "_last": F.lag("text").over(order), "_next": F.lead("text").over(order)})
    rows = rows.withColumn("_line", F.sum("_new").over(order))
    line = Window.partitionBy("frame", "_line").orderBy("source_index", "region_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.select(
        "region_id",
        "video_id",
        "frame",
        "text",
        F.regexp_extract("_last", rf"(\p{{L}}+)[{MARKS}]\s*$", 1).alias("before"),
        F.regexp_extract("_next", r"^\s*([^\s.,;:?()]+)", 1).alias("after"),
        F.array_join(F.collect_list("text").over(line), " ").alias("line_text"),
        "frame_id",
        "source_index",
        F.col("_line").alias("line"),
    ).withColumn("item", F.transform(F.array(letters(F.col("line_text"))), lambda k: F.when(F.length(k) >= LEAST_LETTERS, F.xxhash64(k)))[0])


def with_known(keyed: DataFrame) -> DataFrame:
    """``keyed`` (of ``region_context``) with ``known``: true if their line stands in too many frames of its video, else null."""
    each = keyed.filter("item IS NOT NULL AND video_id IS NOT NULL").select("video_id", "frame", "item").distinct()
    totals = each.select("video_id", "frame").distinct().groupBy("video_id").agg(F.count("*").alias("total"))
    ones = materialize(frequent_lines(each.select("video_id", "item"), totals, "video_id").select("video_id", "item", F.lit(True).alias("known")))
    return keyed.join(if_small(ones), ["video_id", "item"], "left")


def lexicon_counts(texts: DataFrame) -> tuple[DataFrame, int]:
    """``word, n`` of the words that are frequent enough to be known, and the number of all words of ``texts.text``."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORDS), F.lit(0))).alias("word"))
    counts = materialize(words.groupBy("word").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.filter(F.col("n") >= max(LEAST, math.ceil(total * RARE))), total


def learned_templates(lines: DataFrame) -> list[str]:
    """Templates of furniture from ``video_id, line``: lines that are repeated in their video, or whose running number was taken off.

    A template holds ``TEMPLATE_SHARE`` of the videos at least, so that there are no more of them than a video has such lines times the templates of a line (at most 92), divided by that share.
    """
    alike = materialize(lines.select("video_id", F.regexp_replace("line", "[0-9]+", "0").alias("line")).distinct())
    videos = alike.agg(F.count_distinct("video_id")).first()[0]
    least = max(FILLERS, math.ceil(videos * TEMPLATE_SHARE))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(video, form, fillers) for video, line in batch.itertuples(index=False) for form, fillers in templates(line)]
            yield pd.DataFrame(rows, columns=["video_id", "form", "fillers"])

    forms = materialize(alike.mapInPandas(run, "video_id string, form string, fillers array<string>"))
    spread = forms.groupBy("form", "video_id").agg(F.lit(1).alias("_one")).groupBy("form").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("form")
    filled = forms.select("form", F.posexplode("fillers").alias("place", "filler")).groupBy("form", "place", "filler").agg(F.lit(1).alias("_one")).groupBy("form", "place").agg(F.count("*").alias("n"))
    found = filled.groupBy("form").agg(F.min("n").alias("n")).filter(F.col("n") >= FILLERS).join(spread, "form").select("form")
    return sorted(r[0] for r in found.collect())


def numbered_lines(texts: DataFrame) -> DataFrame:
    """``video_id, line`` of the lines of ``texts.text`` that have a running number at their edge, without it."""
    lines = texts.filter(F.col("video_id").isNotNull()).select("video_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line"))
    edge = r"^[0-9]{1,4}\s{2,}|\s+[0-9]{1,4}$"
    digit = lambda c: c.between("0", "9")
    return lines.filter((digit(F.left("line", F.lit(1))) | digit(F.right("line", F.lit(1)))) & F.col("line").rlike(edge)).select("video_id", F.regexp_replace("line", edge, "").alias("line")).filter("line <> ''")


_KNOWN: dict[str, tuple[Lexicon, Furniture]] = {}


def _known(shared) -> tuple[Lexicon, Furniture]:
    """The lexicon and the furniture of a broadcast and its name, made once in each Python worker, with what they have read so far; one at a time."""
    shared, key = shared
    if key not in _KNOWN:
        _KNOWN.clear()
        counts, total, forms = shared.value
        _KNOWN[key] = Lexicon(counts, total), Furniture(forms)
    return _KNOWN[key]


def _examine(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, furniture = _known(shared)
        seen: dict[tuple[str, str, str], tuple[bool, bool]] = {}  # frames of a slide show the same regions
        for batch in batches:
            rows = []
            for kind, key, text, before, after, line, known in zip(*[batch[c].tolist() for c in batch.columns]):
                if kind == "region":
                    found = bool(known) or (line or "") in furniture
                    place = (text, before or "", (after or "") if text.rstrip()[-1:] in MARKS else "")
                    if (both := seen.get(place)) is None:
                        if len(seen) > 100_000:
                            seen.clear()
                        both = seen[place] = noise(lexicon, *place)[:2]
                    broken, misread = both
                else:
                    kept, found = page_lines(furniture, text)
                    broken, misread = noise(lexicon, "\n".join(kept))[:2]
                for name, holds in (("broken_word", broken), ("misread_character", misread), ("page_furniture", found)):
                    if holds:
                        rows.append((kind, key, name))
            yield pd.DataFrame(rows, columns=["record_kind", "record_id", "noise_kind"])

    return run


def _tables(paragraphs: DataFrame, slides: DataFrame) -> DataFrame:
    own = paragraphs.select(F.lit("paragraph").alias("record_kind"), F.col("paragraph_id").alias("record_id"), "video_id", "text")
    other = slides.select(F.lit("candidate").alias("record_kind"), F.col("benchmark_id").alias("record_id"), "video_id", F.col("candidate_text").alias("text"))
    return own.unionByName(other).filter("text IS NOT NULL").distinct().withColumn("text", consistent_form(F.col("text")))


def _shared(pieces: DataFrame, pages: DataFrame, keyed: DataFrame):
    """The broadcast of the words and templates of all texts, with a name for it. ``keyed`` are the pieces with what is known of their lines."""
    counts, total = lexicon_counts(pieces.select("text").unionByName(pages.select("text")))
    words = {r[0]: r[1] for r in counts.collect()}  # at most 1 / RARE words
    lines = keyed.filter("known AND line_text IS NOT NULL").select("video_id", F.trim("line_text").alias("line"))
    numbers = numbered_lines(pages.select("video_id", "text").unionByName(pieces.select("video_id", F.col("line_text").alias("text"))))
    return pieces.sparkSession.sparkContext.broadcast((words, total, learned_templates(lines.unionByName(numbers)))), uuid.uuid4().hex


def scan_noise(regions: DataFrame, paragraphs: DataFrame, slides: DataFrame) -> DataFrame:
    """``record_kind, record_id, noise_kind``: one row per record and kind of noise in it. Redelivered rows count once."""
    pieces = materialize(region_context(regions).drop("frame_id", "source_index", "line"))
    pages = materialize(_tables(paragraphs, slides))
    keyed = with_known(pieces)
    shared = _shared(pieces, pages, keyed)
    known = keyed.filter("text IS NOT NULL")
    rows = known.select(F.lit("region").alias("record_kind"), F.col("region_id").alias("record_id"), "text", "before", "after", "line_text", F.coalesce("known", F.lit(False)).alias("known")).unionByName(
        pages.select("record_kind", "record_id", "text", F.lit("").alias("before"), F.lit("").alias("after"), F.lit("").alias("line_text"), F.lit(False).alias("known"))
    )
    return rows.mapInPandas(_examine(shared), "record_kind string, record_id long, noise_kind string").distinct()


def frame_texts(keyed: DataFrame) -> DataFrame:
    """``record_kind, record_id, lines``: the lines of each frame in their order, without those known as furniture; regions without a frame are records of their own."""
    shown = keyed.filter("known IS NULL AND text IS NOT NULL")
    part = F.struct("source_index", "region_id", "text")
    lines = shown.groupBy("frame", "frame_id", "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["text"]), PART).alias("body"), F.min("region_id").alias("_region"))
    frames = lines.groupBy("frame", "frame_id").agg(F.sort_array(F.collect_list(F.struct("line", "body"))).alias("_lines"), F.min("_region").alias("_region"))
    kind = F.when(F.col("frame_id").isNull(), "region").otherwise("frame")
    return frames.select(kind.alias("record_kind"), F.coalesce("frame_id", "_region").alias("record_id"), F.transform("_lines", lambda x: x["body"]).alias("lines"))


PARAGRAPHS = "record_kind string, record_id long, paragraph_number int, text string"


def readable_paragraphs(regions: DataFrame, paragraphs: DataFrame, slides: DataFrame) -> DataFrame:
    """``record_kind, record_id, paragraph_number, text``: every frame's regions, and every paragraph and candidate text, as continuous readable paragraphs.

    The regions of a frame are one text (kind ``frame``), so that a word broken between two of them is one word; a region without a frame is its own (kind ``region``).
    """
    pages = materialize(_tables(paragraphs, slides))
    pieces = materialize(region_context(regions))
    keyed = with_known(pieces)
    shared = _shared(pieces, pages, keyed)

    def repair(texts: Callable[[Lexicon, Furniture, object], list[str]]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = _known(shared)
            for batch in batches:
                rows = [(kind, key, k, t) for kind, key, text in batch.itertuples(index=False) for k, t in enumerate(texts(*known, text), 1)]
                yield pd.DataFrame(rows, columns=["record_kind", "record_id", "paragraph_number", "text"])

        return run

    frames = frame_texts(keyed).mapInPandas(repair(lambda lexicon, furniture, lines: repaired_lines(lexicon, frame_lines(furniture, lines))), PARAGRAPHS)
    return pages.drop("video_id").mapInPandas(repair(repaired), PARAGRAPHS).unionByName(frames)
