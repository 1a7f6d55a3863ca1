"""The language of each record and of each segment of it, with a calibrated confidence.

* Features are hashed pairs and triples of neighbouring letters (anything else is a word boundary), weighted by TF-IDF. Document frequencies are counted over all
  records; the term frequency is a feature's share of its segment.
* The classifier is sparse multinomial logistic regression, fitted by follow-the-regularised-leader with elastic-net penalties on the segments of a bounded sample of
  distinct labelled texts (``SAMPLE``), in the order of a hash. As labels are noisy, segments that the first fit contradicts are left out of the second.
* Confidences are calibrated by one temperature, fitted on held-out segments.
* A text is cut into sentences (runs of words where no sentence ends). Each gets its probabilities; a record's languages are the most probable sequence over its
  segments, in which a change of language has a price, so that one uncertain sentence makes no record mixed.

Null and empty texts, and texts without readable words, have no language. A site's own lines are dropped beforehand.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.llm.repeated_lines import without_notices
from glyphloom.session import materialize

LANGUAGES = ["de", "en", "es", "fr", "pt", "ru"]
# The usual spellings of the languages' names, in lower case, without region.
SPELLINGS = {
    "de": "de deu ger german deutsch",
    "en": "en eng english",
    "es": "es spa spanish español espanol castellano",
    "fr": "fr fra fre french français francais",
    "pt": "pt por portuguese português portugues",
    "ru": "ru rus russian русский",
}
#: Labelled records and segments that the classifier is fitted on, at most.
SAMPLE = 3000
SEGMENTS = 30_000
PAIRS, TRIPLES = 1 << 14, 1 << 16
WIDTH = PAIRS + TRIPLES
#: Words of a segment where no sentence ends.
RUN = 16
#: What a change of language costs, in nats, and the confidence that a language of a record needs.
CHANGE = 3.0
SURE = 0.8
#: The confidence that a language needs in order to speak against a label or beside another language.
CONTRADICTS = 0.95
LEAST_LETTERS = 8
IS_CYRILLIC = np.array([code == "ru" for code in LANGUAGES])
#: Score taken off a language that isn't written in the segment's script.
IMPOSSIBLE = 30.0

_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|\n[ \t]*\n+")
_VOWELS = "aeiouyáéíóúàèìòùâêîôûäëïöüãõåæœаеёиоуыэюя"


def label(spelling: Column) -> Column:
    """The two-letter code of any usual spelling, else null."""
    short = F.lower(F.trim(F.regexp_extract(spelling, r"^\s*([\p{L} ]+)", 1)))
    known = F.create_map(*[F.lit(x) for code, names in SPELLINGS.items() for name in names.split() for x in (name, code)])
    return F.try_element_at(known, short)


def segments(text: str) -> list[str]:
    """The sentences of ``text``; long ones, and lines without sentences, in runs of ``RUN`` words."""
    out = []
    for part in _SENTENCE.split(text):
        line = part.replace("\n", " ").strip()
        if line.count(" ") < RUN + RUN // 2:
            if line:
                out.append(line)
        else:
            words = line.split()
            for k in range(0, len(words), RUN):
                out.append(" ".join(words[k : k + RUN]))
    return out


def _table() -> np.ndarray:
    """The code of each character: small letters have their own, capitals that of their small letter, all else is 0."""
    codes = np.zeros(0x600, np.uint32)
    for p in range(0x600):
        low = chr(p).lower()
        if chr(p).isalpha() and len(low) == 1 and ord(low) < 0x600:
            codes[p] = ord(low)
    return codes


CODES = _table()
IS_VOWEL = np.zeros(0x600, bool)
IS_VOWEL[[ord(c) for c in _VOWELS]] = True


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of all texts in a row (a pair and a triple per character), where each text's begin, and its numbers of letters, vowels and Cyrillic letters."""
    joined = " ".join(texts) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    c = CODES[np.minimum(points, 0x5FF)]
    length = np.array([len(t) + 1 for t in texts], np.int64)
    start = np.concatenate([[0], np.cumsum(length)[:-1]])
    letter = c > 0
    before, after = np.empty_like(c), np.empty_like(c)
    before[0], before[1:] = 0, c[:-1]
    after[-1], after[:-1] = 0, c[1:]
    pair = c * np.uint32(40503) + after * np.uint32(2654435761)
    pair = (pair ^ (pair >> np.uint32(15))) & np.uint32(PAIRS - 1)
    triple = (before * np.uint32(2246822519)) ^ (c * np.uint32(3266489917)) ^ (after * np.uint32(668265263))
    triple = triple * np.uint32(374761393)
    triple = ((triple ^ (triple >> np.uint32(13))) & np.uint32(TRIPLES - 1)) + np.uint32(PAIRS)
    # A triple's middle and a pair's first character must be letters; the others point at an unused number.
    both = np.empty((len(c), 2), np.uint32)
    both[:, 0], both[:, 1] = np.where(letter, pair, WIDTH), np.where(letter, triple, WIDTH)
    count = lambda what: np.add.reduceat(what, start, dtype=np.int64)
    return both, start, np.stack([count(letter), count(IS_VOWEL[np.minimum(c, 0x5FF)]), count((c >= 0x400) & (c < 0x530))])


def _document_frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total, seen, n = np.zeros(WIDTH + 1, np.int64), np.zeros(WIDTH + 1, np.uint8), 0
    few, some = np.zeros(WIDTH + 1, np.uint16), 0  # narrow counters are added to fast, and emptied before they could overflow
    for batch in batches:
        texts = [t for t in batch["text"] if t]
        if not texts:
            continue
        number, start, _ = features(texts)
        ends = [*start[1:].tolist(), len(number)]
        for a, b in zip(start.tolist(), ends):
            own = number[a:b].ravel()
            seen[own] = 1
            few += seen
            seen[own] = 0
            some += 1
            if some == 60_000:
                total += few
                few[:], some = 0, 0
        n += len(texts)
    total += few
    total[WIDTH] = n
    at = np.flatnonzero(total)
    yield pd.DataFrame({"feature": at, "n": total[at]})


def inverse_frequencies(records: DataFrame) -> tuple[np.ndarray, int]:
    """The IDF of every feature over all records, and their number; a task sends at most one row per feature."""
    counts = records.select("text").mapInPandas(_document_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    df = np.zeros(WIDTH + 1)
    for r in counts.collect():  # no more than WIDTH + 1 rows
        df[r[0]] = r[1]
    n = df[WIDTH]
    idf = np.log((1 + n) / (1 + df)) + 1
    idf[df == 0] = 0
    idf[WIDTH] = 0
    return idf.astype(np.float32), int(n)


def scores(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unscaled class scores of each text, with its letters and vowels. ``weights`` has the IDF in it and a row of zeros at the end."""
    number, start, (letters, vowels, cyrillic) = features(texts)
    total = np.zeros((len(texts), weights.shape[1]), np.float32)
    step = 1 << 20
    # Whole texts are summed in stretches that fit the cache.
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(start, start[first] + step)))
        a, b = start[first], start[last] if last < len(texts) else len(number)
        part = weights[number[a:b, 0]]
        part += weights[number[a:b, 1]]
        total[first:last] = np.add.reduceat(part, start[first:last] - a, axis=0)
        first = last
    total /= np.maximum(letters, 1)[:, None]
    # The script settles what it can.
    total[(cyrillic * 2 > letters)[:, None] != IS_CYRILLIC] -= IMPOSSIBLE
    return total, letters, vowels


class Ftrl:
    """Multinomial logistic regression by FTRL-proximal with L1 and L2 penalties, one learning rate per weight."""

    def __init__(self, width: int, classes: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 2e-4, l2: float = 1e-5) -> None:
        self.z, self.n = np.zeros((width, classes)), np.zeros((width, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def step(self, owner: np.ndarray, feature: np.ndarray, value: np.ndarray, target: np.ndarray) -> None:
        rows, at = np.unique(feature, return_inverse=True)
        w = self.weights(rows)
        logit = np.zeros((len(target), w.shape[1]))
        np.add.at(logit, owner, w[at] * value[:, None])
        p = _softmax(logit)
        p[np.arange(len(target)), target] -= 1
        grad = np.zeros_like(w)
        np.add.at(grad, at, p[owner] * value[:, None] / len(target))
        old = self.n[rows]
        new = old + grad**2
        self.z[rows] += grad - (np.sqrt(new) - np.sqrt(old)) / self.alpha * w
        self.n[rows] = new


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


#: TF-IDF values are shares of a segment and so small; this brings them to the scale that the penalties expect.
SCALE = 10.0


def fit(texts: list[str], targets: np.ndarray, idf: np.ndarray, epochs: int = 2, batch: int = 256) -> np.ndarray:
    """Weights (features and a row of zeros, classes) of a classifier of segments, with IDF and temperature in them."""
    if not texts:
        return np.zeros((WIDTH + 1, len(LANGUAGES)), np.float32)
    order = np.random.default_rng(7).permutation(len(texts))
    held, learned = order[: len(order) // 5], order[len(order) // 5 :]

    def train(chosen: np.ndarray) -> np.ndarray:
        model = Ftrl(WIDTH, len(LANGUAGES))
        for _ in range(epochs):
            for k in range(0, len(chosen), batch):
                rows = chosen[k : k + batch]
                number, start, (letters, _, _) = features([texts[i] for i in rows])
                owner = np.repeat(np.arange(len(rows)), np.diff(np.append(start, len(number))))
                pairs = np.concatenate([owner * (WIDTH + 1) + number[:, 0], owner * (WIDTH + 1) + number[:, 1]])
                pairs, count = np.unique(pairs[pairs % (WIDTH + 1) < WIDTH], return_counts=True)
                own, feature = pairs // (WIDTH + 1), pairs % (WIDTH + 1)
                model.step(own, feature, SCALE * idf[feature] * count / np.maximum(letters[own], 1), targets[rows])
        w = np.zeros((WIDTH + 1, len(LANGUAGES)), np.float32)
        w[:WIDTH] = model.weights() * idf[:WIDTH, None] * SCALE
        return w

    w = train(learned)
    if not len(held):
        return w
    said = scores([texts[i] for i in learned], w)[0].argmax(1)
    agreed = learned[said == targets[learned]]
    if len(agreed) > len(learned) // 2:
        w = train(agreed)
    # Wrong labels would pass for doubt: the temperature is fitted on held-out segments whose label the model finds at all likely.
    x, t = scores([texts[i] for i in held], w)[0].astype(float), targets[held]
    likely = _softmax(x * 4)[np.arange(len(t)), t] > 1e-3
    x, t = x[likely], t[likely]
    grid = np.exp(np.linspace(math.log(0.2), math.log(50), 60))
    losses = [-np.log(_softmax(x * g)[np.arange(len(t)), t] + 1e-12).mean() if len(t) else 0.0 for g in grid]
    return (w * grid[int(np.argmin(losses))]).astype(np.float32)


def _labelled_segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(t, k) for text, k in zip(batch["text"], batch["label"]) for t in segments(text) if len(t) >= 20]
        yield pd.DataFrame(rows, columns=["text", "label"])


def train_on(records: DataFrame, idf: np.ndarray, n: int, sample: int = SAMPLE, most: int = SEGMENTS) -> np.ndarray:
    """Fit on segments of ``sample`` distinct labelled texts or some more of those of ``n`` records, drawn by a hash of the text; of up to ``most`` segments, drawn by another.

    Both are drawn by a share of the hash's range, the texts are cut where they lie, and copies of a text count once: a task sends only segments of the sample, and
    a text that many records share takes no other's place.
    """
    known = records.filter(F.col("label").isNotNull() & F.col("text").isNotNull())
    part = lambda share: F.lit(max(1, int((1 << 30) * min(1.0, share))))
    within = lambda hashed, share: F.pmod(hashed, F.lit(1 << 30)) < part(share)
    share = 1.25 * sample / max(n, 1)
    while True:
        drawn = materialize(known.filter(within(F.xxhash64("text"), share)).select("text", "label").distinct())
        found = drawn.count()
        if found >= sample or share >= 1:
            break
        share *= max(1.5, 1.25 * sample / max(found, 1))  # many records share their texts, or have no label
    cut = materialize(drawn.mapInPandas(_labelled_segments, "text string, label string").distinct())
    rows = cut.filter(within(F.xxhash64("text", "label"), 1.1 * most / max(cut.count(), 1))).orderBy(F.xxhash64("text", "label"), "text", "label").limit(most).collect()
    return fit([r[0] for r in rows], np.array([LANGUAGES.index(r[1]) for r in rows], np.int64), idf)


def _path(p: np.ndarray) -> np.ndarray:
    """The most probable sequence of classes for rows of log-probabilities, in which each change costs ``CHANGE``."""
    best, back = p[0].copy(), np.zeros(p.shape, np.int64)
    for k in range(1, len(p)):
        switch = best.max() - CHANGE
        back[k] = np.where(best >= switch, np.arange(p.shape[1]), best.argmax())
        best = np.maximum(best, switch) + p[k]
    out = [int(best.argmax())]
    for k in range(len(p) - 1, 0, -1):
        out.append(int(back[k, out[-1]]))
    return np.array(out[::-1])


def _recognise(weights: Column | np.ndarray, details: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = weights.value
        for batch in batches:
            for at in range(0, len(batch), 2000):
                yield one(batch.iloc[at : at + 2000], w)

    def one(batch: pd.DataFrame, w: np.ndarray) -> pd.DataFrame:
        texts, owner = [], []
        for k, t in enumerate(batch["body"]):
            if t:
                own = segments(t)
                texts += own
                owner += [k] * len(own)
        kind, key, known = batch["record_kind"].to_numpy(), batch["record_id"].to_numpy(), batch["label"].to_numpy()
        rows = []
        if texts:
            x, letters, vowels = scores(texts, w)
            # Words of a language have vowels, unlike codes and soups of consonants; and rows of numbers with a name in them are no words.
            size = np.array([len(t) - t.count(" ") for t in texts])
            fit_ = (letters >= LEAST_LETTERS) & (vowels * 5 >= letters) & (letters * 2 >= size)
            owner = np.array(owner)
            kept = np.flatnonzero(fit_)
            if len(kept):
                p, own = np.log(_softmax(x[kept].astype(float)) + 1e-9), owner[kept]
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                best = p.argmax(1)
                low, high = np.minimum.reduceat(best, first), np.maximum.reduceat(best, first)
                for f, end, uniform in zip(first.tolist(), [*first[1:].tolist(), len(own)], (low == high).tolist()):
                    path = best[f:end] if uniform else _path(p[f:end])
                    mine = p[f:end]
                    size = letters[kept[f:end]]
                    found = []
                    for c in dict.fromkeys(path.tolist()):
                        held = path == c
                        sure = float((np.exp(mine[held, c]) * size[held]).sum() / size[held].sum())
                        found.append((c, sure, int(size[held].sum())))
                    k = own[f]
                    if details:
                        rows += [(kind[k], key[k], known[k], n, texts[i], LANGUAGES[c], min(1.0, float(math.exp(q)))) for n, (i, c, q) in enumerate(zip(kept[f:end].tolist(), path.tolist(), mine[np.arange(len(path)), path].tolist()), 1)]
                    else:
                        rows += [(kind[k], key[k], known[k], LANGUAGES[c], sure, size) for c, sure, size in found if sure >= SURE]
        return pd.DataFrame(rows, columns=SEGMENT_COLUMNS if details else COLUMNS)

    return run


COLUMNS = ["record_kind", "record_id", "label", "language", "confidence", "letters"]
SEGMENT_COLUMNS = ["record_kind", "record_id", "label", "segment", "segment_text", "language", "confidence"]


def records(documents: DataFrame, workbook: DataFrame) -> DataFrame:
    """``record_kind, record_id, label, text, body`` of both tables; redelivered workbook rows count once, where they are alike."""
    own = without_notices(documents, ["doc_id", "lang", "text"]).select(F.lit("document").alias("record_kind"), F.col("doc_id").alias("record_id"), label(F.col("lang")).alias("label"), "text", "body")
    rows = workbook.select("row_id", "source_language", "original_text").distinct()
    other = rows.select(F.lit("workbook_row").alias("record_kind"), F.col("row_id").alias("record_id"), label(F.col("source_language")).alias("label"), F.col("original_text").alias("text"), F.col("original_text").alias("body"))
    return own.unionByName(other)


def recognised(documents: DataFrame, workbook: DataFrame, details: bool = False) -> DataFrame:
    """``record_kind, record_id, label, language, confidence, letters``: a row for each language of each record. With ``details``, a row for each segment instead."""
    raw = documents.select(label(F.col("lang")).alias("label"), "text").unionByName(workbook.select(label(F.col("source_language")).alias("label"), F.col("original_text").alias("text")))
    idf, n = inverse_frequencies(raw)
    weights = documents.sparkSession.sparkContext.broadcast(train_on(raw, idf, n))
    schema = "record_kind string, record_id long, label string, " + ("segment int, segment_text string, language string, confidence double" if details else "language string, confidence double, letters long")
    return records(documents, workbook).select("record_kind", "record_id", "label", "body").mapInPandas(_recognise(weights, details), schema)


def mislabelled(languages: DataFrame) -> DataFrame:
    """``record_kind, record_id, language``: records whose label is missing or names none of their languages, or that mix languages; a row per language."""
    counts = (F.col("confidence") >= CONTRADICTS) | (F.col("language") == F.col("label")) | (F.col("label").isNull() & (F.col("rank") == 1))
    first = Window.partitionBy("record_kind", "record_id").orderBy(F.desc("letters"), "language")
    per = languages.withColumn("rank", F.row_number().over(first)).filter(counts).groupBy("record_kind", "record_id", "label").agg(F.collect_set("language").alias("found"))
    wrong = F.col("label").isNull() | (F.size("found") > 1) | ~F.array_contains("found", F.col("label"))
    return per.filter(wrong).select("record_kind", "record_id", F.explode("found").alias("language")).distinct()
