"""Groups of texts whose word sets overlap by a given share, found exactly by the general pigeonhole principle.

A set of words is a bit vector over the vocabulary. With sizes a and b, a Jaccard similarity of at least 4/5 is the same as a Hamming
distance of at most (a + b) / 9, in whole numbers, so no similarity is estimated. The bits are dealt into m partitions. If
thresholds t_i >= -1 have sum(t_i + 1) > d, two vectors at distance d or less differ by at most t_i bits in some partition i (-1: it
is not looked at). Each probe chooses its own unequal thresholds by dynamic programming on estimated candidate counts, so that crowded
partitions (those of common words) are skipped and the others may differ by one bit.

* Correlated words share a partition: words are put in an order in which each follows those it occurs with, and a partition is a
  stretch of that order that holds its share of the bits' entropy. The order is fitted on a bounded sample (``SAMPLE`` sets); it affects speed, never the result.
* Word frequencies are counted over all sets. Only words in more than one set in ``COMMON`` are listed one by one, which is no more than
  ``COMMON`` times the mean set size; rarer words get places by their hash.
* Sets are indexed in size classes a quarter apart; a probe looks into its own class and the one below, for sets no larger than itself.
* Index and probe carry the parity of each of 64 groups of bits: sets differ in at least as many bits as in parities, so most candidates end in the
  join that makes them. Every other one is verified on the words themselves.

Equal sets are one class throughout. Their members are listed beside it and are paired only where pairs of records are asked for (``record_pairs``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.session import join_hot, materialize

LEAST_WORDS = 25
SAMPLE = 4000
COMMON = 500
#: Words that are ordered by correlation; further common words get places by their hash.
ORDERED = 2048
#: Classes of more records than this are cut into slices of about so many, so that no key of a join in ``record_pairs`` gives a square of a whole class.
SLICE = 1000
#: The similarity is SAME / ALL of the words in either text.
SAME, ALL = 4, 5
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_classes(records: DataFrame, key: str, text: str, least: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """``class_id, set_key, words, size, copies`` of the distinct word sets, and the members ``key, set_key``.

    Words are distinct whitespace-separated tokens in lower case. Records with fewer than ``least`` words, null texts among them, are in no class.
    Repeated rows of a key with the same text count once. ``class_id`` is the least key of the class.
    """
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower(text), r"[\s\p{Z}\x1c-\x1f\x85]+"), lambda w: w != "")))
    sets = records.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("record"), words.alias("words")).filter(F.size("words") >= least)
    sets = materialize(sets.withColumn("set_key", F.md5(F.array_join("words", " "))).distinct())
    classes = sets.groupBy("set_key").agg(F.min("record").alias("class_id"), F.first("words").alias("words"), F.count("*").alias("copies"))
    return materialize(classes.select("class_id", "set_key", "words", F.size("words").alias("size"), "copies")), sets.select("record", "set_key")


def size_classes(least: int, most: int) -> list[int]:
    """Lower ends of the size classes: each is a quarter above the one before."""
    ends = [max(1, least)]
    while ends[-1] <= most:
        ends.append(max(ends[-1] + 1, -(-ends[-1] * ALL // SAME)))
    return ends


def partitions_of(most: int) -> int:
    """The number of partitions for sets of up to ``most`` words: enough units with thresholds of 1 in all but one."""
    distance = (most + most * ALL // SAME) // (SAME + ALL)
    return -(-(distance + 1) // 2) + 1


def correlated_order(rows: list[list[int]], words: np.ndarray) -> np.ndarray:
    """An order of ``words`` (indices) in which each follows the words it occurs with most, from a sample of sets."""
    if len(words) < 3:
        return np.arange(len(words))
    seen = np.zeros((len(rows), len(words)), np.float32)
    for k, row in enumerate(rows):
        at = np.searchsorted(words, np.array(row, np.int64))
        at = at[(at < len(words))]
        seen[k, at] = 1
    seen -= seen.mean(0)
    spread = np.sqrt((seen**2).sum(0))
    near = (seen.T @ seen) / np.maximum(np.outer(spread, spread), 1e-9)
    order, left = [int(np.argmax(spread))], np.ones(len(words), bool)
    left[order[0]] = False
    pull = near[order[0]].copy()
    for _ in range(len(words) - 1):
        best = int(np.argmax(np.where(left, pull, -np.inf)))
        order.append(best)
        left[best] = False
        pull = pull * 0.7 + near[best]
    return np.array(order)


class Layout:
    """Where each word's bit lies, and what is known of its frequency."""

    def __init__(self, words: np.ndarray, share: np.ndarray, place: np.ndarray, sets: int, rare: float, ends: list[int]) -> None:
        self.words, self.share, self.place, self.sets, self.rare, self.ends = words, share, place, sets, rare, ends

    @staticmethod
    def fit(classes: DataFrame, least: int) -> Layout:
        hashed = classes.select("class_id", F.transform("words", lambda w: F.xxhash64(w)).alias("bits"))
        n, total, most = classes.agg(F.count("*"), F.sum("size"), F.max("size")).first()
        if not n:
            return Layout(np.array([], np.int64), np.array([]), np.array([]), 0, 0.0, [least])
        counts = hashed.select(F.explode("bits").alias("bit")).groupBy("bit").agg(F.count("*").alias("n")).filter(F.col("n") * COMMON >= n)
        common = sorted((r[0], r[1]) for r in counts.collect())
        words = np.array([w for w, _ in common], np.int64)
        share = np.array([c / n for _, c in common], float).clip(1e-9, 1 - 1e-3)
        top = np.sort(np.argsort(-share, kind="stable")[:ORDERED])
        known = F.array(*[F.lit(int(w)) for w in words[top]]) if len(top) else F.array().cast("array<bigint>")
        # Drawn by a share of the hash's range, so that tasks send only sets of the sample, whatever their number.
        drawn = hashed.filter(F.pmod(F.xxhash64("class_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, 1.1 * SAMPLE / n) * (1 << 30))))
        sample = [r[0] for r in drawn.select("class_id", F.array_intersect("bits", known).alias("bits")).orderBy(F.xxhash64("class_id"), "class_id").limit(SAMPLE).select("bits").collect()]
        order = top[correlated_order(sample, words[top])] if len(top) else np.array([], int)
        place = _by_hash(words)
        mass = -share[order] * np.log(share[order]) - (1 - share[order]) * np.log1p(-share[order])
        place[order] = (np.cumsum(mass) - mass / 2) / max(mass.sum(), 1e-9)
        return Layout(words, share, place.clip(0, 1 - 1e-9), n, max(0.0, total / n - share.sum()), size_classes(least, most))


def _by_hash(bits: np.ndarray) -> np.ndarray:
    return (_scramble(bits.astype(np.uint64)) >> np.uint64(11)).astype(float) / float(1 << 53)


def _scramble(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * _MIX
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def allocate(cost: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Thresholds (-1, 0 or 1) of least total cost with sum(t + 1) >= units, for each row of ``cost`` (rows, partitions, 3)."""
    rows, m, _ = cost.shape
    top = int(units.max())
    best = np.full((rows, top + 1), np.inf)
    best[:, 0] = 0
    took = np.zeros((m, rows, top + 1), np.int8)
    for i in range(m):
        options = np.full((3, rows, top + 1), np.inf)
        for t in range(min(3, top + 1)):
            options[t, :, t:] = best[:, : top + 1 - t] + cost[:, i, t, None]
        took[i] = options.argmin(0)
        best = options.min(0)
    # More units than needed never cost less, as a lower threshold has fewer candidates.
    at = units.copy()
    out = np.zeros((rows, m), np.int8)
    for i in reversed(range(m)):
        t = took[i, np.arange(rows), at]
        out[:, i] = t - 1
        at = at - t
    return out


def _tag(scheme: int, part: np.ndarray, kind: int) -> np.ndarray:
    return _scramble((np.uint64(scheme) << np.uint64(40)) + (part.astype(np.uint64) << np.uint64(8)) + np.uint64(kind))


def _signatures(layout: Layout, probe: bool):
    """Rows (sig, class_id, size, parity): what a set leaves in the index, or what it looks for there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends = np.array(layout.ends)
        odds = np.log(layout.share) - np.log1p(-layout.share)
        rare_odds = np.log(1 / (2 * COMMON))
        for batch in batches:
            ids, size = batch["class_id"].to_numpy(), batch["size"].to_numpy()
            bits = np.concatenate([np.asarray(b, np.int64) for b in batch["bits"]]) if len(batch) else np.array([], np.int64)
            owner = np.repeat(np.arange(len(batch)), size)
            at = np.searchsorted(layout.words, bits).clip(0, max(0, len(layout.words) - 1))
            known = layout.words[at] == bits if len(layout.words) else np.zeros(len(bits), bool)
            place = np.where(known, layout.place[at] if len(layout.words) else 0.0, _by_hash(bits))
            odd = np.where(known, odds[at] if len(layout.words) else 0.0, rare_odds)
            weight = _scramble(bits.astype(np.uint64))
            parity = np.zeros(len(batch), np.uint64)
            np.bitwise_xor.at(parity, owner, np.uint64(1) << (weight >> np.uint64(58)))
            own = np.searchsorted(ends, size, side="right") - 1
            for scheme in np.unique(np.concatenate([own, own - 1]) if probe else own):
                if scheme < 0:
                    continue
                low, high = int(ends[scheme]), int(ends[scheme + 1]) - 1
                chosen = np.flatnonzero((own == scheme) | (probe & (own == scheme + 1) & (-(-SAME * size // ALL) <= high)))
                if not len(chosen):
                    continue
                m = partitions_of(high)
                step = max(1, int(4_000_000 // (m * (high // 4 + 8))))
                for start in range(0, len(chosen), step):
                    yield from self_rows(layout, chosen[start : start + step], scheme, m, low, high, ids, size, owner, place, odd, weight, parity, probe)

    def self_rows(layout, rows, scheme, m, low, high, ids, size, owner, place, odd, weight, parity, probe):
        back = np.full(len(ids), -1)
        back[rows] = np.arange(len(rows))
        mine = back[owner] >= 0
        row, part = back[owner[mine]], np.minimum((place[mine] * m).astype(np.int64), m - 1)
        w, o = weight[mine], odd[mine]
        cell = row * m + part
        total = np.zeros(len(rows) * m, np.uint64)
        with np.errstate(over="ignore"):
            np.add.at(total, cell, w)
            less = total[cell] - w
        total = total.reshape(len(rows), m)
        parts = np.broadcast_to(np.arange(m), total.shape)

        def out(sig: np.ndarray, who: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"sig": sig.astype(np.int64), "class_id": ids[rows[who]], "size": size[rows[who]].astype(np.int32), "parity": parity[rows[who]].astype(np.int64)})

        whole = lambda kind, keep: out(_scramble(total[keep] ^ _tag(scheme, parts[keep], kind)), np.broadcast_to(np.arange(len(rows))[:, None], total.shape)[keep])
        lacking = lambda kind, keep: out(_scramble(less[keep] ^ _tag(scheme, part[keep], kind)), row[keep])
        if not probe:
            yield whole(0, np.ones(total.shape, bool))
            yield lacking(1, np.ones(len(row), bool))
            return
        # Expected candidates: all sets, times the chance of just these bits in the partition.
        bound = np.minimum((layout.place * m).astype(np.int64), m - 1)
        none = np.bincount(bound, np.log1p(-layout.share), m) - layout.rare / m
        more = np.bincount(bound, layout.share / (1 - layout.share), m) + layout.rare / m
        here = np.bincount(cell, o, len(rows) * m).reshape(len(rows), m)
        undo = np.bincount(cell, np.exp(-o), len(rows) * m).reshape(len(rows), m)
        zero = np.exp(np.minimum(np.log(max(layout.sets, 1)) + here + none, 40))
        one = zero * (1 + undo + more)
        cost = np.stack([np.zeros_like(zero), zero + 1, one + 3 + np.bincount(cell, minlength=len(rows) * m).reshape(len(rows), m)], 2)
        distance = (size[rows] + np.minimum(size[rows], high)) // (SAME + ALL)
        t = allocate(cost, distance + 1)
        yield whole(0, t >= 0)
        yield whole(1, t == 1)
        yield lacking(0, t[row, part] == 1)

    return run


SIGNATURE = "sig long, class_id long, size int, parity long"


def similar_classes(classes: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """``class_a, class_b, both, either``: all pairs of different word sets with at least SAME / ALL of their words in both, class_a < class_b."""
    layout = Layout.fit(classes, least)
    bits = classes.select("class_id", "size", F.transform("words", lambda w: F.xxhash64(w)).alias("bits"))
    index = bits.mapInPandas(_signatures(layout, False), SIGNATURE)
    probes = bits.mapInPandas(_signatures(layout, True), SIGNATURE).select("sig", F.col("class_id").alias("probe"), F.col("size").alias("probe_size"), F.col("parity").alias("probe_parity"))
    fits = (F.col("class_id") != F.col("probe")) & (F.col("size") <= F.col("probe_size")) & (F.col("size") * ALL >= F.col("probe_size") * SAME)
    fits &= F.bit_count(F.col("parity").bitwiseXOR(F.col("probe_parity"))) * (SAME + ALL) <= F.col("size") + F.col("probe_size")
    pairs = probes.join(index, "sig").filter(fits).select(F.least("class_id", "probe").alias("class_a"), F.greatest("class_id", "probe").alias("class_b")).distinct()
    sets = classes.select("class_id", "words")
    both = F.size(F.array_intersect("words_a", "words_b"))
    checked = (
        pairs.join(sets.select(F.col("class_id").alias("class_a"), F.col("words").alias("words_a")), "class_a")
        .join(sets.select(F.col("class_id").alias("class_b"), F.col("words").alias("words_b")), "class_b")
        .select("class_a", "class_b", both.alias("both"), (F.size("words_a") + F.size("words_b")).alias("_all"))
    )
    return checked.withColumn("either", F.col("_all") - F.col("both")).filter(F.col("both") * ALL >= F.col("either") * SAME).drop("_all")


def record_pairs(classes: DataFrame, members: DataFrame, linked: DataFrame, expanded: int | None = None, per_slice: int = SLICE) -> DataFrame:
    """``record_a, record_b``: all pairs of records whose word sets are equal or in linked classes, the smaller first.

    A class of n records gives n (n - 1) / 2 pairs, whatever n is; classes of more than ``per_slice`` records are joined slice by slice. Only if ``expanded`` is given does a
    larger class stand for its representative, to which each of its members is tied by one pair: that is enough for components, but it is not all pairs.
    """
    known = classes.select("set_key", "class_id", "copies")
    placed = join_hot(members, known.withColumn("_n", F.col("copies")), "set_key", "_n", "inner").select("record", "class_id", "copies")
    whole = F.lit(True) if expanded is None else F.col("copies") <= expanded
    slices = F.when(whole, F.ceil(F.col("copies") / per_slice)).otherwise(1).cast("int")
    stands = placed.filter(whole | (F.col("record") == F.col("class_id"))).withColumn("whole", whole & (F.col("copies") > 1))
    stands = materialize(stands.withColumn("slices", slices).withColumn("slice", F.pmod(F.xxhash64("record"), F.col("slices")).cast("int")))
    every = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    if classes.filter(F.col("copies") > per_slice).isEmpty():
        a, b = (stands.select(F.col("record").alias(f"record_{x}"), F.col("class_id").alias(f"class_{x}")) for x in "ab")
        between = linked.join(a, "class_a").join(b, "class_b")
    else:
        between = linked.select("class_a", "class_b")
        for x in "ab":
            cut = classes.withColumn("slices", slices).select(F.col("class_id").alias(f"class_{x}"), "slices")
            between = between.join(cut, f"class_{x}").withColumn(f"slice_{x}", every).drop("slices")
        for x in "ab":
            side = stands.select(F.col("record").alias(f"record_{x}"), F.col("class_id").alias(f"class_{x}"), F.col("slice").alias(f"slice_{x}"))
            between = between.join(side, [f"class_{x}", f"slice_{x}"])
    few = stands.filter("whole")
    left = few.select(F.col("record").alias("record_a"), "class_id", every.alias("slice"))
    within = left.join(few.select(F.col("record").alias("record_b"), "class_id", "slice"), ["class_id", "slice"]).filter("record_a < record_b")
    found = between.select("record_a", "record_b").unionByName(within.select("record_a", "record_b"))
    if expanded is not None:
        found = found.unionByName(placed.filter(~whole & (F.col("record") != F.col("class_id"))).select(F.col("class_id").alias("record_a"), F.col("record").alias("record_b")))
    found = found.filter("record_a <> record_b")
    return found.select(F.least("record_a", "record_b").alias("record_a"), F.greatest("record_a", "record_b").alias("record_b")).distinct()


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node, component``: connected components by the least node; labels travel over links and then jump along themselves.

    ``nodes`` has ``node``, ``links`` has ``a, b``. Each round is two joins over written tables; the rounds grow with the logarithm of the longest chain.
    """
    ways = materialize(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = materialize(nodes.select("node", F.col("node").alias("component")))
    while True:
        near = ways.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_near"))
        step = labels.join(near, "node", "left").select("node", F.col("component").alias("_old"), F.least("component", F.coalesce("_near", "component")).alias("component"))
        jump = step.select(F.col("node").alias("_at"), F.col("component").alias("_root"))
        labels_new = materialize(step.join(jump, step["component"] == jump["_at"], "left").select("node", "_old", F.least("component", F.coalesce("_root", "component")).alias("component")))
        labels = labels_new.select("node", "component")
        if labels_new.filter("component <> _old").isEmpty():
            return labels


def groups(records: DataFrame, key: str, text: str, least: int = LEAST_WORDS) -> DataFrame:
    """``record, class_id, group_id, copies, links``: one row per record with at least ``least`` words, its class of equal texts, its group of similar
    ones, and the number of other classes it is linked with."""
    classes, members = word_classes(records, key, text, least)
    linked = materialize(similar_classes(classes, least))
    labels = components(classes.select(F.col("class_id").alias("node")), linked.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")))
    links = linked.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    known = classes.join(labels.select(F.col("node").alias("class_id"), F.col("component").alias("group_id")), "class_id").join(links, "class_id", "left")
    rows = known.select("set_key", "class_id", "group_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.col("copies").alias("_n"))
    return join_hot(members, rows, "set_key", "_n", "inner").select("record", "class_id", "group_id", "copies", "links")
