"""Mixing sources to target shares by balanced sampling (the cube method).

A source of size S with a target of T bytes is taken r = T / S times: every document floor(r) times, and once more with probability
r - floor(r). Which ones is drawn by the cube method: in the flight phase the vector of inclusion probabilities
moves at random along directions that keep both balancing totals (documents and bytes) until its coordinates are 0 or 1; no more
than ``LEFT`` documents of a block stay fractional. Large documents fly first, those far above the mean against all others at once and the rest in threes, so that what stays
fractional are small ones. Those of all blocks fly on together, until a source has at most ``LEFT``: the small landing problem, whose solution is the subset that comes nearest to
what is left of the byte total, and then of the document total. All documents but those keep their inclusion probability.

A document above one part in ``COARSE`` of the bytes to be drawn from its source would miss the target by itself, whether it is drawn or not. Such documents are left out of the draw
where the others hold enough bytes, which are drawn with a chance that is as much higher.

Where r exceeds the repeat cap every document is taken as often as the cap allows, and the report shows the share that is missed: a source is ``short`` if
what was chosen are all repeats that the cap allows, and less than the target.

Sizes are UTF-8 bytes; a null text counts 0. Documents with null sources are in no mix. Repeated rows of one ``doc_id`` and source are one document.
A source without documents, or with empty ones alone, reaches nothing.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.session import materialize

#: Documents that fly together.
BLOCK = 20_000
NEAR = 1e-9
#: Documents above this many times the mean size fly against all others, as three alone could hardly move them.
LARGE = 4.0
COARSE = 20
#: Fractional documents that flight leaves to landing.
LEFT = 12


def _against_all(p: list[float], size: list[float], i: int, rng: random.Random) -> None:
    """Move entry ``i`` until it is settled, against all other open entries by a share that is linear in their sizes, so that both totals are kept."""
    own, chance = np.array(size), np.array(p)
    while NEAR < chance[i] < 1 - NEAR:
        open_ = np.flatnonzero((chance > NEAR) & (chance < 1 - NEAR))
        open_ = open_[open_ != i]
        z = own[open_]
        n, once, twice = len(z), z.sum(), (z * z).sum()
        spread = n * twice - once * once
        if n < 8 or spread <= NEAR * n * twice:
            break
        way = np.append(-((twice - once * own[i]) + (n * own[i] - once) * z) / spread, 1.0)
        at, moves = np.append(open_, i), np.abs(way) > 0
        at, way = at[moves], way[moves]
        x = chance[at]
        up, down = np.where(way > 0, (1 - x) / way, x / -way).min(), np.where(way > 0, x / way, (1 - x) / -way).min()
        x = x + (up if rng.random() * (up + down) < down else -down) * way
        chance[at] = np.where(x < NEAR, 0.0, np.where(x > 1 - NEAR, 1.0, x))
    p[:] = chance.tolist()


def flight(chance: list[float], size: list[float], rng: random.Random, left: int = 2) -> list[float]:
    """Move ``chance`` until at most ``left`` (two or more) entries lie strictly between 0 and 1, keeping sum(chance) and sum(chance * size)."""
    p = list(chance)
    open_ = lambda: [i for i, x in enumerate(p) if NEAR < x < 1 - NEAR]
    waiting = sorted(open_(), key=lambda i: -size[i])
    mean = sum(size[i] for i in waiting) / max(1, len(waiting))
    for i in waiting:
        if size[i] <= LARGE * mean:
            break
        _against_all(p, size, i, rng)
    waiting = [i for i in waiting if NEAR < p[i] < 1 - NEAR]
    waiting.reverse()
    live: list[int] = []
    while len(live) + len(waiting) > left:
        while len(live) < 3 and waiting:
            live.append(waiting.pop())
        a, b, c = (size[i] for i in live)
        way = (c - b, a - c, b - a)
        if way == (0, 0, 0):
            way = (1.0, -1.0, 0.0)
        _move(p, live, way, rng)
        live = [i for i in live if NEAR < p[i] < 1 - NEAR]
    return p


def landing(p: list[float], size: list[float]) -> list[float]:
    """Settle the few entries that flight left by the subset whose bytes, and then whose number, are nearest to the sums of what is left."""
    live = [i for i, x in enumerate(p) if NEAR < x < 1 - NEAR]
    if not live:
        return p
    subsets = (np.arange(1 << len(live))[:, None] >> np.arange(len(live))) & 1
    z, x = np.array([size[i] for i in live]), np.array([p[i] for i in live])
    bytes_off, number_off = np.abs(subsets @ z - x @ z), np.abs(subsets.sum(1) - x.sum())
    best = subsets[np.lexsort((number_off, np.round(bytes_off, 6)))[0]]
    for i, taken in zip(live, best):
        p[i] = float(taken)
    return p


def _move(p: list[float], live: list[int], way: tuple, rng: random.Random) -> None:
    up = min((1 - p[i]) / u if u > 0 else p[i] / -u for i, u in zip(live, way) if u)
    down = min(p[i] / u if u > 0 else (1 - p[i]) / -u for i, u in zip(live, way) if u)
    step = up if rng.random() * (up + down) < down else -down
    for i, u in zip(live, way):
        x = p[i] + step * u
        p[i] = 0.0 if x < NEAR else 1.0 if x > 1 - NEAR else x


def _fly(land: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id", kind="stable")
        rng = random.Random("/".join(map(str, key)))
        order = list(range(len(rows)))
        rng.shuffle(order)
        rows = rows.iloc[order]
        size = rows["bytes"].astype(float).tolist()
        p = flight(rows["chance"].tolist(), size, rng, LEFT)
        return rows.assign(chance=landing(p, size) if land else p)[["mix_id", "source", "doc_id", "bytes", "base", "chance"]]

    return run


SCHEMA = "mix_id int, source string, doc_id long, bytes long, base long, chance double"


def plan(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per mix and source: its size, target and cap, and how often it is taken."""
    sizes = documents.filter("source IS NOT NULL").groupBy("source", "doc_id").agg(F.coalesce(F.max(F.octet_length("text")), F.lit(0)).cast("long").alias("b")).groupBy("source").agg(F.sum("b").alias("source_bytes"), F.count("*").alias("source_documents"))
    rows = targets.filter("source IS NOT NULL").distinct().join(sizes, "source", "left").fillna(0, ["source_bytes", "source_documents"])
    mixes = rows.groupBy("mix_id").agg((F.max("budget_fraction") * F.sum("source_bytes")).alias("budget"))
    rate = F.when(F.col("source_bytes") > 0, F.col("target_bytes") / F.col("source_bytes")).otherwise(0.0)
    return (
        rows.join(mixes, "mix_id")
        .withColumn("target_bytes", F.col("target_share") * F.col("budget"))
        .withColumn("rate", F.least(rate, F.col("repeat_cap").cast("double")))
    )


def mix(documents: DataFrame, targets: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Chosen documents ``mix_id, source, doc_id, bytes, repeats`` and the report: the plan with the documents, bytes and shares reached.

    ``targets`` has a row per mix and source (some dozens). Blocks are dealt by a hash, so one source may hold any part of all rows.
    """
    planned = materialize(plan(documents, targets))
    sized = documents.filter("source IS NOT NULL").groupBy("source", "doc_id").agg(F.coalesce(F.max(F.octet_length("text")), F.lit(0)).cast("long").alias("bytes"))
    whole = F.floor(F.col("rate")).cast("long")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("source_documents") / F.lit(block)))
    drawn_bytes = (F.col("rate") - whole) * F.col("source_bytes")
    rated = sized.join(planned.select("mix_id", "source", "rate", "source_documents", drawn_bytes.alias("drawn")), "source")
    fine = F.col("bytes") * COARSE <= F.col("drawn")
    held = rated.groupBy("mix_id", "source").agg(F.coalesce(F.sum(F.when(fine, F.col("bytes"))), F.lit(0)).alias("fine_bytes"))
    chance = F.when(F.col("fine_bytes") < F.col("drawn"), F.col("rate") - whole).when(fine, F.least(F.lit(1.0), F.coalesce(F.try_divide("drawn", "fine_bytes"), F.lit(0.0)))).otherwise(0.0)
    each = rated.join(materialize(held), ["mix_id", "source"]).select("mix_id", "source", "doc_id", "bytes", whole.alias("base"), F.coalesce(chance, F.lit(0.0)).alias("chance"), F.pmod(F.xxhash64("doc_id"), blocks).alias("block"))
    settled = each.filter((F.col("chance") <= NEAR) | (F.col("chance") >= 1 - NEAR)).select(*SCHEMA_COLUMNS)
    flown = materialize(each.filter((F.col("chance") > NEAR) & (F.col("chance") < 1 - NEAR)).groupBy("mix_id", "source", "block").applyInPandas(_fly(False), SCHEMA))
    done = [flown.filter((F.col("chance") <= 0) | (F.col("chance") >= 1)), settled]
    left = flown.filter("chance > 0 AND chance < 1")
    most = planned.agg(F.max(F.ceil(F.col("source_documents") / F.lit(block)))).first()[0] or 1
    level = 0
    while LEFT * most > max(block, 4 * LEFT):  # still too many for one group: fly in blocks again
        level += 1
        most = -(-LEFT * most // max(block, 4 * LEFT))
        flown = materialize(left.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(level)), F.lit(most))).groupBy("mix_id", "source", "block").applyInPandas(_fly(False), SCHEMA))
        done.append(flown.filter((F.col("chance") <= 0) | (F.col("chance") >= 1)))
        left = flown.filter("chance > 0 AND chance < 1")
    done.append(left.groupBy("mix_id", "source").applyInPandas(_fly(True), SCHEMA))
    drawn = done[0]
    for part in done[1:]:
        drawn = drawn.unionByName(part)
    chosen = drawn.select("mix_id", "source", "doc_id", "bytes", (F.col("base") + F.round("chance")).cast("long").alias("repeats")).filter("repeats > 0")
    reached = chosen.groupBy("mix_id", "source").agg(F.count("*").alias("documents"), F.sum(F.col("bytes") * F.col("repeats")).alias("reached_bytes"), F.max("repeats").alias("most_repeats"))
    report = planned.join(reached, ["mix_id", "source"], "left").fillna(0, ["documents", "reached_bytes", "most_repeats"])
    report = report.withColumn("short", (F.col("reached_bytes") == F.col("repeat_cap") * F.col("source_bytes")) & (F.col("reached_bytes") < F.col("target_bytes")))
    totals = report.groupBy("mix_id").agg(F.sum("reached_bytes").alias("mix_bytes"))
    return chosen, report.join(totals, "mix_id").withColumn("reached_share", F.when(F.col("mix_bytes") > 0, F.col("reached_bytes") / F.col("mix_bytes")))


SCHEMA_COLUMNS = ["mix_id", "source", "doc_id", "bytes", "base", "chance"]
