"""Filling containers of fixed capacity by a grouping genetic algorithm.

A chromosome is a list of containers, so crossover works on whole groups: the child takes well-filled containers of one parent, drops
the other parent's containers that hold any of the same documents, and the documents displaced by that go back by best fit, largest
first. The documents are dealt into blocks of bounded size by a hash; several islands evolve each block with seeds of their
own, and between epochs each island's elite migrates to the next island. Only elites travel, as rows of one written table.

Sizes are UTF-8 bytes; a null text counts 0. Only a document above the capacity is split: into full containers and one rest,
which is packed like a document. Repeated rows of one ``doc_id`` are one document of the largest size. Documents without bytes
lie in some container too.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.session import materialize

#: Documents of a block; an island's memory and time depend on it alone.
BLOCK = 1500
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 10
POPULATION = 6

Chromosome = list[list[int]]


def _best_fit(groups: Chromosome, loose: list[int], size: list[int], capacity: int) -> Chromosome:
    """Put ``loose`` items, in their order, each into the container that it fills most, or a new one."""
    room = sorted((capacity - sum(map(size.__getitem__, g)), k) for k, g in enumerate(groups))
    for item in loose:
        at = bisect_left(room, (size[item], -1))
        if at < len(room):
            left, k = room.pop(at)
            groups[k].append(item)
        else:
            left, k = capacity, len(groups)
            groups.append([item])
        insort(room, (left - size[item], k))
    return groups


def _fitness(groups: Chromosome, size: list[int], capacity: int) -> tuple[int, float]:
    """Fewer containers first, then uneven fill: full containers beside one nearly empty are worth more than all half full."""
    return -len(groups), sum((sum(map(size.__getitem__, g)) / capacity) ** 2 for g in groups)


def _crossover(a: Chromosome, b: Chromosome, size: list[int], capacity: int, rng: random.Random) -> Chromosome:
    ranked = sorted(b, key=lambda g: -sum(map(size.__getitem__, g)))
    well = ranked[: max(1, len(ranked) // 2)]
    first = rng.randrange(len(well))
    taken = well[first : first + 1 + rng.randrange(max(1, len(well) // 2))]
    inside = {i for g in taken for i in g}
    kept, loose = [], []
    for g in a:
        if inside.isdisjoint(g):
            kept.append(list(g))
        else:
            loose += [i for i in g if i not in inside]
    loose.sort(key=lambda i: -size[i])
    return _best_fit([list(g) for g in taken] + kept, loose, size, capacity)


def _mutate(a: Chromosome, size: list[int], capacity: int, rng: random.Random) -> Chromosome:
    """Empty the worst-filled container and some others, and let their documents in again by best fit."""
    ranked = sorted(a, key=lambda g: sum(map(size.__getitem__, g)))
    out = {0} | {rng.randrange(len(ranked)) for _ in range(1 + len(ranked) // 20)}
    loose = [i for k in out for i in ranked[k]]
    rng.shuffle(loose)
    loose.sort(key=lambda i: -size[i] * (0.9 + 0.2 * rng.random()))
    return _best_fit([list(g) for k, g in enumerate(ranked) if k not in out], loose, size, capacity)


def evolve(size: list[int], capacity: int, seeds: list[Chromosome], rng: random.Random, generations: int = GENERATIONS, population: int = POPULATION) -> Chromosome:
    """The best chromosome found for items of ``size``, none above ``capacity``."""
    order = sorted(range(len(size)), key=lambda i: -size[i])
    pool = [[list(g) for g in s] for s in seeds] or [_best_fit([], order, size, capacity)]
    while len(pool) < population:
        mixed = sorted(order, key=lambda i: -size[i] * (0.7 + 0.6 * rng.random()))
        pool.append(_best_fit([], mixed, size, capacity))
    least = -(-sum(size) // capacity)
    scored = sorted(((_fitness(g, size, capacity), k, g) for k, g in enumerate(pool)), reverse=True)
    born = len(pool)
    for _ in range(generations):
        if len(scored[0][2]) <= max(least, 1):
            break
        for _ in range(population // 2):
            a, b = (max(rng.sample(range(len(scored)), 2), key=lambda k: scored[k][0]) for _ in range(2))
            child = _crossover(scored[a][2], scored[b][2], size, capacity, rng) if a != b else _mutate(scored[a][2], size, capacity, rng)
            if rng.random() < 0.3:
                child = _mutate(child, size, capacity, rng)
            scored.append((_fitness(child, size, capacity), born, child))
            born += 1
        scored = sorted(scored, reverse=True)[:population]
    return scored[0][2]


def _island(epoch: int, generations: int, population: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        spec, block, island = (int(k) for k in key)
        rows = rows.sort_values(["origin", "item"], kind="stable")
        own = rows[rows["origin"] == rows["origin"].iloc[0]]
        at = {item: k for k, item in enumerate(own["item"].tolist())}
        size, capacity = own["item_bytes"].tolist(), int(own["capacity"].iloc[0])
        seeds = []
        if epoch:
            for _, elite in rows.groupby("origin", sort=True):
                groups: dict[int, list[int]] = {}
                for item, box in zip(elite["item"].tolist(), elite["box"].tolist()):
                    groups.setdefault(box, []).append(at[item])
                seeds.append(list(groups.values()))
        rng = random.Random(f"{spec}/{block}/{island}/{epoch}")
        best = evolve(size, capacity, seeds, rng, generations, population)
        box = [0] * len(size)
        for k, g in enumerate(best):
            for i in g:
                box[i] = k
        fill = _fitness(best, size, capacity)
        return own.assign(box=box, island=island, boxes=len(best), fitness=fill[1])[COLUMNS]

    return run


COLUMNS = ["spec_id", "block", "island", "item", "item_bytes", "capacity", "box", "boxes", "fitness"]
SCHEMA = "spec_id int, block long, island int, item long, item_bytes long, capacity long, box long, boxes long, fitness double"


def pack(documents: DataFrame, specs: DataFrame, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION) -> DataFrame:
    """``spec_id, container_id, doc_id, piece_number, start_byte, piece_bytes, capacity_tokens`` for every ``pack`` spec.

    Every byte of every document is in exactly one container of each spec, and no container exceeds its capacity. An empty table
    gives no containers. The work is the same for each block, so time grows with the number of documents alone.
    """
    from glyphloom.llm.splitting import _with_specs

    wanted = specs.filter("purpose = 'pack' AND capacity_tokens > 0").select("spec_id", "capacity_tokens").distinct()
    sized = documents.groupBy("doc_id").agg(F.coalesce(F.max(F.octet_length("text")), F.lit(0)).cast("long").alias("bytes"))
    each = _with_specs(sized, wanted).select("spec_id", F.col("capacity_tokens").cast("long").alias("capacity"), "doc_id", "bytes")
    whole = F.floor(F.col("bytes") / F.col("capacity"))
    each = materialize(each.withColumn("full", F.when(F.col("bytes") > F.col("capacity"), whole).otherwise(F.lit(0))).withColumn("rest", F.col("bytes") - F.col("full") * F.col("capacity")))
    full = each.filter("full > 0").select("spec_id", F.posexplode(F.sequence(F.lit(1).cast("long"), F.col("full"))).alias("_k", "piece_number"), "doc_id", "capacity")
    full = full.select(
        "spec_id", F.concat_ws("-", F.lit("full"), "doc_id", "piece_number").alias("container_id"), "doc_id", F.col("piece_number").cast("int").alias("piece_number"), ((F.col("piece_number") - 1) * F.col("capacity")).alias("start_byte"), F.col("capacity").alias("piece_bytes"), F.col("capacity").alias("capacity_tokens")
    )
    loose = each.filter("full = 0 OR rest > 0")
    blocks = {r[0]: max(1, -(-r[1] // block)) for r in loose.groupBy("spec_id").count().collect()}
    if not blocks:
        return full
    count = F.coalesce(*[F.when(F.col("spec_id") == s, F.lit(n)) for s, n in blocks.items()])
    items = loose.select(
        "spec_id", F.pmod(F.xxhash64("doc_id"), count).cast("long").alias("block"), F.col("doc_id").alias("item"), F.col("rest").alias("item_bytes"), "capacity", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.lit(0).alias("origin"), F.lit(0).cast("long").alias("box")
    )
    elites = None
    for epoch in range(epochs):
        elites = materialize(items.groupBy("spec_id", "block", "island").applyInPandas(_island(epoch, generations, population), SCHEMA))
        goes = F.explode(F.array_distinct(F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(islands)))))
        items = elites.select("spec_id", "block", "item", "item_bytes", "capacity", "box", F.col("island").alias("origin"), goes.alias("island"))
    won = elites.groupBy("spec_id", "block").agg(F.min(F.struct("boxes", (-F.col("fitness")).alias("_f"), "island")).alias("_best")).select("spec_id", "block", F.col("_best.island").alias("island"))
    packed = elites.join(won, ["spec_id", "block", "island"]).select("spec_id", F.concat_ws("-", "block", "box").alias("container_id"), F.col("item").alias("doc_id"), "item_bytes", "capacity")
    split_before = each.filter("full > 0 AND rest > 0").select("spec_id", "doc_id", "full")
    placed = packed.join(split_before, ["spec_id", "doc_id"], "left").select(
        "spec_id", "container_id", "doc_id", (F.coalesce("full", F.lit(0)) + 1).cast("int").alias("piece_number"), (F.coalesce("full", F.lit(0)) * F.col("capacity")).alias("start_byte"), F.col("item_bytes").alias("piece_bytes"), F.col("capacity").alias("capacity_tokens")
    )
    return placed.unionByName(full)


def split_documents(packed: DataFrame) -> DataFrame:
    """``spec_id, doc_id`` of the documents that lie in more than one container."""
    return packed.filter("piece_number > 1").select("spec_id", "doc_id").distinct()


def containers(packed: DataFrame) -> DataFrame:
    """One row per container: its documents, bytes and unused space."""
    return packed.groupBy("spec_id", "container_id", "capacity_tokens").agg(F.count("*").alias("pieces"), F.sum("piece_bytes").alias("bytes")).withColumn("unused", F.col("capacity_tokens") - F.col("bytes"))


def bounds(packed: DataFrame) -> DataFrame:
    """``spec_id, bytes, documents, overfull, near_least``: one row per spec, with the number of containers above the capacity, and whether there are few more containers than bytes need."""
    each = containers(packed).groupBy("spec_id").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("_n"), F.count_if(F.col("unused") < 0).alias("overfull"), F.max("capacity_tokens").alias("_c"))
    documents = packed.groupBy("spec_id").agg(F.count_distinct("doc_id").alias("documents"))
    least = F.ceil(F.col("bytes") / F.col("_c"))
    return each.join(documents, "spec_id").select("spec_id", "bytes", "documents", "overfull", (F.col("_n") <= F.greatest(least + 2, F.ceil(least * 1.02))).alias("near_least"))
