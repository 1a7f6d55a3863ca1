"""Packing keeps every byte, fills well, and is the same each time."""

import random

from glyphloom.llm import packing as pk
from tests.conftest import rows

SPECS = "spec_id int, purpose string, capacity_tokens int, overlap_tokens int"


def documents(spark, n=900, seed=1):
    rng = random.Random(seed)
    data = [(k, "x" * rng.choice([rng.randrange(0, 60), rng.randrange(20, 100), rng.randrange(90, 400) if rng.random() < 0.1 else 30])) for k in range(n)]
    return data + [(n, None), (n + 1, ""), (n + 2, "y" * 12_345), (0, data[0][1])]


def test_every_byte_once_and_nothing_too_full(spark):
    data = documents(spark)
    df = spark.createDataFrame([(*d, 1) for d in data], "doc_id long, text string, capacity int")
    specs = spark.createDataFrame([(1, "pack", 100, 0), (2, "pack", 1000, 0), (3, "split", 10, 1)], SPECS)
    packed = pk.pack(df, specs, block=300).cache()
    size = {k: len((t or "").encode()) for k, t in data}
    for spec, capacity in ((1, 100), (2, 1000)):
        own = packed.filter(f"spec_id = {spec}").collect()
        by = {}
        for r in own:
            by.setdefault(r.doc_id, []).append((r.start_byte, r.piece_bytes))
        assert by.keys() == size.keys()
        for k, parts in by.items():
            parts.sort()
            assert sum(b for _, b in parts) == size[k] and all(a + b == c for (a, b), (c, _) in zip(parts, parts[1:]))
            assert len(parts) == 1 or size[k] > capacity
        boxes = pk.containers(packed.filter(f"spec_id = {spec}")).collect()
        assert all(0 <= r.unused <= capacity for r in boxes)
        assert len(boxes) <= -(-sum(size.values()) // capacity) * 1.06 + 3
    assert rows(pk.split_documents(packed)) == sorted([(s, k) for s, c in ((1, 100), (2, 1000)) for k, n in size.items() if n > c], key=repr)
    assert rows(packed) == rows(pk.pack(df, specs, block=300))


def test_evolution_beats_or_equals_plain_best_fit():
    rng = random.Random(4)
    for _ in range(5):
        size = [rng.randrange(20, 70) for _ in range(120)]
        order = sorted(range(120), key=lambda i: -size[i])
        plain = pk._best_fit([], order, size, 100)
        best = pk.evolve(size, 100, [], random.Random(1), generations=20)
        assert len(best) <= len(plain) and sorted(i for g in best for i in g) == list(range(120))
        assert all(sum(size[i] for i in g) <= 100 for g in best)


def test_crossover_keeps_items():
    rng = random.Random(2)
    size = [rng.randrange(1, 50) for _ in range(60)]
    a = pk._best_fit([], list(range(60)), size, 100)
    b = pk._best_fit([], list(reversed(range(60))), size, 100)
    for _ in range(30):
        child = pk._mutate(pk._crossover(a, b, size, 100, rng), size, 100, rng)
        assert sorted(i for g in child for i in g) == list(range(60)) and all(sum(size[i] for i in g) <= 100 for g in child)


def test_empty(spark):
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    specs = spark.createDataFrame([(1, "pack", 100, 0)], SPECS)
    assert pk.pack(df.limit(0), specs).count() == 0 and pk.pack(df, specs.limit(0)).count() == 0
    assert pk.pack(spark.createDataFrame([(1, "z" * 200)], df.schema), specs).count() == 2


def test_evolution_beats_best_fit_where_three_fill_a_container():
    """Containers of three documents that fit exactly: best fit by falling size pairs the wrong ones, and crossover of whole containers keeps the right ones."""
    rng, capacity, sizes = random.Random(1), 1000, []
    for _ in range(200):
        a = rng.randrange(380, 490)
        b = rng.randrange(251, min(490, capacity - a - 251))
        sizes += [a, b, capacity - a - b]
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    plain = len(pk._best_fit([], order, sizes, capacity))
    short = pk.evolve(sizes, capacity, [], random.Random(2))
    long = pk.evolve(sizes, capacity, [], random.Random(2), generations=200, population=20)
    assert 200 <= len(long) < len(short) < plain
    assert all(sum(sizes[i] for i in g) <= capacity for g in long) and sorted(i for g in long for i in g) == list(range(600))
