"""Exactness against brute force, thresholds, and groups."""

import random

import numpy as np

from glyphloom.llm import near_duplicates as nd
from tests.conftest import rows


def brute(records, least):
    sets = {k: frozenset(t.lower().split()) for k, t in records if t}
    sets = {k: s for k, s in sets.items() if len(s) >= least}
    keys = sorted(sets)
    return sorted((a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4)


def corpus(seed, n, low, high):
    rng = random.Random(seed)
    common = [f"w{k}" for k in range(60)]
    out = []
    for k in range(n):
        if out and rng.random() < 0.5:
            words = rng.choice(out)[1].split()
            for _ in range(rng.randrange(0, max(2, len(words) // 6))):
                words[rng.randrange(len(words))] = rng.choice(common) if rng.random() < 0.7 else f"rare{rng.randrange(10_000)}"
            rng.shuffle(words)
        else:
            words = [rng.choice(common) if rng.random() < 0.8 else f"rare{rng.randrange(10_000)}" for _ in range(rng.randrange(low, high))]
        out.append((k, " ".join(words)))
    return out


def found(spark, records, least):
    df = spark.createDataFrame(records, "id long, t string")
    classes, members = nd.word_classes(df, "id", "t", least)
    return sorted(rows(nd.record_pairs(classes, members, nd.similar_classes(classes, least))))


def test_all_pairs_and_no_others(spark):
    for seed, low, high, least in ((1, 8, 20, 5), (2, 30, 70, 25), (3, 100, 260, 25)):
        records = corpus(seed, 220, low, high)
        assert found(spark, records, least) == brute(records, least)


def test_edges(spark):
    text = " ".join(f"x{k}" for k in range(30))
    records = [(1, text), (2, text), (2, text), (3, text.upper()), (4, None), (5, ""), (6, " ".join(text.split()[:24])), (7, " ".join(text.split()[:25])), (8, " ".join(f"y{k}" for k in range(3000)))]
    assert found(spark, records, 25) == [(1, 2), (1, 3), (1, 7), (2, 3), (2, 7), (3, 7)]
    assert found(spark, records[4:5], 25) == []
    df = spark.createDataFrame(records, "id long, t string")
    classes, members = nd.word_classes(df, "id", "t", 25)
    tied = rows(nd.record_pairs(classes, members, nd.similar_classes(classes, 25), expanded=2))
    assert tied == [(1, 2), (1, 3), (1, 7)]


def test_groups(spark):
    base = [f"x{k}" for k in range(40)]
    chain = [" ".join(base[k * 3 :] + [f"z{j}" for j in range(k * 3)]) for k in range(4)]
    df = spark.createDataFrame([(k, t, 9, 9) for k, t in enumerate(chain)] + [(9, chain[0], 9, 9), (10, None, 1, 1)], "id long, t string, class_id int, component int")
    got = {r.record: r for r in nd.groups(df, "id", "t").collect()}
    assert {r.group_id for r in got.values()} == {0} and got[9].class_id == 0 and got[0].copies == 2 and 10 not in got
    assert nd.groups(df.limit(0), "id", "t").count() == 0


def test_thresholds_are_enough_and_cheapest():
    from itertools import product

    rng = np.random.default_rng(4)
    cost = rng.random((50, 4, 3)).cumsum(2)
    cost[:, :, 0] = 0
    units = rng.integers(1, 9, 50)
    t = nd.allocate(cost, units)
    for k in range(50):
        best = min(sum(cost[k, i, x] for i, x in enumerate(c)) for c in product(range(3), repeat=4) if sum(c) >= units[k])
        assert (t[k] + 1).sum() >= units[k] and abs(sum(cost[k, i, x + 1] for i, x in enumerate(t[k])) - best) < 1e-9


def test_partitions_always_suffice():
    for low in range(1, 400):
        ends = nd.size_classes(low, low * 2)
        high = ends[1] - 1
        largest = high * 5 // 4
        assert 2 * nd.partitions_of(high) >= (largest + high) // 9 + 1


def test_components(spark):
    nodes = spark.createDataFrame([(k,) for k in range(12)], "node long")
    links = spark.createDataFrame([(k, k + 1) for k in range(7)] + [(10, 9)], "a long, b long")
    assert rows(nd.components(nodes, links)) == sorted([(k, 0) for k in range(8)] + [(8, 8), (9, 9), (10, 9), (11, 11)], key=repr)


def test_large_classes_give_all_pairs(spark):
    rng = random.Random(6)
    base = [f"x{k}" for k in range(30)]
    records = []
    for k in range(70):
        words = base[:] if k % 3 else base + [base[0]]
        rng.shuffle(words)
        records.append((k, " ".join(words).upper() if k % 5 == 0 else " ".join(words)))
    records += [(100 + k, " ".join(base)) for k in range(55)] + [(200 + k, " ".join(base[:-2] + ["y", "z"])) for k in range(60)] + [(300, " ".join(base[:-1]))]
    expected = brute(records, 25)
    assert found(spark, records, 25) == expected
    df = spark.createDataFrame(records, "id long, t string")
    classes, members = nd.word_classes(df, "id", "t", 25)
    assert sorted(rows(nd.record_pairs(classes, members, nd.similar_classes(classes, 25), per_slice=7))) == expected
