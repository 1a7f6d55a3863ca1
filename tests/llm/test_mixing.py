"""Balanced sampling: totals, chances, caps."""

import random

from glyphloom.llm import mixing as mx
from tests.conftest import rows

TARGETS = "mix_id int, source string, target_share double, repeat_cap int, budget_fraction double"


def test_flight_keeps_both_totals():
    rng = random.Random(1)
    for _ in range(40):
        n = rng.randrange(1, 200)
        p, z = [rng.random() for _ in range(n)], [float(rng.randrange(0, 500)) for _ in range(n)]
        q = mx.flight(p, z, rng)
        assert abs(sum(p) - sum(q)) < 1e-6 and abs(sum(a * b for a, b in zip(p, z)) - sum(a * b for a, b in zip(q, z))) < 1e-4
        assert sum(0 < x < 1 for x in q) <= 2
        assert sum(0 < x < 1 for x in mx.flight(p, z, rng, 12)) <= 12
        landed = mx.landing(list(q), z)
        assert all(x in (0.0, 1.0) for x in landed) and all(a == b for a, b in zip(q, landed) if b in (0, 1) and a in (0, 1))


def test_chances_are_kept():
    p, z = [0.1, 0.3, 0.5, 0.7, 0.9, 0.25], [1.0, 5.0, 2.0, 8.0, 3.0, 4.0]
    total = [0.0] * 6
    for seed in range(4000):
        rng = random.Random(seed)
        q = mx.flight(p, z, rng)
        total = [a + b for a, b in zip(total, q)]
    assert all(abs(t / 4000 - x) < 0.035 for t, x in zip(total, p))


def test_landing_by_brute_force():
    rng = random.Random(2)
    for _ in range(30):
        n = rng.randrange(1, 9)
        p, z = [rng.uniform(0.05, 0.95) for _ in range(n)], [float(rng.randrange(0, 60)) for _ in range(n)]
        want = min(abs(sum(z[i] for i in range(n) if k >> i & 1) - sum(a * b for a, b in zip(p, z))) for k in range(1 << n))
        got = mx.landing(list(p), z)
        assert abs(abs(sum(a * b for a, b in zip(got, z)) - sum(a * b for a, b in zip(p, z))) - want) < 1e-6


def test_shares_caps_and_blocks(spark):
    rng = random.Random(3)
    docs = [(k, rng.choice(["a", "a", "a", "b", "c", None]), "t" * rng.randrange(10, 400), 1) for k in range(3000)] + [(9000, "c", None, 1), (9001, "c", "", 1), (9002, None, "x", 1)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, chance int")
    t = spark.createDataFrame([(1, "a", 0.5, 1, 0.4), (1, "b", 0.3, 4, 0.4), (1, "c", 0.2, 2, 0.4), (2, "c", 0.9, 2, 1.0), (2, "a", 0.1, 1, 1.0), (3, "nowhere", 1.0, 2, 1.0), (3, "b", 0.0, 2, 1.0)], TARGETS)
    chosen, report = mx.mix(df, t, block=40)
    got = {(r.mix_id, r.source): r for r in report.collect()}
    size = {}
    for k, s, text, _ in docs:
        if s:
            size[s] = size.get(s, 0) + len(text or "")
    for (m, s), r in got.items():
        assert r.source_bytes == size.get(s, 0) and r.most_repeats <= r.repeat_cap
        if not r.short:
            assert abs(r.reached_bytes - r.target_bytes) <= 400
        else:
            assert r.reached_bytes == r.repeat_cap * size.get(s, 0) < r.target_bytes
    assert got[2, "c"].short and not got[1, "a"].short
    assert got[3, "b"].reached_bytes == 0 and got[3, "nowhere"].short
    assert chosen.groupBy("mix_id", "source", "doc_id").count().filter("count > 1").count() == 0
    assert rows(chosen) == rows(mx.mix(df, t, block=40)[0])


def test_empty(spark):
    df = spark.createDataFrame([(1, "a", "abc")], "doc_id long, source string, text string")
    t = spark.createDataFrame([(1, "a", 1.0, 2, 0.5)], TARGETS)
    assert mx.mix(df.limit(0), t)[0].count() == 0 and mx.mix(df, t.limit(0))[1].count() == 0


def test_shares_of_small_budgets(spark):
    """Every source that is not short comes within a smallest document, or two per cent, of its target, whatever single documents there are."""
    rng = random.Random(8)
    docs = [(k, "abc"[k % 3], "t" * (rng.randrange(40, 400) if k % 50 else 20_000)) for k in range(1500)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    t = spark.createDataFrame([(1, s, 1 / 3, 2, f) for s, f in (("a", 0.02), ("b", 0.02), ("c", 0.02))] + [(2, s, 1 / 3, 2, 0.9) for s in "abc"], TARGETS)
    for r in mx.mix(df, t)[1].collect():
        assert not r.short and abs(r.reached_bytes - r.target_bytes) <= max(40, 0.02 * r.target_bytes)


def test_large_documents_are_settled_first():
    rng = random.Random(4)
    for _ in range(20):
        z = [float(rng.randrange(50, 300)) for _ in range(400)] + [9000.0, 12_000.0, 4000.0]
        q = mx.flight([0.6] * len(z), z, rng)
        assert all(size < 300 for x, size in zip(q, z) if 0 < x < 1)
