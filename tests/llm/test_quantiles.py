"""Guaranteed errors, merging, and wrong medians."""

import random
from datetime import datetime

from glyphloom.llm import quantiles as q
from tests.conftest import rows


def test_error_is_within_its_bound(spark):
    rng = random.Random(1)
    values = [rng.choice([-1, 1]) * rng.lognormvariate(0, 3) for _ in range(3001)] + [0.0] * 40 + [1e-300, 1e300]
    data = [("g", v) for v in values] + [("g", None), ("g", float("nan")), ("g", float("inf")), ("one", 7.0), ("none", None)]
    df = spark.createDataFrame(data, "k string, v double")
    values.sort()
    got = q.percentiles(q.sketch(df, ["k"], "v", 0.01), ["k"], [0.0, 0.1, 0.5, 0.9, 1.0], 0.01).collect()
    for r in (r for r in got if r.k == "g"):
        exact = values[int(r.q * (len(values) - 1))]
        assert r.n == len(values) and abs(r.estimate - exact) <= 0.01 * abs(exact) * (1 + 1e-6)
        assert r.least * (1 - 1e-9) - 1e-320 <= exact + abs(exact) * 1e-9 and exact - abs(exact) * 1e-9 <= r.most + abs(r.most) * 1e-9
    assert {r.k for r in got} == {"g", "one"}


def test_merging_changes_nothing(spark):
    df = spark.range(5000).selectExpr("id % 3 AS k", "id % 7 AS day", "cast(id * 37 % 1000 AS double) / 1000 AS v")
    whole = q.sketch(df, ["k"], "v")
    parts = q.merge(q.sketch(df, ["k", "day"], "v"), ["k"])
    assert rows(whole.select("k", "bucket", "n")) == rows(parts.select("k", "bucket", "n"))
    assert q.percentiles(whole.limit(0), ["k"], [0.5]).count() == 0


def test_wrong_medians_against_brute_force(spark):
    rng = random.Random(2)
    t = lambda d: datetime(2025, 1, d)
    regions, stats, expected, n = [], [], [], 0
    for run in range(60):
        values = [round(rng.random(), 4) for _ in range(rng.randrange(1, 12))]
        for v in values:
            n += 1
            regions.append((n, "v", f"r{run}", v, "e", t(1 + n % 5)))
            if n % 9 == 0:
                regions.append((n, "v", f"r{run}", v, "e", t(20)))
        regions.append((n + 100_000, "v", f"r{run}", rng.choice([None, float("nan"), 1.5, -0.1]), "e", t(2)))
        values.sort()
        exact = (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2
        stored = rng.choice([exact, exact + 0.01, exact - 0.0099, exact + 0.0101, exact * 100, None, round(exact, 1)])
        stats.append((run, "v", f"r{run}", stored))
        if stored is None or abs(stored - exact) > 0.01 + 1e-9:
            expected.append((run,))
    stats += [(900, "v", "unknown", None), (901, None, None, 0.5), (0, *stats[0][1:])]
    regions.append((999_999, None, None, None, None, None))
    r = spark.createDataFrame(regions, "region_id long, video_id string, run_id string, confidence double, engine string, ingested_at timestamp")
    s = spark.createDataFrame(stats, "stats_id long, video_id string, run_id string, median double")
    assert rows(q.wrong_medians(r, s).select("stats_id").distinct()) == sorted(expected, key=repr)
    assert q.wrong_medians(r.limit(0), s).count() == 0 and q.wrong_medians(r, s.limit(0)).count() == 0
