"""Previous rows and running sums over chunks, against windows over whole keys."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from glyphloom.operators.sequential import CHUNK, running, spread, with_previous
from glyphloom.operators.slides import slide_runs
from tests.conftest import rows


@pytest.fixture(autouse=True)
def many_chunks(spark):
    """Small tables would be coalesced into one chunk."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_chunks_hand_over(spark):
    rng = random.Random(4)
    data = [(rng.choice(["hot"] * 8 + ["a", "b", None]), k, rng.choice([1, 2, None])) for k in range(3000)]
    df = spark.createDataFrame(data, "key string, k int, v int")
    whole = spread(df, ["key"], ["k"])
    assert CHUNK not in whole.columns and CHUNK not in spread(df.limit(0), ["key"], ["k"], rows=5).columns
    chunks = spread(df, ["key"], ["k"], rows=100)
    assert chunks.filter("key = 'hot'").select(CHUNK).distinct().count() > 2
    by = Window.partitionBy("key").orderBy("k")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    both = [running(with_previous(x, ["key"], ["k"], "v", "p"), ["key"], ["k"], {"s": F.col("v"), "n": F.lit(1)}, {"m": F.col("v") * F.col("k")}) for x in (chunks, whole)]
    want = df.withColumns({"p": F.lag("v").over(by), "s": F.coalesce(F.sum("v").over(upto), F.lit(0)), "n": F.row_number().over(by).cast("long"), "m": F.max(F.col("v") * F.col("k")).over(upto)})
    columns = ["key", "k", "v", "p", "s", "n", "m"]
    for got in both:
        assert rows(got.select(columns)) == rows(want.select(columns))


def test_slides_of_one_long_video(spark):
    rng = random.Random(7)
    words = ["river stone", "open gate", "long road"]
    texts, shown = [], ""
    for _ in range(1200):
        shown = f"{shown} {rng.choice(words)}" if rng.random() < 0.5 and len(shown) < 200 else rng.choice([shown, rng.choice(words), "", None])
        shown = shown or ""
        texts.append(shown or None)
    df = spark.createDataFrame([("v", k, t) for k, t in enumerate(texts)], "video_id string, frame_number long, combined_text string")
    found = [[(r.slide_number, r.build_index, r.place) for r in slide_runs(df, rows=n).orderBy("frame_number").collect()] for n in (100, 5000)]
    expected, slide, build, before = [], 0, 0, None
    for place, t in enumerate(texts, 1):
        norm = " ".join((t or "").split())
        if before is None:
            same = False
        else:
            a, b = set(before.split()), set(norm.split())
            same = norm.startswith(before) or (not a | b or len(a & b) / len(a | b) >= 0.6)
        slide, build = (slide, build + (before != norm)) if same else (slide + 1, 0)
        expected.append((slide, build, place))
        before = norm
    assert found == [expected, expected]
