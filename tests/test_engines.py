"""Engines, pages, batches, sheets and reviews on small tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from glyphloom.operators import confidence, engines, exports, translation
from tests.conftest import rows


def failing_engine():
    def read(image):
        if image == "bad":
            raise RuntimeError("no model")
        return image.split(), [0.5] * len(image.split()), [[0, 0, 1, 1]] * len(image.split())

    return read


def test_a_frame_that_fails_is_a_row(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "bad"), (3, None), (4, "")], "k int, image string")
    got = rows(engines.recognise(df, failing_engine, ["k"]))
    assert got == sorted([(1, 0, "a", 0.5, [0.0, 0.0, 1.0, 1.0], None), (1, 1, "b", 0.5, [0.0, 0.0, 1.0, 1.0], None), (2, None, None, None, None, "RuntimeError: no model")], key=repr)
    assert engines.recognise(df.limit(0), failing_engine, ["k"]).count() == 0


def test_pages_are_checked(spark):
    nan = float("nan")
    box = [0.0, 0.0, 1.0, 1.0]
    pages = [(1, ["a"], [0.5], [box]), (2, ["a"], [0.5, 0.6], [box]), (3, ["a"], [nan], [box]), (4, ["a"], [None], [box]), (5, ["a"], [0.5], [[0.0, 1.0]]), (6, ["a"], [0.5], [[2.0, 0.0, 1.0, 1.0]]), (7, [], [], []), (8, ["a"], [0.5], [None])]
    df = spark.createDataFrame([(*p, None) for p in pages], "k int, " + engines.PAGES)
    got = {r.k: (r.position, r.error) for r in engines.page_regions(df, ["k"]).collect()}
    assert got == {1: (0, None), 2: (None, "inconsistent counts"), 3: (None, "confidence is not finite"), 4: (None, "confidence is not finite"), 5: (None, "box is not four numbers"), 6: (None, "box is not ordered"), 8: (None, "box is not four numbers")}


def test_engines_by_name():
    engines.register_engine("some", failing_engine)
    assert "some" in engines.engine_names() and engines.engine_factory("some") is failing_engine
    with pytest.raises(ValueError):
        engines.engine_factory("none such")


def test_a_source_that_fails_ends_no_batch(spark):
    def process(source):
        if source == "b":
            raise OSError("gone")
        return source.upper()

    got = engines.run_batch(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "source string, place int"), process)
    assert rows(got.select("source", "place", "success", "detail", "error")) == [("a", 1, True, "A", None), ("b", 2, False, None, "OSError: gone"), ("c", 3, True, "C", None)]
    assert rows(engines.batch_summary(got)) == [(3, 2, 1)]
    assert [r[0] for r in got.orderBy("place").select(engines.batch_log(got)).collect()][1] == ["Video: b", "Status: Failed", "Error: OSError: gone"]


def test_reviewed_texts(spark):
    cases = [(s, t, state) for s, t in (("success", "ai"), ("failure", None)) for state in ("unreviewed", "accepted", "edited_verified", "flagged")]
    df = spark.createDataFrame(cases, "status string, t string, state string").withColumn("edit", F.lit("edit"))
    text, verified = translation.resolved(F.col("status"), F.col("t"), F.col("state"), F.col("edit"))
    got = {(r.status, r.state): (r.x, r.v) for r in df.select("status", "state", text.alias("x"), verified.alias("v")).collect()}
    assert got == {
        ("success", "unreviewed"): ("ai", False),
        ("success", "accepted"): ("ai", True),
        ("success", "edited_verified"): ("edit", True),
        ("success", "flagged"): ("ai", False),
        **{("failure", s): (None, False) for s in ("unreviewed", "accepted", "edited_verified", "flagged")},
    }


def test_warnings_in_their_order(spark):
    long = "the quiet river runs to the old bridge"
    cases = [
        (1, "success", long, long.upper()),
        (2, "success", long, "ein ganz anderer Satz steht hier"),
        (3, "success", "1 of 2", "1 von 3"),
        (4, "success", "- a\n- b\n- c", "a b c"),
        (5, "failure", "x", None),
        (6, "success", f"{long} 7", long),
        (7, "success", f"see www.site.example {long}", f"see www.site.example {long}"),
        (8, "success", "too few words", "too few words"),
    ]
    df = spark.createDataFrame(cases, "k int, status string, s string, t string")
    got = {r.k: (r.review_warnings, r.review_priority) for r in translation.assessed(df, "s", "t").collect()}
    high = "review_recommended"
    assert got == {
        1: (["source_copy_similarity"], high),
        2: ([], "normal_review"),
        3: (["numeric_mismatch"], high),
        4: (["structure_mismatch"], high),
        5: (["translation_failed"], "translation_failed"),
        6: (["source_copy_similarity", "numeric_mismatch"], high),
        7: ([], "normal_review"),
        8: ([], "normal_review"),
    }


def test_sheets_of_one_workbook(spark):
    df = spark.createDataFrame([("a/b", 3), ("A:B", 1), ("a?b", 2), ("x" * 40, 4), ("X" * 33, 5)], "video string, place int")
    got = {r.video: r.sheet for r in exports.consolidated(df, "video", "place").collect()}
    assert got == {"A:B": "A_B", "a?b": "a_b (2)", "a/b": "a_b (3)", "x" * 40: "x" * 31, "X" * 33: "X" * 27 + " (2)"}
    with pytest.raises(ValueError):
        exports.consolidated(df.limit(0), "video", "place")


def test_any_number_of_sheets(spark):
    df = spark.range(1500).selectExpr("concat('vid-', lpad(id, 6, '0')) AS video", "id AS place")
    got = exports.consolidated(df, "video", "place").collect()
    assert len(got) == 1500 and all(r.sheet == r.video for r in got)


def test_sheets_are_planned_in_blocks_as_all_together(spark):
    rng = random.Random(3)
    ends = ["", "", " (2)", " (3)", " (2) (2)", " (2", "Σ", "ς", " x", "İ", "ß", "/", "?"]
    names = sorted({"".join(rng.choice("aAbΣς")[0] * rng.choice([0, 1, 2, 13, 14, 15, 22]) for _ in range(2)) + "".join(rng.choice(ends) for _ in range(3)) + rng.choice(["", "", "y" * 15, " " * 12]) for _ in range(2500)} | {"", "VIDEO", "Video (2)"})
    rng.shuffle(names)
    given = [re.sub(r"[:\\/?*\[\]]", "_", n).strip() or "Video" for n in names]
    df = spark.createDataFrame([(n, k) for k, n in enumerate(names)] + [(n, 10_000) for n in names[:9]] + [(None, 0)], "video string, place int")
    rows = exports.consolidated(df, "video", "place").collect()
    got = {r.video: r.sheet for r in rows}
    assert len(rows) == len(names) + 9 and [got[n] for n in names] == translation.planned_names(given)
    assert len({s.lower() for s in got.values()}) == len(names) > 1000 and max(map(len, got.values())) == 31


def test_secrets_stay_out_of_metadata(spark):
    df = spark.createDataFrame([(1, "v", {"model": "m", "API-Key": "k", "clientSecret": "s"}), (2, None, None)], "k int, f string, m map<string,string>")
    assert rows(exports.metadata_rows(df, "k", ["f"], "m")) == [(1, "f", "v"), (1, "model", "m")]


def test_criteria(spark):
    df = spark.createDataFrame([("o", 0.5, 0.5, 0, 0, 10.0), ("a", 0.4, 0.4, 2, 1, 15.0), ("b", 0.5, 0.4, 1, 1, 16.0), ("c", None, 0.6, 0, 0, 1.0)], "v string, cer double, wer double, improved long, worsened long, seconds double")
    got = {r.v: (r.passed.split("; "), r.failed.split("; ")) for r in confidence.decision_criteria(df, "v", "o").collect()}
    names = confidence.CRITERIA
    assert got["o"] == (["n/a"], ["n/a"]) and got["a"] == (names, [""])
    assert got["b"] == ([names[1], names[3]], [names[0], names[2], names[4], names[5]]) and got["c"][0] == [names[3], names[4]]
