"""Literal cases of alignment, edits, votes, promotion and statistics."""

import pytest

from glyphloom.functions.similarity import edit_operations, gestalt
from glyphloom.operators import confidence, scoring, slides, translation
from glyphloom.operators.order_stats import exact_median
from tests.conftest import rows


@pytest.mark.parametrize(("a", "b", "expected"), [("cat", "cut", (1, 0, 0)), ("cat", "cart", (0, 0, 1)), ("cat", "ct", (0, 1, 0)), ("text", "", (0, 4, 0)), ("", "text", (0, 0, 4)), ("", "", (0, 0, 0))])
def test_edit_operations(a, b, expected):
    assert edit_operations(list(a), list(b)) == expected


def test_edit_operations_match_a_plain_table():
    import random

    rng = random.Random(3)
    for _ in range(60):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(2))
        d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j - 1] + (a[i - 1] != b[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
        assert sum(edit_operations(list(a), list(b))) == d[-1][-1]


def test_rates(spark):
    df = spark.createDataFrame([(1, "one two", "one three"), (2, "text", ""), (3, "", "text"), (4, "A  line\ntext", "A line text"), (5, None, "x")], "id int, r string, c string")
    got = {r.id: r for r in scoring.scored(df, "r", "c").collect()}
    assert got[1].wer == 0.5 and got[2].cer == 1.0 and got[2].characters.deletions == 4
    assert got[3].cer is None and got[3].characters.insertions == 4
    assert got[4].exact and got[4].cer == 0.0
    assert got[5].cer is None


def test_alignment_by_two_keys_and_duplicates(spark):
    schema = "g int, id long, slide_id string, frame_index long"
    r = spark.createDataFrame([(1, 1, "intro", 10), (1, 2, "duplicate", 20), (1, 3, "same", None), (1, 4, "same", None), (1, 5, "missing", None)], schema)
    c = spark.createDataFrame([(1, 11, "intro", 99), (1, 12, "different", 20), (1, 13, "same", None), (1, 14, "same", None), (1, 15, "extra", None)], schema)
    got = {(x.reference_row, x.candidate_row, x.method) for x in scoring.align(r, c, ["g"], "id", "slide_id", "frame_index").collect()}
    assert {(1, 11, "slide_id"), (2, 12, "frame_index")} <= got
    assert {(3, None, "missing"), (None, 15, "unmatched")} <= got and len(got) == 8
    assert scoring.align(r.limit(0), c.limit(0), ["g"], "id", "slide_id", "frame_index").count() == 0


def test_positions(spark):
    schema = "g int, o int, t string"
    a, b = spark.createDataFrame([(1, 1, "One"), (1, 2, "Two")], schema), spark.createDataFrame([(1, 1, "One"), (1, 2, "three"), (1, 3, "Four")], schema)
    assert [tuple(r)[1:] for r in scoring.positional(a, b, ["g"], "o", "t").orderBy("position").collect()] == [(1, "One", "One"), (2, "Two", "three"), (3, "", "Four")]


def clustered(spark, texts):
    df = spark.createDataFrame([("v", 1, k, 0, "BODY", t) for k, t in enumerate(texts)], "video_id string, slide_number long, place long, paragraph_index int, text_type string, text string")
    return [r.text for r in slides.paragraph_clusters(df).orderBy("cluster").collect()]


def test_clusters_take_the_end_of_a_chain_and_the_vote_else(spark):
    assert clustered(spark, ["a short", "a short", "a short text", "a short text in full"]) == ["a short text in full"]
    assert clustered(spark, ["this is based"] * 3 + ["this is basec", "this is s basec"]) == ["this is based"]
    assert clustered(spark, ["apples and pears", "quite unlike that"]) == ["apples and pears", "quite unlike that"]


def test_slides_follow_the_frame_before(spark):
    df = spark.createDataFrame([("v", 1, "a b c d"), ("v", 2, "A b c  d e"), ("v", 3, "x y z"), ("v", 4, ""), ("v", 5, "new words here"), ("w", 1, None)], "video_id string, frame_number long, combined_text string")
    got = [(r.frame_number, r.slide_number, r.build_index) for r in slides.slide_runs(df).filter("video_id = 'v'").orderBy("frame_number").collect()]
    assert got == [(1, 1, 0), (2, 1, 1), (3, 2, 0), (4, 3, 0), (5, 3, 1)]


def test_promotion(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("VI M", 0.65, 1), ("V", 0.65, 1), ("V", 0.98, 1), ("AI", 0.65, 1), ("x", 0.65, 1), ("5 mg", 0.65, 1), ("שלום", 0.65, 1), (None, None, None)], "t string, c double, n int")
    found = slides.assess(F.col("t"), F.col("c"), F.col("n"), F.lit(True), ["Latin"])
    got = [(r.withheld, r.reasons) for r in df.select(*[c.alias(k) for k, c in found.items()]).collect()]
    assert [g[0] for g in got] == [True, True, False, False, False, False, False, False]
    assert got[6][1] == ["Script Mismatch"]


def test_confidence_stats(spark):
    df = spark.createDataFrame([("a", 0.9), ("a", 0.2), ("a", 0.6), ("b", 0.59), ("b", 0.60), ("b", 0.61), ("c", None)], "k string, confidence double")
    stats = confidence.confidence_stats(df, ["k"])
    got = {r.k: r for r in confidence.with_empty(stats, df, ["k"]).collect()}
    assert got["a"].median == 0.6 and got["b"].below_threshold_count == 1
    assert got["c"].median is None and got["c"].region_count == 0 and got["c"].below_threshold_proportion == 0.0
    d = confidence.distribution(spark.createDataFrame([("x", v) for v in (0.59, 0.60, 0.95, 1.0, 0.595)], "k string, confidence double"), ["k"]).first()
    assert (d.bucket_1, d.bucket_2, d.bucket_6, d.n) == (1, 1, 2, 5)


def test_median_of_even_and_repeated_values(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 3.0), (1, 4.0), (2, 5.0), (3, None)], "k int, v double")
    assert rows(exact_median(df, ["k"], "v")) == [(1, 2.0), (2, 5.0)]


def test_source_text_and_provider(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "v", None, False, "c"), (2, None, "e", True, "c"), (3, " ", "e", False, "c"), (4, " ", "", True, None)], "id int, v string, e string, a boolean, c string")
    text, kind = translation.source_text(F.col("v"), F.col("e"), F.col("a"), F.col("c"))
    assert [(r.t, r.k) for r in df.select(text.alias("t"), kind.alias("k")).collect()] == [("v", "verified_ocr"), ("e", "user_edit"), ("c", "ocr"), (None, None)]

    def provider(t, _):
        if t == "bad":
            raise RuntimeError("provider unavailable")
        return t.upper()

    ran = translation.run_provider(spark.createDataFrame([(1, "a", "de"), (2, "bad", "de"), (3, "c", "de")], "id int, source_text string, target_language string"), provider)
    assert [(r.status, r.translated_text, r.error) for r in ran.orderBy("id").collect()] == [("success", "A", None), ("failure", None, "RuntimeError: provider unavailable"), ("success", "C", None)]


def test_names_and_gestalt():
    assert translation.planned_names(["A B", "a b", "x" * 50, "A B", "a b (2)"]) == ["A B", "a b (2)", "x" * 31, "A B (3)", "a b (2) (2)"]
    assert gestalt("abcd", "bcde") == 0.75


def test_keys_must_agree(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert rows(translation.key_violations(a, b, "k")) == [(1, "missing"), (2, "repeated on the left"), (3, "unknown")]
    with pytest.raises(ValueError):
        translation.strict_join(a, b, "k")


def test_rates_take_every_script(spark, tmp_path):
    from glyphloom.plans.registry import QUERIES

    pairs = [(1, "v", "one two", "one twa"), (2, "v", "Таблица", "Таблнцы"), (3, "v", "café  naïve", "cafe naïve"), (4, "w", "שלום", ""), (5, "w", "", "ж"), (6, "w", None, "x"), (7, "w", "ещё один", "ещё один"), (8, "w", "ÄÖ", "äö")]
    spark.createDataFrame([(k, v, f"s{k}", k, r, c) for k, v, r, c in pairs], "benchmark_id long, video_id string, slide_id string, frame_index long, reference_text string, candidate_text string").write.parquet(f"{tmp_path}/benchmark_slides.parquet")
    collapsed = [(k, v, " ".join(r.split()), " ".join(c.split())) for k, v, r, c in pairs if r is not None and c is not None]
    edits = {k: (v, sum(edit_operations(list(r), list(c))), len(r)) for k, v, r, c in collapsed}
    assert rows(QUERIES["char_error_rate"](spark, str(tmp_path))) == sorted(((k, e, round(e / n, 9) if n else None) for k, (_, e, n) in edits.items()), key=repr)
    expected = []
    for video in "vw":
        own = [(e, n) for v, e, n in edits.values() if v == video]
        rated = [e / n for e, n in own if n]
        expected.append((video, sum(e for e, _ in own), sum(n for _, n in own), round(sum(e for e, _ in own) / sum(n for _, n in own), 9), round(sum(rated) / len(rated), 9)))
    assert rows(QUERIES["weighted_error_rate"](spark, str(tmp_path))) == expected
    worst = sorted(((-e / n, k) for k, (_, e, n) in edits.items() if n))[:5]
    assert [tuple(r) for r in QUERIES["worst_slides_topk"](spark, str(tmp_path)).collect()] == [(k, round(-x, 9)) for x, k in worst]


def test_providers_get_every_script(spark, tmp_path):
    from glyphloom.plans.registry import QUERIES

    texts = [(1, "abc"), (2, "ёж 5"), (3, "10 % же"), (4, " "), (5, None), (2, "ёж 5")]
    spark.createDataFrame(texts, "row_id long, original_text string").write.parquet(f"{tmp_path}/workbook_rows.parquet")
    assert rows(QUERIES["provider_failure_containment"](spark, str(tmp_path))) == [(1, "success", "[xx] cba", None), (2, "success", "[xx] 5 жё", None), (3, "failure", None, "ValueError: a per cent sign")]


def presented(spark, folder, regions, frames):
    from glyphloom.plans.registry import QUERIES

    spark.createDataFrame(
        [(k, "v", "r", frame, 1, 1, text, confidence, box, "e", None) for k, (frame, text, confidence, box) in enumerate(regions)],
        "region_id long, video_id string, run_id string, frame_id long, frame_number long, source_index int, text string, confidence double, box array<double>, engine string, ingested_at timestamp",
    ).write.parquet(f"{folder}/regions.parquet")
    spark.createDataFrame(frames, "frame_id long, video_id string, frame_number long, combined_text string, timestamp_seconds double, width int, height int, ingested_at timestamp").write.parquet(f"{folder}/frames.parquet")
    return {r.text: (r.withheld, r.reasons) for r in QUERIES["presentation_end_to_end"](spark, str(folder)).collect()}


def test_presentation_withholds_weak_evidence(spark, tmp_path):
    small, large = [10.0, 10.0, 30.0, 30.0], [100.0, 100.0, 900.0, 300.0]
    regions = [(1, "VI M", 0.65, small), (2, "V", 0.65, large), (3, "X", 0.98, small), (4, "AI", 0.65, small), (5, "I V", 0.65, small), (6, "I V", 0.65, small), (7, "M V", 0.65, large), (8, "M V", 0.65, large), (9, "C X", 0.65, small)]
    shows = ["VI M", "V", "X", "AI", "I V", "I V", "M V", "M V", "C X"]
    sizes = [(1000, 1000)] * 8 + [(0, None)]
    got = presented(spark, tmp_path, regions, [(k, "v", k, t, 1.0, *size, None) for k, (t, size) in enumerate(zip(shows, sizes), 1)])
    structure, weak, tiny, once = "Fragment-like Structure", "Weak OCR Evidence", "Tiny Visual Footprint", "Uncorroborated Observation"
    assert got == {
        "VI M": (True, [structure, weak, tiny, once]),
        "V": (True, [structure, weak, once]),
        "X": (False, []),
        "AI": (False, []),
        "I V": (True, [structure, weak, tiny]),
        "M V": (False, []),
        "C X": (True, [structure, weak, once]),
    }
