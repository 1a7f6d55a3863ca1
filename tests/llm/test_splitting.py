"""Round trips of splitting."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphloom.llm import splitting as sp
from tests.conftest import rows


def check(text, capacity, overlap):
    data, got = text.encode(), sp.pieces(text, capacity, overlap)
    assert got[0][:2] == (0, 0) and got[-1][2] == len(data)
    at = 0
    for start, fresh, end in got:
        assert fresh == at and start <= fresh and end - start <= capacity and fresh - start <= overlap
        data[start:end].decode()
        at = end
    assert b"".join(data[f:e] for _, f, e in got) == data
    return got


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n#é漢!", max_size=400), st.integers(8, 60), st.integers(0, 4))
def test_round_trip(text, capacity, overlap):
    check(text, capacity, overlap)


def test_boundaries_from_coarse_to_fine():
    text = "# One\n" + "aa bb. " * 5 + "\n# Two\n" + "cc dd. " * 5
    got = check(text, 50, 0)
    assert text.encode()[got[1][0] :].startswith(b"# Two")
    got = check("first part here.\n\nsecond part here.", 20, 0)
    assert [e for _, _, e in got] == [18, 35]
    assert [e - s for s, _, e in check("x" * 100, 30, 0)] == [30, 30, 30, 10]
    got = check("one two three four five six seven", 16, 6)
    assert all("one two three four five six seven"[s:f].strip() in ("two", "three", "four", "five", "six", "") or s == f for s, f, _ in got)
    assert any(f > s for s, f, _ in got)


def test_whole_overlap_where_nothing_is_natural():
    got = check("y" * 1000, 100, 20)
    assert {f - s for s, f, _ in got[1:]} == {20}


def test_long_texts_and_bad_limits():
    check("word " * 100_000, 3000, 200)
    check("é" * 200_000, 3001, 201)
    with pytest.raises(ValueError):
        sp.pieces("abc", 3, 0)
    with pytest.raises(ValueError):
        sp.pieces("abc", 10, 8)


def test_tables(spark):
    specs = spark.createDataFrame([(1, "pack", 5, 0), (3, "split", 10, 3), (4, "split", 100, 5)], "spec_id int, purpose string, capacity_tokens int, overlap_tokens int")
    docs = spark.createDataFrame([(1, "short", 7), (2, "a longer text here", 7), (3, None, 7), (4, "", 7), (4, "", 7)], "doc_id long, text string, spec_id int")
    got = sp.split_oversized(docs, specs)
    assert [r[:3] for r in rows(got.select("spec_id", "doc_id", "piece_number", "text")) if r[0] == 3 and r[1] == 2] == [(3, 2, k) for k in (1, 2, 3)][: got.filter("spec_id = 3 AND doc_id = 2").count()]
    assert got.filter("doc_id = 2 AND spec_id = 3").count() > 1 and got.filter("spec_id = 4").count() == 5
    assert {r.piece_bytes for r in got.filter("doc_id IN (3, 4)").collect()} == {0} and got.filter("doc_id = 4").count() == 4
    assert sp.split_oversized(docs.limit(0), specs).count() == 0 and sp.split_oversized(docs, specs.limit(0)).count() == 0


def test_a_spec_without_room_fails_its_documents_alone(spark):
    specs = spark.createDataFrame([(1, "split", 3, 0), (2, "split", 10, 8), (3, "split", 10, 2), (4, "split", None, 0)], "spec_id int, purpose string, capacity_tokens int, overlap_tokens int")
    docs = spark.createDataFrame([(1, "abc"), (2, "a longer text here"), (3, None)], "doc_id long, text string")
    got = sp.split_oversized(docs, specs)
    failed = {(r.spec_id, r.doc_id) for r in got.filter("error IS NOT NULL").collect()}
    assert failed == {(1, 2), (2, 2), (4, 1), (4, 2), (4, 3)} and got.filter("error IS NOT NULL AND piece_number IS NOT NULL").count() == 0
    assert got.filter("spec_id = 3 AND doc_id = 2").count() > 1 and got.filter("error IS NULL AND spec_id = 1").count() == 2
