"""Consistent forms: literal cases, and what must not change."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphloom.llm import lookalikes
from tests.conftest import rows

CHANGED = {
    "ｅｖｅｒｙ ｐａｇｅ": "every page",
    "the​ shared g‌arden": "the shared garden",
    "The Translated Glossary": "The Translated Glossary",
    "our st­rategy": "our strategy",
    "décor": "décor",
    "justiﬁes each": "justifies each",
    "аnd Lеbоnа": "and Lebona",
    "eνery one": "every one",
    "cafе́": "café",
    "overlaps а low-cost manuscript": "overlaps a low-cost manuscript",
    "Привeт": "Привет",
    "10 Ω": "10 Ω",
}
KEPT = ["Москва", "Δt", "β-test", "x³", "½ of the frame", "№ 7", "“quoted”", "l’été", "—", "10 Ω", "שלום", "مرحبا", "漢字", "안녕", "São Tomé", "Ответ меняет проверенный manuscript", "НО НЕ ДЛЯ ВСЕХ", "plain", "", "می‌خواهم", "👩‍💻"]


def test_literal_cases(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*CHANGED, *KEPT, None])], "id int, text string")
    got = {r.text: r.canonical for r in lookalikes.consistent(df).collect()}
    assert {t: got[t] for t in CHANGED} == CHANGED
    assert {t: got[t] for t in KEPT} == {t: t for t in KEPT}
    assert got[None] is None and len(got) == len(CHANGED) + len(KEPT) + 1


def test_one_form_for_all_members_of_a_class(spark):
    forms = ["naïve café", "naïve café", "na​ïve café", "naïve café", "nаïve café"]
    got = lookalikes.consistent(spark.createDataFrame([(t,) for t in [*forms, *forms, "Naïve café", "naive cafe"]], "text string"))
    seen = {r.canonical for r in got.collect()}
    assert seen == {"naïve café", "Naïve café", "naive cafe"} and got.count() == 12


def test_extra_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "x​y", "a", 2, "m", "o")], "id int, t string, canonical string, n int, mapped string, text string")
    assert [(r.id, r.t, r.n, r.mapped, r.text, r.canonical) for r in lookalikes.consistent(df, "t").collect()] == [(1, "x​y", 2, "m", "o", "xy")]
    assert lookalikes.consistent(df.limit(0), "t").count() == 0


def test_disguised_records(spark):
    regions = spark.createDataFrame([(1, "plain"), (2, "ｗｉｄｅ"), (2, "ｗｉｄｅ"), (3, None), (4, "")], "region_id long, text string")
    promotions = spark.createDataFrame([(1, "Latin", ["Latin"]), (2, "ｗｉｄｅ", ["Other/Unknown"]), (3, "аnd", ["Latin", "Cyrillic"]), (4, None, []), (5, "Мир", ["Cyrillic"]), (6, "and", None)], "promotion_id long, text string, observed_scripts array<string>")
    assert rows(lookalikes.disguised(regions, promotions)) == [("promotion", 2), ("promotion", 3), ("promotion", 6), ("region", 2)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="aeéïо́аｅ​  ß漢", max_size=12), min_size=1, max_size=20))
def test_forms_are_stable_composed_and_visible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    forms = [r.canonical for r in lookalikes.consistent(df).collect()]
    again = lookalikes.consistent(spark.createDataFrame([(t,) for t in forms], "text string"))
    assert all(r.text == r.canonical for r in again.collect())
    assert all(unicodedata.normalize("NFC", t) == t and "​" not in t for t in forms)


@pytest.mark.parametrize("text", ["a" * 300_000 + "​", "е" * 1000 + "x"])
def test_long_texts(spark, text):
    got = lookalikes.consistent(spark.createDataFrame([(text,)], "text string")).first()
    assert "​" not in got.canonical and "е" not in got.canonical
