"""Statistics and shapes."""

from glyphloom.llm import quality
from tests.conftest import rows

PROSE = "Each central bridge weakens another external argument. As a result,\nthat separate outcome contradicts one kitchen of the carpet\nwithin 37 minutes."
TEXTS = {
    "prose": [PROSE, PROSE.replace("\n", " "), "la séance explique une partie du cours sans aucune autre question pour les élèves", "Ｅａｃｈ ｂｒｉｄｇｅ ｗｅａｋｅｎｓ ａｎｏｔｈｅｒ ａｒｇｕｍｅｎｔ． Ｉｔ ｄｏｅｓ．", "Таблица повторяет текст, Kovom\n19. Вопрос повторяет новое предложение в следующем месяце."],
    "list": ["1. each memory\n2. a caption\n3. every kitchen of it\n4. the evidence", "- one kitchen of a library;\n  - each bottle;\n- that following resource", "our desert of our quiet canyon\nthat steady carpet\n  that original heading\n  every window"],
    "table": ["Frame,Total,Duration\n1811,454.94,53:24\n3667,681.73,29:16", "| open | 3470 | 0.54 |\n| n/a | 3177 | 0.36 |\n| verified | 2134 | 0.35 |", "a\tb\tc\n1\t2\t3\n4\t5\t6\nverified\topen\tdone entirely", "Duration       Frame     Total\n11:11          1504      569.55\n36:35          1295      463.28"],
    "junk": ["23ec081041 13e9f28daf 1ea0c9e371 73333321f9 42b06a38bf", "dp kk xdb pzkh mm nbgkczn fslvnhrn phvkk cr mhsxchq mwhjpx", "l I | V | . I V I M 1 M J J V\nl . . 1 | . l 1 | M M\n| J 1 . M M J i M M 1 . l | i", "-!=&&} [\\]-%#'\n~^.]![ ?/| -^` ?\\' !%'=,^:;:\n}!,>_`= | / .#^|!||;%", "@@@@@@@@@@@@ {{{{{ }}}}}}} ,,,,,,,,,,,,,,, +++++++++++++"],
}


def documents(spark):
    own = [(k, s, t) for k, (s, t) in enumerate((s, t) for s, ts in TEXTS.items() for t in ts)]
    return own, spark.createDataFrame([(k, "s", t) for k, _, t in own], "doc_id long, source string, text string")


def test_shapes(spark):
    own, df = documents(spark)
    promotions = spark.createDataFrame([(k, t) for k, _, t in own] + [(100, None), (101, ""), (102, "x" * 39), (103, "word " * 200_000)], "promotion_id long, text string")
    got = quality.shapes(df, promotions)
    for kind in ("document", "promotion"):
        shape = {r.record_id: r.text_shape for r in got.filter(f"record_kind = '{kind}'").collect()}
        assert {k: shape[k] for k, _, _ in own} == {k: s for k, s, _ in own}
    assert shape[100] is None and shape[101] is None and shape[102] is None and shape[103] == "junk"
    assert quality.shapes(df.limit(0), promotions.limit(0)).count() == 0


def test_notices_do_not_decide(spark):
    notice = "Subscribe to the weekly letter of the archive for more, every one of you"
    word = ["memory", "caption", "bridge", "river", "lesson"]
    texts = [f"{notice}\n1. each {w} of ours\n2. a long {w} of the archive\n{notice}\n3. no {w} of it\n{notice}\n{notice}" for w in word]
    df = spark.createDataFrame([(k, "s", t) for k, t in enumerate(texts)] + [(9, None, texts[0])], "doc_id long, source string, text string")
    none = spark.createDataFrame([], "promotion_id long, text string")
    assert {r.text_shape for r in quality.shapes(df.unionByName(spark.createDataFrame([(k + 100, "s", f"Only this {'abcdefghijklmnop'[k]} one.") for k in range(16)], df.schema)), none).filter("record_id < 10").collect()} == {"list"}


def test_statistics_by_hand(spark):
    df = spark.createDataFrame([(1, "the cat sat.\nthe cat sat.\n\nend", 5), (2, "", 5), (3, None, 5)], "id int, text string, n_words int")
    assert "text" in quality.statistics(df).columns and quality.statistics(df.limit(0)).count() == 0
    got = {r.id: r for r in quality.statistics(df).collect()}
    one = got[1]
    assert (one.n_words, one.n_lines, one.n_sentence_ends, one.n_common) == (7, 3, 2, 2)
    assert one.duplicate_line_share == 1 / 3 and one.mean_word_length == 23 / 7 and one.ended_line_share == 2 / 3
    assert one.dominant_trigram_share == 2 * len("the cat sat.") / len("the cat sat. the cat sat. end")
    for k in (2, 3):
        assert got[k].n_words == 0 and got[k].symbol_share is None and got[k].dominant_bigram_share is None


def test_dominant_ngram_by_brute_force(spark):
    import random
    from collections import Counter

    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "bb", "c"]) for _ in range(rng.randrange(1, 14))) for _ in range(40)]
    got = [r.dominant_bigram_share for r in quality.statistics(spark.createDataFrame([(t,) for t in texts], "text string")).collect()]
    for t, share in zip(texts, got):
        w = t.split()
        runs = Counter(" ".join(w[k : k + 2]) for k in range(len(w) - 1))
        most = max([n * len(r) for r, n in runs.items() if n > 1], default=0)
        assert share == (min(1.0, most / len(t)) if len(w) > 1 else None)


def test_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, source string, text string")
    two = spark.createDataFrame([(1, PROSE), (1, PROSE)], "promotion_id long, text string")
    assert [r[2] for r in rows(quality.shapes(none, two).select("record_kind", "record_id", "text_shape"))] == ["prose", "prose"]


def test_statistics_of_both_kinds(spark, tmp_path):
    from glyphloom.llm.queries import QUERIES

    spark.createDataFrame([(1, "one line\none line"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b a b"), (1, "a b a b"), (3, "")], "promotion_id long, text string").write.parquet(f"{tmp_path}/promotion_records.parquet")
    got = QUERIES["p3_statistics"](spark, str(tmp_path)).select("record_kind", "record_id", "n_words", "duplicate_line_share", "dominant_bigram_share")
    assert rows(got) == [("document", 1, 4, 0.5, 16 / 17), ("document", 2, 0, None, None), ("promotion", 1, 4, 0.0, 6 / 7), ("promotion", 3, 0, None, None)]


def test_shapes_at_the_edge_of_prose(spark):
    texts = [
        ("table", "river stone,north side,open gate.\nsmall bridge,south bank,shut door.\nlong valley,east road,open field.\ngreen island,west shore,shut house."),
        ("list", "Bring all these with you today.\n\nsome fresh bread\ncold milk from here\na warm blanket\nthe sharp knives\na long rope\nwater and salt"),
        ("junk", "dp kk xdb pzkh mm nbgk. cr mhsx mwhj phv ttr. dk lmn prst kk wrt.\nnbgkczn fslvnhrn phvkk cr. mhsxchq mwhjpx dp kk."),
        ("junk", "Xkrt bnmp wrtk qpfg zxcv. " * 12),
        ("junk", "Xkrt bnmp wrtk qpfg zxcv " * 12),
        ("prose", "The river runs north, and the old bridge crosses it.\n\nNobody has seen the gate open in a long time.\nIt stays shut."),
    ]
    none = spark.createDataFrame([], "doc_id long, source string, text string")
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "promotion_id long, text string")
    assert [r.text_shape for r in quality.shapes(none, df).orderBy("record_id").collect()] == [s for s, _ in texts]


def test_boilerplate_is_known_by_repetition(spark):
    line = "Come back soon for more of these lessons. "
    own = "The {} of the old town stands beside the wide river, where a few people wait for the next boat. "
    texts = {
        "again and again": line * 8,
        "lines": "\n".join([line.strip(), own.format("gate").strip()] + [line.strip()] * 3 + ["Nothing else is said."] * 3),
        "paragraphs": "\n\n".join(f"{line}{line[:20]}it ends." for _ in range(5)),
        "twice": own.format("gate") + own.format("wall") + "And so on, as the keeper of the light told me when I asked.",
    }
    none = spark.createDataFrame([], "doc_id long, source string, text string")
    df = spark.createDataFrame(list(enumerate(texts.values())), "promotion_id long, text string")
    assert [r.text_shape for r in quality.shapes(none, df).orderBy("record_id").collect()] == ["junk", "junk", "junk", "prose"]


def test_long_texts_in_one_pass():
    import time

    from glyphloom.llm.measures import SLICE, measure

    words = [f"w{k % 9973}" for k in range(700_000)]
    began = time.process_time()
    got = measure(["", " ".join(words), "end"])
    assert len(" ".join(words)) > SLICE and got["n_words"].tolist() == [0, 700_000, 1]
    assert time.process_time() - began < 20


def test_measures_do_not_depend_on_neighbours():
    from glyphloom.llm.measures import measure

    texts = [t for ts in TEXTS.values() for t in ts] + ["", "\n\n", ".", " - ", "a,b,c\nd,e,f", "1) one\n2) two"]
    every = measure(texts)
    for k, t in enumerate(texts):
        alone = measure([t])
        assert all(repr(alone[name][0]) == repr(every[name][k]) for name in every), t
