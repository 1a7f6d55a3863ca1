"""Decoding, furniture and paragraphs of scanned pages."""

from glyphloom.llm import scans
from tests.conftest import rows

WORDS = "another every mirror memory camera the of this that measures archive modern rapid hand-written full-screen longer narrow column reader through internal follows bridge café".split()
LEXICON = scans.Lexicon({w: 500 for w in WORDS} | {"kovom": 40, "step-by-step": 300}, 100_000)


FORMS = ["the @ papers", "@ reader , volume two", "chapter # @ and @", "@ @ handbook", "© # @ learning . all rights reserved .", "www . @ - @ . example / watch ? v = #"]
FURNITURE = scans.Furniture(FORMS)


def decoded(lexicon, text):
    out, at = [], 0
    for a, b, word, _ in scans.noise(lexicon, text)[2]:
        out += [text[at:a], word]
        at = b
    return "".join(out) + text[at:]


def labels(text, before="", after=""):
    return scans.noise(LEXICON, text, before, after)[:2]


def test_broken_words_and_own_hyphens():
    assert labels("every cam-\nera") == (True, False)
    assert labels("every ano¬\nther mirror") == (True, False)
    assert labels("a hand-\nwritten archive") == (False, False)
    assert labels("this step-\nby-step mirror") == (False, False)
    assert labels("this ano-", after="ther") == (True, False)
    assert labels("this hand-", after="written") == (False, False)
    assert labels("this hand-") == (False, False)
    assert labels("this Pemo-", after="gand") == (True, False)
    assert labels("that - one") == (False, False)
    assert labels("ther mirror", before="ano") == (False, False)


def test_misread_characters():
    for text in ("every rnirror", "every mirr0r", "the 1onger one", "internaI column", "narrovv column", "ancther c0lumn", "rapicl mem-\nory", "the brid9e", "Korom and Kovorn"):
        assert labels(text)[1], text
    for text in ("every mirror", "Kovom", "mp3 and H2O", "Q1 42%", "2021", "unknownword here", "", "...", "café"):
        assert not labels(text)[1], text
    # The misread character of a word in two regions counts where it stands.
    assert labels("this rnir-", after="ror") == (True, True)
    assert labels("ory", before="rnem") == (False, False)


def test_furniture_by_form_and_template():
    for line in ("Page 33", "p. 40", "- 10 -", "[44]", "42 / 188", "7", "The Zusasask Papers", "NOTOVAL READER, VOLUME TWO", "Chapter 4 Makofith and Golun", "346   Sebevar Tovanask Handbook", "© 2020 Dadel Learning. All rights reserved."):
        assert line in FURNITURE, line
    for line in ("2021", "Maboth Catalogue", "The Fragile Reader", "Reader and Deludol", "The Stable Treatment", "of 363).", "within 37 minutes.", "The reader records the handbook.", "5 mg", "", "54 %", "Q1", "Please visit www.example.org for the data set", "We subscribe to the papers."):
        assert line not in FURNITURE, line
    assert "Page 3" in scans.Furniture() and "The Zusasask Papers" not in scans.Furniture()


def test_templates_are_learned(spark):
    names = "Vokisk Borika Tadel Mopen Sarul Debex Kovar Lumen".split()
    lines = [(f"v{k % 5}", f"{n} Weekly, issue {k}") for k, n in enumerate(names)] + [(f"v{k}", "A Line of one Kind") for k in range(5)] + [("v1", f"The {n} only here") for n in names] + [(None, "Nobody Weekly")]
    df = spark.createDataFrame(lines, "video_id string, line string")
    got = scans.learned_templates(df.filter("video_id IS NOT NULL"))
    assert got == ["@ weekly , issue #"] and scans.learned_templates(df.limit(0)) == []
    numbers = spark.createDataFrame([("v", "12   The Head\nbody text\nThe Head 13\n  7\n1 no head"), (None, "x 1"), ("v", None)], "video_id string, text string")
    assert rows(scans.numbered_lines(numbers)) == [("v", "The Head"), ("v", "The Head")]


def test_one_path_for_all_kinds_of_noise():
    words = "the lecture begins another every mirror memory of this that".split()
    lexicon = scans.Lexicon({w: 5000 for w in words} | {"donaudampfschifffahrtsgesellschaft": 5000}, 200_000)
    for text, whole in {
        "thelecture": "the lecture",
        "thelecturebegins": "the lecture begins",
        "le ctu re": "lecture",
        "the1ecture": "the lecture",
        "donaudarnpfschifffahrtsgese1lschaft": "donaudampfschifffahrtsgesellschaft",
        "every thelec-\nturebegins of this": "every the lecture begins of this",
        "an0 ther rnirr0r": "another mirror",
        "every mirror of this": "every mirror of this",
    }.items():
        assert decoded(lexicon, text) == whole


def test_decoding_by_brute_force():
    import itertools
    import math
    import random

    words = {"ab": 900, "abc": 500, "cab": 700, "bca": 400, "lo": 800, "ilo": 300}
    lexicon = scans.Lexicon(words, 10_000)
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice(list(words)) for _ in range(rng.randrange(2, 4)))
        if text in words or lexicon.read(text)[2]:
            continue
        best = math.inf
        for n in range(1, 6):
            for cut in itertools.combinations(range(1, len(text)), n - 1):
                parts = [text[a:b] for a, b in zip((0, *cut), (*cut, len(text)))]
                if all(p in words for p in parts):
                    best = min(best, sum(lexicon.cost(p) for p in parts) + scans.SPLIT * (n - 1))
        whole = lexicon.read(text)[0]
        steps = lexicon.decode([(text, "")])
        got = sum(lexicon.cost(s.text) for s in steps) + scans.SPLIT * (len(steps) - 1) if len(steps) > 1 else whole
        assert not any(s.confused for s in steps) and abs(got - min(best, whole)) < 1e-9


def test_long_tokens_take_time_in_proportion():
    import time

    began = time.process_time()
    assert labels("x1" * 50_000) == (False, False)
    assert time.process_time() - began < 10


def test_repair_joins_lines_and_parts_paragraphs():
    text = "Every mirror measures this ano-\nther archive. This rnirror follows\nPage 12\nthe narrow column through the\narchive.\n\nEvery hand-\nwritten archive"
    assert scans.repaired(LEXICON, FURNITURE, text) == ["Every mirror measures this another archive. This mirror follows the narrow column through the archive.", "Every hand-written archive"]
    assert scans.repaired(LEXICON, FURNITURE, "") == []
    assert scans.boundaries(["One full line of the text here.", "Short end.", "Next one starts here and goes on"]) == [["One full line of the text here.", "Short end."], ["Next one starts here and goes on"]]


def test_paragraphs_of_any_length():
    lines = [f"line {k} goes on without an end and" for k in range(150)]
    assert scans.boundaries(lines) == [lines]
    assert scans.repaired(LEXICON, FURNITURE, "Please visit www.example.org for the data set") == ["Please visit www.example.org for the data set"]


def test_boundaries_by_brute_force():
    import random

    rng = random.Random(6)
    for _ in range(30):
        lines = [rng.choice(["Begins here and goes on for a while", "goes on for a while", "It ends.", "and ends here at last."]) for _ in range(rng.randrange(1, 10))]
        old, scans.LONG = scans.LONG, 2
        try:
            got, price = scans.boundaries(lines), cost_of(lines)
            want = min(price([k for k in range(1, len(lines)) if mask >> k & 1]) for mask in range(0, 1 << len(lines), 2))
            cuts = [sum(map(len, got[:k])) for k in range(1, len(got))]
            assert abs(price(cuts) - want) < 1e-9
        finally:
            scans.LONG = old


def cost_of(lines):
    width = sorted(len(x.strip()) for x in lines)[len(lines) * 3 // 4]

    def price(cuts):
        total, edges = 0.0, [0, *cuts, len(lines)]
        for k in cuts:
            a, b = lines[k - 1], lines[k]
            total += 4.0 - 3.0 * a.endswith(".") - 2.0 * (len(a) < 0.6 * width) - 1.0 * b[:1].isupper() + 8.0 * b[:1].islower()
        for a, b in zip(edges, edges[1:]):
            total += 0.5 * (b - a == 1) + scans.FURTHER * max(0, b - a - scans.LONG)
        return total

    return price


def tables(spark):
    box = lambda k, line: [float(k * 100), line * 50.0, k * 100 + 92.0, line * 50 + 30.0]
    regions, n = [], 0
    for frame in range(1, 9):
        name = "abcdefgh"[frame - 1] * 3
        texts = [(f"Every {name}", 0), (f"{name} measures an" + ("o-" if frame == 3 else "other"), 1), (("ther" if frame == 3 else "another") + f" archive {name}", 2), ("Licensed", 3), (f"to Kovom, copy {frame}", 3), (str(frame), 4)]
        at = {}
        for k, (t, line) in enumerate(texts):
            n += 1
            at[line] = at.get(line, 0) + 1
            regions.append((n, "v", frame, k + 1, t, box(at[line] - 1, line), None))
    regions += [(n + 1, "v", None, 1, None, None, None), (n + 2, None, None, None, "another mirror", [1.0], None), (n + 2, None, None, None, "another mirror", [1.0], None)]
    r = spark.createDataFrame(regions, "region_id long, video_id string, frame_id long, source_index int, text string, box array<double>, ingested_at timestamp")
    p = spark.createDataFrame([(1, "every camera measures\nano-\nther archive"), (2, None), (2, None), (3, "Page 3\nevery camera")], "paragraph_id long, text string").selectExpr("paragraph_id", "'v' AS video_id", "text")
    c = spark.createDataFrame([(1, "every camera measures"), (2, ""), (3, None)], "benchmark_id long, candidate_text string").selectExpr("benchmark_id", "'v' AS video_id", "candidate_text")
    return r, p, c


def test_tables(spark):
    r, p, c = tables(spark)
    got = rows(scans.scan_noise(r, p, c))
    assert ("paragraph", 1, "broken_word") in got and ("paragraph", 3, "page_furniture") in got
    assert [x for x in got if x[0] == "region" and x[2] == "broken_word"] == [("region", 14, "broken_word")]
    furniture = {x[1] for x in got if x[0] == "region" and x[2] == "page_furniture"}
    assert {4, 5, 6, 46, 47, 48} <= furniture and not furniture & {1, 2, 3}
    assert not [x for x in got if x[2] == "misread_character"]
    assert scans.scan_noise(r.limit(0), p.limit(0), c.limit(0)).count() == 0
    assert ("paragraph", 3, 1, "every camera") in rows(scans.readable_paragraphs(r, p, c))


def test_frames_become_paragraphs(spark):
    r, p, c = tables(spark)
    got = rows(scans.readable_paragraphs(r.unionByName(r), p, c))
    frames = {x[1]: x[3] for x in got if x[0] == "frame"}
    # The word broken between two regions is whole; licence lines and page numbers are gone, also those that only their repetition gives away.
    assert frames == {k: f"Every {n} {n} measures another {'' if k == 3 else 'another '}archive {n}" for k, n in ((k, "abcdefgh"[k - 1] * 3) for k in range(1, 9))}
    assert [x for x in got if x[0] == "region"] == [("region", 50, 1, "another mirror")]
    assert {x[0] for x in got} == {"frame", "region", "paragraph", "candidate"} and len(got) == len(set(got))
    assert scans.readable_paragraphs(r.limit(0), p.limit(0), c.limit(0)).count() == 0


def test_words_broken_within_a_line_of_regions():
    assert scans.repaired_lines(LEXICON, scans.frame_lines(FURNITURE, ["Every cam-\x1fera measures", "Page\x1f12", " ", "the rnirror"])) == ["Every camera measures the mirror"]
    assert scans.frame_lines(FURNITURE, []) == [] and scans.repaired_lines(LEXICON, []) == []
