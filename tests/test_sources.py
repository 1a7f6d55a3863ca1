"""Readers, writers, joins under skew and global numbering."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphloom import session as session_module
from glyphloom.operators.exports import export_all, write_csv
from glyphloom.operators.sequential import numbered
from glyphloom.session import if_small, join_hot, materialize
from glyphloom.sources import readers, tables
from tests.conftest import rows


def test_benchmark_json_and_candidate_csv(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"video": "v", "slides": [{"slide_id": "a", "frame_index": 1, "reference_text": "x"}, {"slide_id": "b", "reference_text": None}]}))
    got = readers.benchmark_json(spark, str(tmp_path / "r.json"), "reference_text")
    assert [(r.slide_id, r.text, r.place) for r in got.orderBy("place").collect()] == [("a", "x", 0), ("b", None, 1)]
    assert readers.missing_fields(got).count() == 1
    out = spark.createDataFrame([(1, "BODY", "one"), (1, "BODY", 'two "q"\nline'), (2, "TITLE", "three")], readers.CANDIDATE_SCHEMA).coalesce(1)
    write_csv(out, str(tmp_path / "c"))
    assert rows(readers.candidate_csv(spark, str(tmp_path / "c"))) == [(1, 'one\ntwo "q"\nline'), (2, "three")]


def test_exports_refuse_unknown_formats_and_overwriting(spark, tmp_path):
    df = spark.range(3)
    with pytest.raises(ValueError):
        export_all(df, str(tmp_path / "e"), ["csv", "docx"])
    assert not (tmp_path / "e").exists()
    paths = export_all(df, str(tmp_path / "e"), ["csv", "parquet", "json"])
    assert spark.read.parquet(paths["parquet"]).count() == 3
    with pytest.raises(Exception, match="(?i)exist"):
        export_all(df, str(tmp_path / "e"), ["parquet"])


def test_latest_delivery(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", None), (2, "c", None), (None, "d", 5)], "k int, v string, t int")
    assert rows(tables.latest(df, "k", "t").select("k", "v")) == [(1, "b"), (2, "c")]
    assert tables.latest(df.limit(0), "k", "t").count() == 0


def test_hot_keys_are_salted_and_nothing_is_lost(spark, monkeypatch):
    monkeypatch.setattr(session_module, "ROWS_PER_SALT", 50)
    fact = spark.range(1000).select(F.when(F.col("id") < 400, "hot").when(F.col("id") < 990, F.col("id").cast("string")).alias("k"), "id")
    dim = materialize(fact.filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m")))
    got = join_hot(fact, dim, "k", "n")
    assert got.count() == 1000 and got.filter("k = 'hot' AND m = 399").count() == 400 and got.filter("m IS NULL").count() == 10
    assert join_hot(fact, dim.limit(0), "k", "n").count() == 1000


def test_numbering_and_small_tables(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("v"))
    got = numbered(df, ["v"])
    assert got.filter("v + 1 <> place").count() == 0 and got.count() == 1000
    assert if_small(df, 10).count() == 1000


def test_entry_works_without_the_llm_folder(spark, folder):
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['glyphloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'doc_confidence_stats' in q and not any(n.startswith('p1_') for n in q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])


def test_frame_manifests_are_strict(spark, tmp_path):
    def manifest(name, frames, version=1):
        (tmp_path / name).write_text(json.dumps({"schema_version": version, "frames": frames}))
        return str(tmp_path / name)

    frame = {"frame_id": "b", "image": "b.png", "reference_text": "x", "selection_reason": "why", "layout_categories": ["title"], "notes": "n"}
    other = {**frame, "frame_id": "a", "image": "sub/a.png"}
    del other["notes"]
    got = readers.frame_manifest(spark, manifest("good.json", [frame, other]), readers.LAYOUTS)
    assert [(r.frame_id, r.image, r.notes) for r in got.collect()] == [("a", f"{tmp_path}/sub/a.png", ""), ("b", f"{tmp_path}/b.png", "n")]
    bad = [([frame], 2), ([frame, frame], 1), ([{**frame, "reference_text": ""}], 1), ([{**frame, "layout_categories": None}], 1), ([{**frame, "layout_categories": ["odd"]}], 1)]
    for k, (frames, version) in enumerate(bad):
        with pytest.raises(ValueError):
            readers.frame_manifest(spark, manifest(f"bad{k}.json", frames, version), readers.LAYOUTS)
    assert readers.frame_manifest(spark, manifest("free.json", bad[-1][0])).count() == 1


def test_visual_cases_are_strict(spark, tmp_path):
    case = {f: None for f in readers.CASE_FIELDS} | {"schema_version": 1, "case_id": "one", "image": "a.png"}

    def folder(name, **files):
        (tmp_path / name).mkdir()
        for file, text in files.items():
            (tmp_path / name / f"{file}.json").write_text(text if isinstance(text, str) else json.dumps(text))
        return str(tmp_path / name)

    good = folder("good", B=case, a={**case, "case_id": "two"})
    assert [(r.file, r.case_id) for r in readers.visual_cases(spark, good).collect()] == [("a.json", "two"), ("B.json", "one")]
    less = dict(case)
    del less["notes"]
    for k, text in enumerate(["{", json.dumps(case)[:-1] + ', "notes": 1}', json.dumps(less), json.dumps({**case, "more": 1}), json.dumps({**case, "notes": float("nan")}), {**case, "image": "../a.png"}, {**case, "schema_version": 2}, "[]"]):
        with pytest.raises(ValueError):
            readers.visual_cases(spark, folder(f"bad{k}", a=text, b={**case, "case_id": "b"}))
    with pytest.raises(ValueError):
        readers.visual_cases(spark, folder("twice", a=case, b=case))


def test_videos_of_a_folder(spark, tmp_path):
    for name in ("b.MP4", "A.mov", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    got = readers.videos_in_folder(spark, str(tmp_path))
    assert [r.path.rpartition("/")[2] for r in got.orderBy("place").collect()] == ["A.mov", "b.MP4"]
    with pytest.raises(ValueError):
        readers.videos_in_folder(spark, str(tmp_path / "c.txt"))


def test_providers_by_name():
    from glyphloom.operators import translation

    translation.register_provider(" Some-Provider ", lambda: lambda text, language: text)
    assert translation.provider_factory("some-provider")()("x", "de") == "x"
    for name in ("some-provider", "9x", "a b", ""):
        with pytest.raises(ValueError):
            translation.register_provider(name, lambda: None)
    with pytest.raises(ValueError):
        translation.provider_factory("none")


def test_small_tables_by_rows_and_bytes(spark):
    df = spark.range(100).select(F.repeat(F.lit("x"), 1000).alias("t"))
    plan = lambda d: d._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(if_small(df)) and "broadcast" not in plan(if_small(df, size=50_000)) and "broadcast" not in plan(if_small(df, rows=99))


def test_no_folder_of_one_machine_on_a_cluster():
    class Unset:
        def get(self, name, default=None):
            return default

    class Cluster:
        master = "spark://host:7077"

        def getConf(self):
            return Unset()

    class Session:
        conf, sparkContext = Unset(), Cluster()

    with pytest.raises(ValueError):
        session_module.shared_folder(Session())


def three_a_second(path):
    if "bad" in path:
        raise OSError("no stream")
    return 3.0, iter(np.load(path))


def test_videos_as_a_source(spark, tmp_path):
    from glyphloom.sources.video import SCHEMA, VideoFrames, VideoReader

    spark.dataSource.register(VideoFrames)
    np.save(tmp_path / "b.npy", np.arange(24, dtype=np.uint8).reshape(2, 3, 4))
    np.save(tmp_path / "A.npy", np.zeros((1, 1, 2), np.uint8))
    got = spark.read.format("video_frames").load(str(tmp_path)).orderBy("path", "frame_number").collect()
    assert [(r.path.rpartition("/")[2], r.frame_number, r.timestamp_seconds, r.height, r.width) for r in got] == [("A.npy", 0, 0.0, 1, 2), ("b.npy", 0, 0.0, 3, 4), ("b.npy", 1, 1.0, 3, 4)]
    assert got[2].image == list(range(12, 24)) and len(got[0]) == len(SCHEMA.split(","))
    reader = VideoReader({"path": str(tmp_path), "decoder": f"{__name__}:three_a_second"})
    assert [r[2] for r in reader.read(reader.partitions()[1])] == [0.0, 1 / 3]
    np.save(tmp_path / "bad.npy", np.zeros((1, 1, 1), np.uint8))
    with pytest.raises(ValueError, match="bad.npy cannot be read"):
        list(reader.read(reader.partitions()[2]))
    with pytest.raises(ValueError, match="no videos"):
        VideoReader({"path": str(tmp_path / "none")}).partitions()
