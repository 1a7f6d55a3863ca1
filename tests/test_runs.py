"""Folders, stages, small files and templates; and what has been written to cut lineage."""

import pytest

from glyphloom.session import materialize, release, shared_folder
from glyphloom.sources import runs


def test_folders_are_unique(tmp_path):
    names = [runs.new_folder(tmp_path, "talk").name for _ in range(3)]
    assert names == ["talk", "talk_2", "talk_3"]
    again = runs.replay_folder(tmp_path / "talk")
    assert again.name == "talk_replay" and runs.replay_folder(again).name == "talk_replay_2"


def test_stages(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "ocr_results.parquet"))
    assert runs.stage_dataset(tmp_path, "regions") == runs.stage_dataset(tmp_path / "ocr_results.parquet", "regions") == str(tmp_path / "ocr_results.parquet")
    assert runs.stages_after("regions") == ["lines", "slides"]
    with pytest.raises(FileNotFoundError):
        runs.stage_dataset(tmp_path, "frames")
    runs.write_stage(spark.range(4), tmp_path, "lines")
    assert runs.read_stage(spark, tmp_path, "lines").count() == 4
    for again in (("lines", "(?i)exist"), ("other", "unknown stage")):
        with pytest.raises(Exception, match=again[1]):
            runs.write_stage(spark.range(4), tmp_path, again[0])
    with pytest.raises(ValueError, match="unknown stage"):
        runs.stage_dataset(tmp_path, "video")


def test_files_and_templates(tmp_path):
    f = tmp_path / "truth.json"
    assert runs.replace_file(f, "one") is None
    assert runs.replace_file(f, "two").read_text() == "one" and f.read_text() == "two"
    assert runs.unknown_placeholders("{batch}-{language}", ["batch", "language"]) == []
    assert runs.unknown_placeholders("{batch.x} {0} {}", ["batch"]) == ["batch.x", "0", ""]


def test_written_tables_can_be_released(spark):
    df = materialize(spark.range(5))
    assert df.count() == 5 and shared_folder(spark)
    release(spark)
    with pytest.raises(Exception, match="(?i)exist|not found"):
        spark.read.parquet(df.inputFiles()[0]).count()
