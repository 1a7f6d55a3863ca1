"""Folders of runs and their stages, and small files on the driver. Datasets themselves are read and written by Spark."""

from __future__ import annotations

import os
import re
import shutil
import string
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# The stages whose results can be started from again, in order, with their dataset names.
STAGES = {"frames": "candidate_frames", "regions": "ocr_results", "lines": "reading_order", "slides": "presentation"}


def new_folder(parent: str | Path, stem: str) -> Path:
    """A folder of its own: ``stem``, else ``stem_2``, ``stem_3``… whichever is free; it is made, so that no other run can take it."""
    k = 1
    while True:
        folder = Path(parent) / (stem if k == 1 else f"{stem}_{k}")
        try:
            folder.mkdir(parents=True)
        except FileExistsError:
            k += 1
        else:
            return folder


def replay_folder(run: str | Path) -> Path:
    """A folder beside a run for what is made from one of its stages again; the replay of a replay stays beside the first run."""
    run = Path(run)
    return new_folder(run.parent, re.sub(r"_replay(?:_\d+)?$", "", run.name) + "_replay")


def stage_dataset(run: str | Path, stage: str) -> str:
    """The dataset of a stage in a run's folder; a path to the dataset itself stands for itself."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}; known are {', '.join(STAGES)}")
    run = Path(run)
    dataset = run if run.name == f"{STAGES[stage]}.parquet" else run / f"{STAGES[stage]}.parquet"
    if not dataset.exists():
        raise FileNotFoundError(f"{dataset} has not been written")
    return str(dataset)


def write_stage(df: DataFrame, run: str | Path, stage: str) -> str:
    """Write what a stage has made to its dataset in the run's folder, where it can be started from again; a dataset that is there is left alone and refused."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}; known are {', '.join(STAGES)}")
    dataset = f"{run}/{STAGES[stage]}.parquet"
    df.write.mode("errorifexists").parquet(dataset)
    return dataset


def read_stage(spark: SparkSession, run: str | Path, stage: str) -> DataFrame:
    """What a stage has made, from a run's folder or the dataset itself."""
    return spark.read.parquet(stage_dataset(run, stage))


def stages_after(stage: str) -> list[str]:
    """The stages that still have to run when ``stage`` is read back."""
    names = list(STAGES)
    return names[names.index(stage) + 1 :]


def replace_file(path: str | Path, text: str) -> Path | None:
    """Write a small file whole or not at all; what was there is kept beside it, and its place is returned."""
    path = Path(path)
    backup = None
    if path.exists():
        backup = path.with_suffix(path.suffix + ".bak")
        shutil.copy2(path, backup)
    part = path.with_suffix(path.suffix + ".part")
    part.write_text(text, encoding="utf-8")
    os.replace(part, path)
    return backup


def unknown_placeholders(template: str, allowed: list[str]) -> list[str]:
    """The placeholders of a name template that are not allowed; attributes, indices and empty names are never."""
    return [name for _, name, _, _ in string.Formatter().parse(template) if name is not None and name not in allowed]
