"""Videos as a Spark data source: one task per file, frames decoded by an injected function, so that no decoder is part of the library."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import unquote, urlparse

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: ``(frames per second, images)``; an image is grey (height, width) or has its colours last.
Decoder = Callable[[str], tuple[float, Iterator[np.ndarray]]]
SCHEMA = "path string, frame_number long, timestamp_seconds double, height int, width int, image array<int>"


def stacked_arrays(path: str) -> tuple[float, Iterator[np.ndarray]]:
    """The decoder where none is named: a ``.npy`` file of (frames, height, width), read frame by frame; one frame a second."""
    return 1.0, iter(np.load(path, mmap_mode="r"))


class Video(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class VideoReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options.get("path", "")
        self.decoder = options.get("decoder", f"{__name__}:stacked_arrays")
        self.endings = tuple(options.get("endings", ".npy").lower().split(","))

    def partitions(self) -> list[Video]:
        place = Path(unquote(urlparse(self.folder).path) if self.folder.startswith("file:") else self.folder)
        found = [place] if place.is_file() else sorted((p for p in place.glob("*") if p.suffix.lower() in self.endings), key=lambda p: p.name.lower())
        if not found:
            raise ValueError(f"no videos in {self.folder}")
        return [Video(str(p)) for p in found]

    def read(self, partition: Video) -> Iterator[tuple]:
        module, _, name = self.decoder.partition(":")
        try:
            fps, images = getattr(importlib.import_module(module), name)(partition.path)
        except Exception as failure:
            raise ValueError(f"{partition.path} cannot be read as a video: {failure}") from failure
        if not fps > 0:
            raise ValueError(f"{partition.path} has no frame rate")
        for number, image in enumerate(images):
            height, width = image.shape[:2]
            yield partition.path, number, number / fps, int(height), int(width), np.asarray(image).ravel().astype(int).tolist()


class VideoFrames(DataSource):
    """``spark.dataSource.register(VideoFrames)``, then ``spark.read.format("video_frames").option("decoder", "module:function").load(folder)``.

    The folder must be one that all executors see. Options: ``decoder`` (see ``Decoder``) and ``endings``, by commas. A video that cannot be read fails its task with its path.
    """

    @classmethod
    def name(cls) -> str:
        return "video_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VideoReader:
        return VideoReader(self.options)
