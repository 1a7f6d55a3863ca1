"""Live feeds: the frame scan as a stateful stream, and windowed counts with late data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glyphloom.operators.frames import SELECTED, STORED, THRESHOLD, FrameSelector, restored, stored


def select_frames_stream(frames: DataFrame, fps: float, threshold: float = THRESHOLD) -> DataFrame:
    """The candidate frames of live videos, by the same scan as ``operators.frames.select_frames``.

    ``frames`` is a stream of ``video_id, frame_number, image array, last boolean``. A video's frames must arrive in order over batches; within a
    batch they are sorted. The row with ``last`` ends its video, so that its last quiet frame is judged; its state is then dropped. The state is one
    frame selector in typed columns: a handful of numbers and up to nine images.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        scan = restored(state.get, fps, threshold) if state.exists else FrameSelector(fps, threshold)
        rows = pd.concat(list(batches)).sort_values("frame_number", kind="stable")
        out, ended = [], False
        for number, image, last in zip(rows["frame_number"], rows["image"], rows["last"]):
            if image is not None:
                out += [(key[0], *hit) for hit in scan.feed(int(number), np.asarray(image, dtype=np.float64))]
            ended |= bool(last)
        if ended:
            out += [(key[0], *hit) for hit in scan.finish()]
            state.remove()
        else:
            state.update(stored(scan))
        yield pd.DataFrame(out, columns=["video_id", "frame_number", "timestamp", "difference_score"])

    return frames.groupBy("video_id").applyInPandasWithState(step, SELECTED, STORED, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and mean values per window and keys of a stream of events with ``value``; events later than ``late`` are left out."""
    own = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return own.groupBy(F.window(time, width).alias("window"), *keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
