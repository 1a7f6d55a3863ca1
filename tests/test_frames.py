"""The frame scan: literal videos of constant images, in batch and as a stream."""

import numpy as np
import pytest

from glyphloom.operators.frames import FrameSelector, select_frames
from glyphloom.streaming.frames import select_frames_stream


def scan(values, fps=5.0):
    s, out = FrameSelector(fps), []
    for n, v in enumerate(values):
        out += s.feed(n, np.full(4, float(v)))
    out += s.finish()
    return [values[n] for n, _, _ in out]


# Our own videos at five frames a second: (grey levels, those that are saved).
TALK = [30] * 40 + [200] * 9 + [60] * 31
CASES = {
    "three scenes": (TALK, [30, 200, 60]),
    "small steps wait for the still time": ([12] * 10 + [15] * 10 + [18] * 20, [12, 18]),
    "steps end a change late": ([40] * 8 + [90, 140, 190] + [230] * 7, [40, 230]),
    "flicker is never saved": ([50] * 8 + [150, 20] * 6, [50]),
    "drift at the end": ([80] * 8 + [82 + 2 * k for k in range(12)], [80]),
    "a black scene": ([70] * 12 + [0] * 12, [70]),
    "black first": ([0] * 4 + [90] * 8, [0, 90]),
    "no time to rest": ([5, 100, 200], [5]),
    "alone": ([33], [33]),
    "nothing": ([], []),
}


@pytest.mark.parametrize("name", CASES)
def test_scan(name):
    values, expected = CASES[name]
    assert scan(values) == expected


def test_batch_equals_scan_and_skips_missing_images(spark):
    values = TALK
    data = [("v", n, [float(v)] * 4) for n, v in enumerate(values)] + [("w", 0, [1.0]), ("w", 1, None)]
    df = spark.createDataFrame(data, "video_id string, frame_number long, image array<double>")
    got = select_frames(df, 5.0).orderBy("video_id", "frame_number").collect()
    assert [values[r.frame_number] for r in got if r.video_id == "v"] == scan(TALK)
    assert [r.frame_number for r in got if r.video_id == "w"] == [0]


def test_stream_equals_batch(spark, tmp_path):
    values = TALK
    schema = "video_id string, frame_number long, image array<double>, last boolean"
    for part in range(3):
        piece = range(part * 27, min(len(values), (part + 1) * 27))
        data = [("v", n, [float(values[n])] * 4, n == len(values) - 1) for n in piece]
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = select_frames_stream(feed, 5.0).writeStream.format("memory").queryName("picked").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(values[r.frame_number] for r in spark.sql("SELECT * FROM picked").collect()) == sorted(scan(TALK))
