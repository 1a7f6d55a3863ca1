"""Selecting the frames of a video that show something new, and comparing frames."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.functions.text import filled_lines, normalise
from glyphloom.operators.sequential import per_group

#: The mean difference from which a frame counts as changed, the longest still time in seconds, and the quiet frames that end a change.
THRESHOLD, STILL_SECONDS, QUIET = 10.0, 5.0, 5


def difference(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.abs(a.astype(np.float64) - b.astype(np.float64)).mean()) if a.shape == b.shape and a.size else float("inf")


@dataclass
class FrameSelector:
    """The state of one video's scan: feed frames in order, then finish. All of it can be stored between batches of a stream."""

    fps: float
    threshold: float = THRESHOLD
    previous: np.ndarray | None = None
    saved: np.ndarray | None = None
    last_saved: int = 0
    changing: bool = False
    quiet: int = 0
    pending: tuple[int, np.ndarray, float] | None = None
    window: deque = field(default_factory=lambda: deque(maxlen=QUIET + 1))
    seen: int = 0

    def _save(self, number: int, image: np.ndarray, score: float, black: bool = False) -> list[tuple[int, float, float]]:
        """Save a frame unless it is all black or equal to the last saved one."""
        if (not black and not (image > 0).any()) or (self.saved is not None and np.array_equal(self.saved, image)):
            return []
        self.saved = image
        return [(number, number / self.fps, score)]

    def feed(self, number: int, image: np.ndarray) -> list[tuple[int, float, float]]:
        self.seen += 1
        if self.previous is None:
            self.previous = image
            self.window.append((number, image))
            return self._save(number, image, 0.0, black=True)
        score = difference(self.previous, image)
        self.previous = image
        out: list[tuple[int, float, float]] = []
        if score >= self.threshold:
            self.window.clear()
            self.changing, self.quiet, self.pending = True, 0, (number, image, score)
        elif self.changing:
            self.quiet += 1
            if self.quiet >= QUIET:
                out = self._save(*self.pending)
                if out:
                    self.last_saved = self.pending[0]
                self.changing, self.quiet = False, 0
        elif (number - self.last_saved) / self.fps >= STILL_SECONDS:
            out = self._save(number, image, score)
            if out:
                self.last_saved = number
        self.window.append((number, image))
        return out

    def finish(self) -> list[tuple[int, float, float]]:
        """At the end the last quiet frame is saved, if nothing is changing and the quiet window did not drift."""
        if self.changing or len(self.window) <= QUIET or difference(self.window[0][1], self.window[-1][1]) >= self.threshold:
            return []
        number, image = self.window[-1]
        return self._save(number, image, difference(self.saved, image) if self.saved is not None else 0.0)


#: The state of a scan as typed columns.
STORED = (
    "previous array<double>, saved array<double>, last_saved long, changing boolean, quiet int, pending_number long, pending_image array<double>, pending_score double, "
    "window_numbers array<long>, window_images array<array<double>>, seen long"
)


def stored(scan: FrameSelector) -> tuple:
    """The values of ``STORED``; images are flat arrays of one size."""
    flat = lambda image: None if image is None else [float(x) for x in image]
    number, image, score = scan.pending or (None, None, None)
    return (flat(scan.previous), flat(scan.saved), scan.last_saved, scan.changing, scan.quiet, number, flat(image), score, [int(n) for n, _ in scan.window], [flat(i) for _, i in scan.window], scan.seen)


def restored(values: tuple, fps: float, threshold: float) -> FrameSelector:
    """The scan that ``stored`` took apart."""
    array = lambda v: None if v is None else np.asarray(v, dtype=np.float64)
    previous, saved, last_saved, changing, quiet, number, image, score, numbers, images, seen = values
    pending = None if number is None else (int(number), array(image), float(score))
    scan = FrameSelector(fps, threshold, array(previous), array(saved), int(last_saved), bool(changing), int(quiet), pending, seen=int(seen))
    scan.window.extend((int(n), array(i)) for n, i in zip(numbers, images))
    return scan


SELECTED = "video_id string, frame_number long, timestamp double, difference_score double"


def select_frames(frames: DataFrame, fps: float, threshold: float = THRESHOLD) -> DataFrame:
    """The candidate frames of each video. ``frames`` has ``video_id, frame_number, image array``; frames without an image are skipped."""

    def algorithm(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        scan = FrameSelector(fps, threshold)
        for _, number, image in rows:
            for hit in scan.feed(number, np.asarray(image, dtype=np.float64)):
                yield (key[0], *hit)
        for hit in scan.finish():
            yield (key[0], *hit)

    own = frames.filter(F.col("image").isNotNull()).select("video_id", "frame_number", "image")
    return per_group(own, ["video_id"], ["frame_number"], algorithm, SELECTED)


def array_difference(a: Column, b: Column) -> Column:
    """The mean absolute difference of two arrays of equal length, in the JVM; null if they differ in length or are empty."""
    gap = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, d: s + d)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), gap / F.size(a))


def consecutive_differences(frames: DataFrame, video: str, order: str, image: str) -> DataFrame:
    """Each frame with its difference from the one before in its video (null for the first)."""
    before = F.lag(image).over(Window.partitionBy(video).orderBy(order))
    return frames.withColumn("difference", array_difference(F.col(image), before))


def is_visible(image: Column) -> Column:
    return F.exists(image, lambda p: p > 0)


def default_frames(frames: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Of each slide the last frame, and earlier ones that differ from every retained one. ``frames`` has ``slide, frame_number, image array``.

    The last frame is known by one aggregation and comes first to its slide's scan, which then holds the retained images alone.
    """

    def algorithm(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        kept: list[np.ndarray] = []
        for _, number, image, _ in rows:
            own = np.asarray(image, dtype=np.float64)
            if all(difference(own, other) >= threshold for other in kept):
                kept.append(own)
                yield (key[0], number)

    own = frames.filter(F.col("image").isNotNull()).select("slide", "frame_number", "image")
    last = own.groupBy("slide").agg(F.max("frame_number").alias("_last"))
    led = own.join(last, "slide").select("slide", "frame_number", "image", F.when(F.col("frame_number") == F.col("_last"), 0).otherwise(1).alias("_rank"))
    return per_group(led, ["slide"], ["_rank", "frame_number"], algorithm, "slide string, frame_number long")


def compare_line_sets(previous: Column, current: Column) -> dict[str, Column]:
    """Shared, added and removed lines (sorted, normalised), their Jaccard similarity, and what follows from them."""
    clean = lambda t: F.array_sort(F.array_distinct(F.transform(filled_lines(F.coalesce(t, F.lit(""))), normalise)))
    a, b = clean(previous), clean(current)
    every = F.size(F.array_union(a, b))
    share = F.when(every == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(every, F.lit(1)))
    return {
        "shared_lines": F.array_sort(F.array_intersect(a, b)),
        "added_lines": F.array_sort(F.array_except(b, a)),
        "removed_lines": F.array_sort(F.array_except(a, b)),
        "similarity": share,
    }
