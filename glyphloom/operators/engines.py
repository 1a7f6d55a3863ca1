"""Recognition engines as injected callables, their pages as regions, and batches in which a failing source is a row."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an engine gives for one image: texts, confidences, and boxes of left, top, right and bottom.
Page = tuple[Sequence[str], Sequence[float], Sequence[Sequence[float]]]
Engine = Callable[[object], Page]
_FACTORIES: dict[str, Callable[[], Engine]] = {}


def register_engine(name: str, factory: Callable[[], Engine]) -> None:
    """Make an engine known by name; ``factory`` is called once in each Python worker that needs it."""
    _FACTORIES[name] = factory


def engine_names() -> tuple[str, ...]:
    return tuple(sorted(_FACTORIES))


def engine_factory(name: str) -> Callable[[], Engine]:
    if name not in _FACTORIES:
        raise ValueError(f"unknown engine: {name}; there are " + (", ".join(engine_names()) or "none"))
    return _FACTORIES[name]


PAGES = "texts array<string>, scores array<double>, boxes array<array<double>>, error string"


def recognised_pages(frames: DataFrame, factory: Callable[[], Engine], image: str = "image") -> DataFrame:
    """``frames`` without ``image`` and with the page that the engine gives for each; a frame on which it fails has the error alone, and a frame without an image an empty page."""
    kept = [f for f in frames.columns if f != image]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema.fields if f.name != image) + ", " + PAGES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = factory()
        for batch in batches:
            pages = []
            for shown in batch[image]:
                try:
                    texts, scores, boxes = engine(shown) if shown is not None else ([], [], [])
                    pages.append(([str(t) for t in texts], [float(s) for s in scores], [[float(x) for x in b] for b in boxes], None))
                except Exception as failure:  # noqa: BLE001 - a failing frame is its row's
                    pages.append((None, None, None, f"{type(failure).__name__}: {failure}"))
            found = pd.DataFrame(pages, columns=["texts", "scores", "boxes", "error"], index=batch.index)
            yield pd.concat([batch[kept], found], axis=1)

    return frames.mapInPandas(run, schema)


def page_error(texts: Column, scores: Column, boxes: Column) -> Column:
    """What is wrong with a page, the first of: counts that differ, a confidence that is not finite, a box that is not four numbers, or not in order; else null."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    four = lambda b: b.isNotNull() & (F.size(b) == 4) & ~F.exists(b, lambda x: x.isNull())
    ordered = lambda b: (F.try_element_at(b, F.lit(1)) <= F.try_element_at(b, F.lit(3))) & (F.try_element_at(b, F.lit(2)) <= F.try_element_at(b, F.lit(4)))
    return (
        F.when((F.size(texts) != F.size(scores)) | (F.size(texts) != F.size(boxes)), "inconsistent counts")
        .when(F.exists(scores, lambda c: ~finite(c)), "confidence is not finite")
        .when(F.exists(boxes, lambda b: ~four(b)), "box is not four numbers")
        .when(F.exists(boxes, lambda b: ~ordered(b)), "box is not ordered")
    )


def page_regions(pages: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, position, text, confidence, box, error``: a row per region in the engine's order; a page with an error is one row with it. These rows are the raw regions, whatever is filtered from them later."""
    checked = pages.withColumn("error", F.coalesce("error", page_error(F.col("texts"), F.col("scores"), F.col("boxes"))))
    each = F.when(F.col("error").isNull(), F.arrays_zip(F.col("texts").alias("text"), F.col("scores").alias("confidence"), F.col("boxes").alias("box")))
    shown = checked.filter("error IS NULL").select(*keys, F.posexplode(each).alias("position", "r")).select(*keys, "position", "r.text", "r.confidence", "r.box", F.lit(None).cast("string").alias("error"))
    nothing = [F.lit(None).cast(shown.schema[c].dataType).alias(c) for c in ("position", "text", "confidence", "box")]
    return shown.unionByName(checked.filter("error IS NOT NULL").select(*keys, *nothing, "error"))


def recognise(frames: DataFrame, factory: Callable[[], Engine], keys: list[str], image: str = "image") -> DataFrame:
    """The regions of every frame by an injected engine; see ``page_regions``."""
    return page_regions(recognised_pages(frames.select(*keys, image), factory, image), keys)


def run_batch(sources: DataFrame, process: Callable[[str], str], source: str = "source") -> DataFrame:
    """``sources`` with ``success, detail, error, seconds``: each source is processed by itself, and one that fails stays a row with its error. Rows are spread over tasks by a hash."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sources.schema.fields) + ", success boolean, detail string, error string, seconds double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for item in batch[source]:
                began = time.monotonic()
                try:
                    out.append((True, process(item), None))
                except Exception as failure:  # noqa: BLE001 - a failing source is its row's
                    out.append((False, None, f"{type(failure).__name__}: {failure}"))
                out[-1] += (max(0.0, time.monotonic() - began),)
            found = pd.DataFrame(out, columns=["success", "detail", "error", "seconds"], index=batch.index)
            yield pd.concat([batch, found], axis=1)

    return sources.repartition(source).mapInPandas(run, schema)


def batch_log(outcomes: DataFrame, source: str = "source") -> Column:
    """The lines of the log about one source."""
    head = F.concat(F.lit("Video: "), F.col(source))
    good, bad = (head, F.lit("Status: Success"), F.concat(F.lit("Output workspace: "), "detail")), (head, F.lit("Status: Failed"), F.concat(F.lit("Error: "), "error"))
    return F.when(F.col("success"), F.array(*good)).otherwise(F.array(*bad))


def batch_summary(outcomes: DataFrame) -> DataFrame:
    """One row: how many sources there were, were completed and failed."""
    return outcomes.agg(F.count("*").alias("selected"), F.count_if("success").alias("completed"), F.count_if(~F.col("success")).alias("failed"))
