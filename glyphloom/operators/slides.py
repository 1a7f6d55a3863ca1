"""Slides and builds from runs of frames, and the best reading of what several frames show."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.functions.similarity import gestalt
from glyphloom.functions.text import is_fragment, is_protected_short, jaccard, normalise, observed_scripts, words
from glyphloom.operators.sequential import CHUNK, ROWS_IN_ORDER, per_group, running, spread, with_previous
from glyphloom.session import materialize

SAME_SLIDE, SAME_PARAGRAPH = 0.60, 0.65


def same_slide(previous: Column, current: Column) -> Column:
    """Whether two normalised texts show one slide: equal, built up from the previous one (an empty one included), or of enough common words."""
    w = lambda t: F.filter(F.array_distinct(F.split(t, " ")), lambda x: x != "")
    alike = jaccard(w(previous), w(current)) >= F.lit(SAME_SLIDE)
    return F.startswith(current, previous) | alike


def slide_runs(frames: DataFrame, video: str = "video_id", order: tuple[str, ...] = ("frame_number",), text: str = "combined_text", counted: DataFrame | None = None, rows: int = ROWS_IN_ORDER) -> DataFrame:
    """Frames with ``slide_number`` (from 1), ``build_index`` (from 0 within the slide) and ``place`` (from 1 within the video).

    A slide ends where a frame's text is not the same slide as the one before; a build where the normalised text changes. Comparing with the frame before is
    exact, as what a slide shows is always its last frame's text. Null texts count as empty. Where a video has more than ``rows`` frames, they are ranged over tasks (see ``spread``).
    """
    keys, by = [video], list(order)
    chunks = spread(frames.withColumn("_norm", normalise(F.coalesce(F.col(text), F.lit("")))), keys, by, counted, rows)
    keep = materialize if CHUNK in chunks.columns else lambda df: df  # what two passes need
    seen = with_previous(chunks, keys, by, "_norm", "_before")
    starts = F.col("_before").isNull() | ~same_slide(F.col("_before"), F.col("_norm"))
    flagged = keep(seen.withColumns({"_slide": F.when(starts, 1).otherwise(0), "_changed": F.when(F.col("_before") != F.col("_norm"), 1).otherwise(0)}))
    summed = running(flagged, keys, by, {"slide_number": F.col("_slide"), "place": F.lit(1), "_builds": F.when(F.col("_slide") == 1, 0).otherwise(F.col("_changed"))})
    # A slide's first frame adds no build, so that the builds of all frames up to it are what those before had.
    led = running(keep(summed), keys, by, {}, {"_lead": F.when(F.col("_slide") == 1, F.col("_builds"))})
    return led.withColumn("build_index", F.col("_builds") - F.col("_lead")).drop("_before", "_slide", "_changed", "_builds", "_lead", CHUNK)


def vote(observations: DataFrame, keys: list[str], order: str, text: str = "text") -> DataFrame:
    """The text seen most often per group, by normalised form; ties go to the longer, then to the first seen. ``observations`` counts equal forms before the shuffle."""
    norm = observations.filter(F.col(text).isNotNull()).withColumn("_norm", normalise(F.col(text)))
    counts = norm.groupBy(*keys, "_norm").agg(F.count("*").alias("seen"), F.min(F.struct(order, text)).alias("_first"))
    best = F.max_by(F.struct("_norm", "seen", "_first"), F.struct("seen", F.length("_norm").alias("n"), (-F.col(f"_first.{order}")).alias("o")))
    return counts.groupBy(*keys).agg(best.alias("b"), F.count("*").alias("variants")).select(*keys, F.col(f"b._first.{text}").alias("best_text"), F.col("b.seen").alias("votes"), "variants")


class Cluster:
    """Observations of one paragraph, with its best reading at hand."""

    def __init__(self, kind: str, norm: str, key: tuple[int, int], text: str, *evidence) -> None:
        self.kind = kind
        self.counts: dict[str, int] = {}
        self.first: dict[str, tuple] = {}
        self.best = norm
        self.add(norm, key, text, *evidence)

    def add(self, norm: str, key: tuple[int, int], text: str, *evidence) -> None:
        self.counts[norm] = self.counts.get(norm, 0) + 1
        self.first.setdefault(norm, (key, text, *evidence))
        chain = sorted(self.counts, key=len)
        if len(chain) > 1 and all(len(a) < len(b) and b.startswith(a) for a, b in zip(chain, chain[1:])):
            self.best = chain[-1]
        else:
            order = {n: k for k, n in enumerate(self.counts)}
            self.best = max(self.counts, key=lambda n: (self.counts[n], len(n), -order[n]))

    def takes(self, kind: str, norm: str) -> bool:
        if kind != self.kind:
            return False
        a = self.best
        if a == norm or norm.startswith(a) or a.startswith(norm):
            return True
        # The ratio is at most twice the shorter length over both: most pairs end here.
        return 2 * min(len(a), len(norm)) >= SAME_PARAGRAPH * (len(a) + len(norm)) and gestalt(a, norm) >= SAME_PARAGRAPH


CLUSTERED = "video_id string, slide_number long, cluster int, text_type string, text string, observations int, variants int, source_place long, source_paragraph int"


def paragraph_clusters(paragraphs: DataFrame, evidence: tuple[str, ...] = ()) -> DataFrame:
    """The paragraphs of each slide, each as the best of its observations.

    ``paragraphs`` has ``video_id, slide_number, place, paragraph_index (the order of seeing), text_type, text``. Each goes to the first cluster
    whose best reading so far it equals, extends, is extended by, or resembles; null texts are left out. The columns ``evidence``, of numbers, come along from the best observation.
    """

    def algorithm(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        clusters: list[Cluster] = []
        for _, _, place, paragraph, kind, text, *shown in rows:
            norm = " ".join(text.lower().split())
            for c in clusters:
                if c.takes(kind, norm):
                    c.add(norm, (place, paragraph), text, *shown)
                    break
            else:
                clusters.append(Cluster(kind, norm, (place, paragraph), text, *shown))
        for n, c in enumerate(clusters):
            at, text, *shown = c.first[c.best]
            yield (*key, n, c.kind, text, sum(c.counts.values()), len(c.counts), *at, *shown)

    own = paragraphs.filter(F.col("text").isNotNull()).select("video_id", "slide_number", F.col("place").cast("long").alias("place"), F.col("paragraph_index").cast("int").alias("paragraph_index"), "text_type", "text", *[F.col(n).cast("double").alias(n) for n in evidence])
    return per_group(own, ["video_id", "slide_number"], ["place", "paragraph_index"], algorithm, ", ".join([CLUSTERED, *[f"{n} double" for n in evidence]]))


MIN_CONFIDENCE, WEAK_MARGIN, TINY_SHARE = 0.60, 0.10, 0.001


def tiny_footprint(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> Column:
    """Whether a box covers next to nothing of its frame; false where either is unknown."""
    area = F.greatest(right - left, F.lit(0.0)) * F.greatest(bottom - top, F.lit(0.0))
    return F.coalesce(F.try_divide(area, width * height) <= F.lit(TINY_SHARE), F.lit(False))


def assess(text: Column, confidence: Column, observations: Column, tiny: Column, recognised: list[str]) -> dict[str, Column]:
    """Evidence about a text: its scripts, whether short content is protected, the reasons in their order, and whether weak evidence withholds it."""
    scripts = observed_scripts(text)
    foreign = F.size(F.array_except(scripts, F.array(*[F.lit(s) for s in recognised]))) > 0
    protected, fragment = F.coalesce(is_protected_short(text), F.lit(False)), F.coalesce(is_fragment(text), F.lit(False))
    weak = F.coalesce(confidence <= F.lit(MIN_CONFIDENCE + WEAK_MARGIN), F.lit(False))
    once = F.coalesce(observations <= 1, F.lit(False))
    withheld = fragment & weak & (tiny | once) & ~protected & ~foreign
    reasons = [(foreign, "Script Mismatch"), (withheld, "Fragment-like Structure"), (withheld, "Weak OCR Evidence"), (withheld & tiny, "Tiny Visual Footprint"), (withheld & once, "Uncorroborated Observation")]
    return {
        "scripts": scripts,
        "protected_short": protected,
        "fragment": fragment,
        "withheld": withheld,
        "reasons": F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in reasons])),
    }


__all__ = ["assess", "paragraph_clusters", "same_slide", "slide_runs", "tiny_footprint", "vote", "words"]
