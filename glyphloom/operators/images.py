"""Small kernels over grey images held as arrays: variants for recognition experiments, exact covers and bounded sizes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

MAX_SIDE = 1536
# The parts of blue, green and red in grey, of 2 ** 14, and the sharpness of cubic interpolation.
WEIGHTS, CUBIC = (1868, 9617, 4899), -0.75


def grayscale(image: np.ndarray) -> np.ndarray:
    """Blue, green and red to grey; grey images stay."""
    return image if image.ndim == 2 else ((image[..., :3].astype(np.int64) @ np.array(WEIGHTS) + (1 << 13)) >> 14).astype(np.uint8)


def contrast(image: np.ndarray, factor: float = 1.25) -> np.ndarray:
    return np.clip(np.rint(image * factor), 0, 255).astype(np.uint8)


def sharpen(image: np.ndarray) -> np.ndarray:
    """Each pixel five times less its four neighbours; what lies beyond an edge mirrors what lies before it, the edge itself left out."""
    p = image.astype(np.int32)
    for axis in (0, 1):
        p = np.pad(p, [(1, 1) if k == axis else (0, 0) for k in range(2)], mode="reflect" if image.shape[axis] > 1 else "edge")
    return np.clip(5 * p[1:-1, 1:-1] - p[:-2, 1:-1] - p[2:, 1:-1] - p[1:-1, :-2] - p[1:-1, 2:], 0, 255).astype(np.uint8)


def otsu(image: np.ndarray) -> np.ndarray:
    """Black and white at the level that parts the two classes best."""
    n = np.bincount(image.ravel(), minlength=256).astype(float)
    below, level = np.cumsum(n), np.arange(256)
    total, mass = below[-1], np.cumsum(n * level)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mass[-1] * below - total * mass) ** 2 / (below * (total - below))
    cut = int(np.nanargmax(np.where(np.isfinite(between), between, -1)))
    return np.where(image > cut, 255, 0).astype(np.uint8)


def _cubic(size: int, factor: float) -> np.ndarray:
    """The weights (new size, size) of cubic interpolation along one axis; edges repeat."""
    n = round(size * factor)
    at = (np.arange(n) + 0.5) / factor - 0.5
    base = np.floor(at).astype(int)
    out = np.zeros((n, size))
    for k in (-1, 0, 1, 2):
        d = np.abs(at - base - k)
        near = ((CUBIC + 2) * d - (CUBIC + 3)) * d * d + 1
        far = ((CUBIC * d - 5 * CUBIC) * d + 8 * CUBIC) * d - 4 * CUBIC
        np.add.at(out, (np.arange(n), np.clip(base + k, 0, size - 1)), np.where(d <= 1, near, far))
    return out


def upscale(image: np.ndarray, factor: float = 1.5) -> np.ndarray:
    """Larger by ``factor``, cubic between pixels."""
    rows, columns = (_cubic(s, factor) for s in image.shape)
    return np.clip(np.rint(rows @ image.astype(float) @ columns.T), 0, 255).astype(np.uint8)


def edges(image: np.ndarray, hidden: np.ndarray | None = None, low: float = 80, high: float = 160) -> np.ndarray:
    """Where a grey image has edges: local maxima of the gradient along its direction that are at least ``high``, and those of at least ``low`` that touch them. ``hidden`` pixels take the median first."""
    a = image.astype(np.int32)
    if hidden is not None and hidden.any():
        a = np.where(hidden, int(np.median(image)), a)
    p = np.pad(a, 1, mode="edge")
    gx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    gy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    size = np.abs(gx) + np.abs(gy)
    q = np.pad(size, 1)
    h, w = size.shape
    shift = lambda dy, dx: q[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    steep, flat = np.abs(gy) > 2.414 * np.abs(gx), np.abs(gy) < 0.414 * np.abs(gx)
    falls = (gx > 0) == (gy > 0)
    before = np.where(flat, shift(0, -1), np.where(steep, shift(-1, 0), np.where(falls, shift(-1, -1), shift(-1, 1))))
    after = np.where(flat, shift(0, 1), np.where(steep, shift(1, 0), np.where(falls, shift(1, 1), shift(1, -1))))
    ridge = (size > before) & (size >= after)
    weak, strong = ridge & (size > low), ridge & (size > high)
    while True:
        around = np.pad(strong, 1)
        grown = weak & np.any([around[1 + y : 1 + y + h, 1 + x : 1 + x + w] for y in (-1, 0, 1) for x in (-1, 0, 1)], axis=0)
        if (grown == strong).all():
            return strong
        strong = grown


def aligned_segments(found: np.ndarray) -> int:
    """The number of straight horizontal and vertical stretches of edges, of 18 % of the shorter side at least (12 pixels), over gaps of 2 % (3 pixels)."""
    least, gap = max(12, round(min(found.shape) * 0.18)), max(3, round(min(found.shape) * 0.02))
    total = 0
    for lines in (found, found.T):
        for line in lines:
            at = np.flatnonzero(line)
            if len(at):
                parts = np.split(at, np.flatnonzero(np.diff(at) > gap + 1) + 1)
                total += sum(int(part[-1] - part[0] + 1 >= least) for part in parts)
    return total


def structure_evidence(images: DataFrame) -> DataFrame:
    """``image_id, edge_density, aligned_lines`` of grey images ``image_id long, width int, pixels array<int>, boxes array<array<double>>`` outside their boxes; both are null for an image that cannot be read."""

    def one(width: int, pixels: np.ndarray, boxes: list | None) -> tuple[float, int]:
        image = np.asarray(pixels, dtype=np.uint8).reshape(-1, int(width))
        hidden = np.zeros(image.shape, bool)
        for left, top, right, bottom in boxes if boxes is not None else []:
            hidden[max(0, int(np.floor(top))) : max(0, int(np.ceil(bottom))), max(0, int(np.floor(left))) : max(0, int(np.ceil(right)))] = True
        found = edges(image, hidden)
        return float(found.mean()), aligned_segments(found)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, width, pixels, boxes in batch[["image_id", "width", "pixels", "boxes"]].itertuples(index=False):
                try:
                    rows.append((key, *one(width, pixels, boxes)))
                except Exception:  # noqa: BLE001 - an image that cannot be read is its row's
                    rows.append((key, None, None))
            yield pd.DataFrame(rows, columns=["image_id", "edge_density", "aligned_lines"]).astype({"edge_density": "float64", "aligned_lines": "Int64"})

    return images.select("image_id", "width", "pixels", "boxes").mapInPandas(run, "image_id long, edge_density double, aligned_lines long")


#: The variants of an experiment; ``original`` is always there, and first.
VARIANTS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "original": lambda a: a,
    "grayscale": grayscale,
    "contrast": contrast,
    "sharpen": sharpen,
    "threshold": otsu,
    "upscale": upscale,
    "upscale_sharpen": lambda a: sharpen(upscale(a)),
}


def experiment(images: DataFrame, measure: Callable[[np.ndarray], float], variants: list[str] | None = None) -> DataFrame:
    """``image_id, variant, status, value, error``: a measure of each variant of each image; a variant that fails is a row with its error.

    ``images`` has ``image_id long, width int, pixels array<int>`` (rows of a grey image).
    """
    chosen = list(dict.fromkeys(["original", *(variants or VARIANTS)]))
    unknown = [v for v in chosen if v not in VARIANTS]
    if unknown:
        raise ValueError("unknown variants: " + ", ".join(unknown))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, width, pixels in batch[["image_id", "width", "pixels"]].itertuples(index=False):
                for name in chosen:
                    try:
                        image = np.asarray(pixels, dtype=np.uint8).reshape(-1, int(width))
                        rows.append((key, name, "ok", float(measure(VARIANTS[name](image))), None))
                    except Exception as failure:  # noqa: BLE001 - a failing variant is its row's
                        rows.append((key, name, "failed", None, f"{type(failure).__name__}: {failure}"))
            yield pd.DataFrame(rows, columns=["image_id", "variant", "status", "value", "error"])

    return images.select("image_id", "width", "pixels").mapInPandas(run, "image_id long, variant string, status string, value double, error string")


def png(image: np.ndarray) -> bytes:
    """A grey or colour (blue, green, red) image as a PNG file."""
    shown = image if image.ndim == 2 else image[..., 2::-1]
    height, width = shown.shape[:2]
    rows = b"".join(b"\0" + np.ascontiguousarray(shown[k]).astype(np.uint8).tobytes() for k in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if shown.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@F.pandas_udf(BinaryType())
def frame_png(width: pd.Series, pixels: pd.Series) -> pd.Series:
    """The PNG file of a grey image given as its width and rows of pixels; null for an image that is none."""

    def one(w, p):
        try:
            return png(np.asarray(p, dtype=np.uint8).reshape(-1, int(w)))
        except Exception:  # noqa: BLE001 - an image that is none is its row's
            return None

    return pd.Series([one(w, p) for w, p in zip(width, pixels)], dtype=object)


def compared(results: DataFrame, key: str, variant: str, rates: list[str], baseline: str = "original") -> DataFrame:
    """``comparison`` of each variant's rates, in order, with those of the baseline: improved, worsened, unchanged, or unavailable where any is null."""
    base = results.filter(F.col(variant) == baseline).select(key, *[F.col(r).alias(f"_b_{r}") for r in rates])
    own, other = F.struct(*[F.col(r).alias(r) for r in rates]), F.struct(*[F.col(f"_b_{r}").alias(r) for r in rates])
    lacking = F.lit(False)
    for r in rates:
        lacking = lacking | F.col(r).isNull() | F.col(f"_b_{r}").isNull()
    found = F.when(lacking, "unavailable").when(own < other, "improved").when(own > other, "worsened").otherwise("unchanged")
    return results.join(base, key, "left").withColumn("comparison", found).drop(*[f"_b_{r}" for r in rates])


def bounded_size(width: Column, height: Column, most: int = MAX_SIDE) -> tuple[Column, Column]:
    """Width and height scaled so that neither exceeds ``most``; halves round to even, nothing falls below 1."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    side = lambda s: F.greatest(F.lit(1), F.bround(s * scale).cast("int"))
    return side(width), side(height)
