"""Image kernels by hand, covers against a raster, comparisons."""

import random

import numpy as np
import pytest

from glyphloom.operators import images as im
from tests.conftest import rows


def test_kernels():
    a = np.array([[10, 10, 200], [10, 10, 200], [10, 10, 200]], np.uint8)
    assert set(np.unique(im.otsu(a))) == {0, 255} and (im.otsu(a) == 255).sum() == 3
    assert im.contrast(a)[0, 2] == 250 and im.contrast(np.full((1, 1), 230, np.uint8))[0, 0] == 255
    assert im.sharpen(np.full((3, 3), 7, np.uint8)).tolist() == [[7] * 3] * 3 and im.sharpen(np.full((1, 1), 7, np.uint8)).tolist() == [[7]]
    # Beyond the left edge lies what lies right of it: 5 * 10 - 2 * 20 - 10 - 10.
    assert im.sharpen(np.array([[10, 20, 30]] * 3, np.uint8))[1].tolist() == [0, 20, 50]
    assert im.grayscale(np.full((2, 2, 3), 50, np.uint8)).tolist() == [[50, 50], [50, 50]]
    assert im.grayscale(np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255]]], np.uint8)).tolist() == [[29, 150, 76]]


def test_upscale_is_cubic():
    assert im.upscale(np.full((2, 2), 9, np.uint8)).tolist() == [[9] * 3] * 3
    # At factor 2 new pixels lie a quarter from old ones, with weights of the kernel at 1/4, 3/4, 5/4 and 7/4.
    kernel = lambda d: (1.25 * d - 2.25) * d * d + 1 if d <= 1 else -0.75 * (d**3 - 5 * d**2 + 8 * d - 4)
    row = np.array([[0, 40, 80, 40, 0, 20]], np.uint8)
    got = im.upscale(row, 2.0)[0]
    for n in range(12):
        at = (n + 0.5) / 2 - 0.5
        base = int(np.floor(at))
        want = sum(kernel(abs(at - base - k)) * float(row[0, min(5, max(0, base + k))]) for k in (-1, 0, 1, 2))
        assert got[n] == min(255, max(0, round(want)))


def test_edges_and_straight_lines():
    image = np.zeros((60, 80), np.uint8)
    image[20:40, 10:70] = 200
    found = im.edges(image)
    assert im.aligned_segments(found) == 4 and 0 < found.sum() < 400
    assert im.edges(image, np.ones(image.shape, bool)).sum() == 0 and im.edges(np.full((5, 5), 3, np.uint8)).sum() == 0
    hidden = np.zeros(image.shape, bool)
    hidden[:, 40:] = True
    assert 0 < im.edges(image, hidden).sum() and not im.edges(image, hidden)[:, 45:].any()
    short = np.zeros((60, 80), bool)
    short[5, 5:15] = True
    assert im.aligned_segments(short) == 0


def test_structure_evidence_contains_failures(spark):
    image = np.zeros((40, 50), np.uint8)
    image[10:30, 10:40] = 255
    df = spark.createDataFrame([(1, 50, image.ravel().tolist(), [[0.0, 0.0, 50.0, 40.0]]), (2, 50, image.ravel().tolist(), None), (3, 7, [1, 2], None), (4, 1, None, None)], "image_id long, width int, pixels array<int>, boxes array<array<double>>")
    got = {r.image_id: (r.edge_density, r.aligned_lines) for r in im.structure_evidence(df).collect()}
    assert got[1] == (0.0, 0) and got[2][0] > 0 and got[2][1] == 4 and got[3] == got[4] == (None, None)


def test_cover_equals_raster(spark):
    from glyphloom.operators.visual import frame_evidence

    rng = random.Random(1)
    rows_, expected = [], {}
    for frame in range(60):
        boxes = [(x := rng.uniform(-5, 30), y := rng.uniform(-5, 20), x + rng.uniform(0, 12), y + rng.uniform(0, 12)) for _ in range(rng.randrange(0, 9))]
        mask, shown = np.zeros((20, 30)), 0
        for left, top, right, bottom in boxes:
            a, b, c, d = (max(0, min(most, int(f(v)))) for v, most, f in ((left, 30, np.floor), (right, 30, np.ceil), (top, 20, np.floor), (bottom, 20, np.ceil)))
            shown += a < b and c < d
            mask[c:d, a:b] = 1
        if shown:
            expected[frame] = (shown, mask.mean())
        rows_ += [(frame, None, *box, 30, 20) for box in boxes]
    df = spark.createDataFrame(rows_ + [(None, "x", 0.0, 0.0, 1.0, 1.0, 30, 20), (90, "x", None, 0.0, 1.0, 1.0, 30, 20)], "frame_id long, text string, left double, top double, right double, bottom double, width int, height int")
    got = {r.frame_id: (r.regions, r.coverage) for r in frame_evidence(df).collect()}
    assert got.keys() == expected.keys() and all(got[k][0] == n and abs(got[k][1] - c) < 1e-12 for k, (n, c) in expected.items())


def test_triage_and_its_reasons(spark):
    from glyphloom.operators import visual as v

    cases = [(1, 6, 0.5, 0, 0.0, 0.0, 0), (2, 6, 0.5, 3, 0.3, 0.0, 0), (3, 6, 0.5, 0, 0.0, 0.05, 0), (4, 1, 0.1, 0, 0.0, 0.09, 5), (5, 1, 0.05, 3, 0.2, 0.0, 3), (6, 9, 0.4, 0, 0.0, 0.09, 0), (7, 6, 0.35, 0, 0.0, 0.08, 0)]
    df = spark.createDataFrame(cases, "frame_id long, regions long, coverage double, numeric_labels long, label_span double, edge_density double, aligned_lines int")
    got = {r.frame_id: (r.disposition, r.reasons) for r in v.disposition(df).collect()}
    assert got == {
        1: (v.TEXT_DOMINANT, [v.ONLY_TEXT]),
        2: (v.RECOMMENDED, [v.DISPERSED_LABELS]),
        3: (v.UNCERTAIN, [v.NO_EVIDENCE]),
        4: (v.RECOMMENDED, [v.REPEATED_LINES, v.BUSY_PICTURE]),
        5: (v.UNCERTAIN, [v.NO_EVIDENCE]),
        6: (v.UNCERTAIN, [v.NO_EVIDENCE]),
        7: (v.RECOMMENDED, [v.BUSY_PICTURE]),
    }
    frames = spark.createDataFrame([(2, 0, 9, True, "text_dominant"), (2, None, 8, True, "uncertain"), (1, 1, 5, True, "recommended"), (1, 0, 4, False, "recommended")], "slide_number int, build_index int, frame_number int, is_default boolean, disposition string")
    numbers = lambda df: [r.frame_number for r in df.orderBy(*v.target_order()).collect()]
    assert numbers(v.select_targets(frames, v.RECOMMENDED)) == [5, 8] and numbers(v.select_targets(frames, v.ALL_SLIDES)) == [5, 8, 9]
    assert numbers(v.select_targets(frames, v.USER_SELECTED, [1], [9])) == [4, 5, 9]
    for scope in (v.USER_SELECTED, "none"):
        with pytest.raises(ValueError):
            v.select_targets(frames, scope)


def test_experiment_contains_failures(spark):
    df = spark.createDataFrame([(1, 2, [1, 2, 3, 4]), (2, 3, [1, 2]), (3, 1, None)], "image_id long, width int, pixels array<int>")
    got = {(r.image_id, r.variant): r for r in im.experiment(df, lambda a: a.mean(), ["contrast"]).collect()}
    assert got[1, "original"].value == 2.5 and got[1, "contrast"].status == "ok"
    assert got[2, "original"].status == got[3, "contrast"].status == "failed" and "Error" in got[2, "original"].error
    labels = im.compared(spark.createDataFrame([(1, "original", 0.5, 0.1), (1, "a", 0.4, 0.9), (1, "b", 0.5, 0.1), (1, "c", 0.5, 0.2), (1, "d", None, 0.0)], "k int, v string, cer double, wer double"), "k", "v", ["cer", "wer"])
    assert rows(labels.select("v", "comparison")) == [("a", "improved"), ("b", "unchanged"), ("c", "worsened"), ("d", "unavailable"), ("original", "unchanged")]


def test_png_files(spark):
    import struct
    import zlib

    a = np.arange(12, dtype=np.uint8).reshape(3, 4)
    data = im.png(a)
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == (4, 3)
    size = struct.unpack(">I", data[33:37])[0]
    raw = np.frombuffer(zlib.decompress(data[41 : 41 + size]), np.uint8).reshape(3, 5)
    assert (raw[:, 0] == 0).all() and (raw[:, 1:] == a).all()
    colour = im.png(np.array([[[1, 2, 3]]], np.uint8))
    assert zlib.decompress(colour[41 : 41 + struct.unpack(">I", colour[33:37])[0]]) == b"\0\x03\x02\x01"
    df = spark.createDataFrame([(1, 4, a.ravel().tolist()), (2, 5, [1, 2]), (3, 2, None)], "k int, w int, p array<int>")
    got = {r.k: r.f for r in df.select("k", im.frame_png("w", "p").alias("f")).collect()}
    assert bytes(got[1]) == data and got[2] is None and got[3] is None
