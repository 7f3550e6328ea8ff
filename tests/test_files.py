"""Image files, reports and saved models."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import raster as I
from gridloom.sources import readers as R
from gridloom.sources import tiff
from gridloom.sources import writers as W


@pytest.mark.parametrize("shape", [(5, 7), (5, 7, 3), (1, 1), (300, 2)])
@pytest.mark.parametrize("kind", ["uint8", "uint16", "int32", "float32"])
def test_tiff_round_trip(shape, kind):
    a = (np.random.default_rng(1).uniform(0, 200, shape)).astype(kind)
    b = tiff.decode(tiff.encode(a))
    assert (a == b).all() and b.dtype == a.dtype and b.shape == a.shape
    assert tiff.size(tiff.encode(a)) == (shape[1], shape[0])


def test_tiff_of_the_other_byte_order_in_tiles():
    a = np.arange(6 * 10, dtype=">u2").reshape(6, 10)
    tiles = [np.pad(a[y : y + 4, x : x + 8], ((0, max(0, y + 4 - 6)), (0, max(0, x + 8 - 10)))).tobytes() for y in (0, 4) for x in (0, 8)]
    fields = [(256, 3, [10]), (257, 3, [6]), (258, 3, [16]), (259, 3, [1]), (277, 3, [1]), (322, 3, [8]), (323, 3, [4]), (324, 4, None), (325, 4, [64] * 4)]
    apart = 8 + 2 + 12 * len(fields) + 4
    offsets = [apart + 32 + 64 * k for k in range(4)]
    out, rest = struct.pack(">2sHIH", b"MM", 42, 8, len(fields)), b""
    for tag, form, values in fields:
        data = struct.pack(f">{len(values or offsets)}{'H' if form == 3 else 'I'}", *(values or offsets))
        out += struct.pack(">HHI", tag, form, len(values or offsets)) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(">I", apart + len(rest)))
        rest += data if len(data) > 4 else b""
    assert (tiff.decode(out + struct.pack(">I", 0) + rest + b"".join(tiles)) == a).all()


def test_tiff_that_cannot_be_read():
    with pytest.raises(ValueError):
        tiff.decode(b"no image at all")
    with pytest.raises(ValueError):
        tiff.header(1 << 17, 1 << 17, 1, np.dtype("uint8"), 256)


def test_pixels_outside_and_missing(spark, tmp_path):
    p = spark.createDataFrame([(0, 0, 5), (2, 3, 7), (9, 0, 1), (-1, 0, 1)], "y int, x int, v int")
    W.image(p, f"{tmp_path}/a.tif", 3, 4, ["v"], strip_rows=2)
    got = {(r["y"], r["x"]): r["v"] for r in R.raster(spark, f"{tmp_path}/a.tif").collect()}
    assert len(got) == 12 and got[0, 0] == 5 and got[2, 3] == 7 and sum(got.values()) == 12


def test_tiles_fill_gaps_with_zeros(spark):
    r = np.random.default_rng(5)
    a = np.where(r.random((9, 11)) < 0.4, r.integers(1, 99, (9, 11)), 0)
    p = spark.createDataFrame([(int(y), int(x), int(a[y, x])) for y, x in zip(*np.nonzero(a), strict=True)], "y int, x int, v int")
    for stride, patch in ((4, 4), (3, 5)):
        for t in I.tile_pixels(p, stride, patch).collect():
            y, x = t["tile_y"] * stride, t["tile_x"] * stride
            want = np.zeros((patch, patch))
            part = a[y : y + patch, x : x + patch]
            want[: part.shape[0], : part.shape[1]] = part
            assert t["data"] == want.ravel().tolist()


def test_enhancement_pixel_by_pixel():
    image = (np.random.default_rng(6).random((12, 9)) < 0.4).astype("uint8") * 255
    h, w = image.shape
    cross = ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))

    def at(a, y, x, outside):
        return a[y][x] if 0 <= y < h and 0 <= x < w else outside

    grown = [[max(at(image, y + dy, x + dx, 0) for dy, dx in cross) for x in range(w)] for y in range(h)]
    shrunk = [[min(at(grown, y + dy, x + dx, 255) for dy, dx in cross) for x in range(w)] for y in range(h)]
    closed = [[max(int(image[y][x]), int(shrunk[y][x])) for x in range(w)] for y in range(h)]
    rim = [[255 if closed[y][x] and min(at(closed, y + dy, x + dx, 0) for dy, dx in cross) == 0 else 0 for x in range(w)] for y in range(h)]
    top = [[max(closed[y][x], rim[y][x]) for x in range(w)] for y in range(h)]
    k = [np.exp(-d * d / (2 * 0.5**2)) for d in (-1, 0, 1)]
    k = [v / sum(k) for v in k]
    mirror = lambda i, n: 1 if i < 0 else n - 2 if i >= n else i
    want = [[sum(k[i + 1] * k[j + 1] * top[mirror(y + i, h)][mirror(x + j, w)] for i in (-1, 0, 1) for j in (-1, 0, 1)) for x in range(w)] for y in range(h)]
    assert np.abs(I.enhance_binary(image).astype(float) - np.array(want)).max() <= 0.5 + 1e-6


def test_report_says_what_the_figures_say(spark, tmp_path):
    metrics = {
        "ari": {"score": 0.5, "low": 0.4, "high": 0.6, "std": 0.05}, "nmi": {"score": 0.3, "p_value": 0.01, "mean": 0.02, "std": 0.01}, "silhouettes": {"first": 0.1, "second": 0.3},
        "effects": {"kappa": 0.2, "cramers_v": 0.4, "coherence": -0.66}, "matches": {"accuracy": 0.7, "n": 1200, "rows": [{"label": "A", "best": 2, "fraction": 0.75}]},
    }
    text = W.report_text(metrics)
    for part in ("0.5000", "moderate", "significant", "the second is more coherent", "Cramer's V 0.4000", "1,200 points", "A -> 2 (75.00%)"):
        assert part in text
    cells = spark.createDataFrame([("A", "x", 3), ("B", "y", 4)], "a string, b string, n bigint")
    one = spark.createDataFrame([(0, 1.0)], "label int, mean double")
    W.metrics_bundle(spark, metrics, {"first": one}, cells, str(tmp_path))
    assert spark.read.text(f"{tmp_path}/summary").filter(F.col("value").contains("moderate")).count() == 1
