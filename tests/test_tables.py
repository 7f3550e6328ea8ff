import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import colors as K
from gridloom.functions import vectors as V
from gridloom.operators import filters as L
from gridloom.operators import raster as I
from gridloom.session import require, same_length
from gridloom.sources import readers, writers


def test_scale_ranges():
    cols = [f"vit{s}_{i}" for s in (64, 16, 32) for i in range(384)]
    assert V.detect_scales(sorted(cols, key=lambda c: (int(c[3:5]), int(c.split("_")[1])))) == {16: (0, 384), 32: (384, 768), 64: (768, 1152)}
    assert V.detect_scales([f"f{i}" for i in range(800)]) == {0: (0, 384), 1: (384, 768)}


def test_scale_selection(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0, 2.0, 3.0)], "id bigint, vit16_0 double, vit16_1 double, vit32_0 double, vit64_0 double")
    assert V.select_scales(df, [32, 16], ["id"]).columns == ["id", "vit16_0", "vit16_1", "vit32_0"]
    with pytest.raises(ValueError):
        V.select_scales(df, [128], ["id"])
    assert readers.features_of_scales(df, [64]).dtypes == [("vit64_0", "float")]


def test_fusion(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [4.0, 3.0])], "id bigint, v array<double>")
    assert V.weighted_fusion(df, "v", {16: (0, 2)}).first()["fused"] == [3.0, 4.0]
    with pytest.raises(ValueError):
        V.fuse([F.col("v")], "sum")
    assert df.select(V.fuse([F.col("v"), F.col("v")], "average").alias("a")).first()["a"] == [3.0, 4.0]


def test_standardise_keeps_constant_dimensions_at_zero(spark):
    df = spark.createDataFrame([(1, [1.0, 7.0], "a"), (2, [3.0, 7.0], "a"), (3, [5.0, 1.0], "b")], "id bigint, v array<double>, s string")
    assert [r["z"] for r in V.standardise(df, "v", by=["s"]).orderBy("id").collect()] == [[-1.0, 0.0], [1.0, 0.0], [0.0, 0.0]]


def test_morphology_nulls_fail(spark):
    cols = "label int, area double, perimeter double, filled_area double, major_axis_length double, minor_axis_length double, solidity double, eccentricity double"
    df = spark.createDataFrame([(1, 10.0, 10.0, 10.0, 2.0, 1.0, 0.9, 0.5), (2, 10.0, 0.0, 10.0, 2.0, 1.0, 0.9, 0.5), (3, 10.0, 10.0, 10.0, 2.0, 0.0, 0.9, 0.5)], cols)
    got = {r["label"]: (r["circularity"], r["aspect_ratio"], r["passed"]) for r in L.passed(L.derived(df), L.Thresholds()).collect()}
    assert got[1] == (1.0, 2.0, True) and got[2] == (None, 2.0, False) and got[3] == (1.0, None, False)
    with pytest.raises(ValueError):
        L.Thresholds(solidity=(0.5, 0.2)).validate()


def test_region_slice_and_crop(spark):
    assert L.region_slice(100, 200, (0.1, 0.5, 0.2, 0.6)) == (10, 50, 40, 120)
    assert L.region_slice(200, 100, (0.1, 0.5, 0.2, 0.6)) == (20, 100, 20, 60)
    px = spark.range(16).select(F.floor(F.col("id") / 4).alias("y"), (F.col("id") % 4).alias("x"))
    assert L.crop(px, (0, 2, 1, 3), 4, 4).count() == 4
    with pytest.raises(ValueError):
        L.crop(px, (2, 2, 0, 4), 4, 4)


def test_sample_names(spark):
    df = spark.createDataFrame([("GSM_iri1_x", 1), ("IRI2", 2), ("other", 3)], "sample string, v int")
    assert {(r["sample"], r["v"]) for r in L.match_samples(df, ["IRI1", "IRI2"]).collect()} == {("IRI1", 1), ("IRI2", 2)}
    with pytest.raises(ValueError):
        L.in_samples(df, ["none"], fail_empty=True)
    with pytest.raises(ValueError):
        require(df, "x")
    with pytest.raises(ValueError):
        same_length(df, df.limit(1))


def test_lut(spark):
    px = spark.createDataFrame([(0, i, i) for i in range(7)], "y int, x int, label int")
    cl = spark.createDataFrame([(1, 9, 0), (1, 0, 1), (3, 2, 2), (5, 4, 3)], "label int, cluster int, ord int")
    assert [r["lut"] for r in I.recolor(px, cl).orderBy("x").collect()] == [0, 1, 0, 3, 0, 5, 0]


def disc(n=21, r=8):
    y, x = np.mgrid[:n, :n]
    return (y - n // 2) ** 2 + (x - n // 2) ** 2 <= r * r


def test_shapes(spark):
    solid, ring = disc(), disc() & ~disc(21, 3)
    rows = [(int(y), int(x), 1) for y, x in np.argwhere(solid)] + [(int(y), int(x) + 40, 2) for y, x in np.argwhere(ring)]
    got = {r["label"]: r for r in I.region_properties(spark.createDataFrame(rows, "y int, x int, label int")).collect()}
    assert got[1]["area"] == got[1]["filled_area"] == got[2]["filled_area"] == solid.sum()
    assert got[1]["solidity"] > 0.9 and got[1]["perimeter"] == pytest.approx(2 * np.pi * 8, rel=0.1)
    assert got[1]["eccentricity"] == pytest.approx(0, abs=1e-6) and got[1]["major_axis_length"] == pytest.approx(2 * 8.2, rel=0.05)
    assert (got[1]["bbox_0"], got[1]["bbox_2"]) == (2, 19)


def test_crops_match_numpy(spark):
    image = np.arange(48.0).reshape(6, 8)
    px = spark.createDataFrame([(int(y), int(x), float(image[y, x])) for y, x in np.ndindex(image.shape)], "y int, x int, v double")
    c = spark.createDataFrame([(0, 2.0, 3.0), (1, 0.0, 0.0), (2, 5.0, 7.5)], "id int, y double, x double")
    for r in I.crops(px, c, 4).join(c, "id").collect():
        assert np.allclose(np.array(r["data"]).reshape(4, 4), I.bilinear_crop(image, r["y"], r["x"], 4))
    with pytest.raises(ValueError):
        I.bilinear_crop(image, 0, 0, 1)


def test_unknown_label_is_an_error(spark):
    px = spark.createDataFrame([(0, 0, 1)], "y int, x int, label int")
    with pytest.raises(KeyError):
        I.centroids_of(px, spark.createDataFrame([(0, 1), (1, 9)], "ord int, label int"))
    with pytest.raises(ValueError):
        I.overlay(px, px, px, 4, alpha=1.5)


def test_enhancement_closes_gaps():
    image = np.full((9, 9), 0)
    image[2:7, 2:7] = 255
    image[4, 4] = 0
    assert I.enhance_binary(image)[4, 4] > 100 and I.enhance_binary(np.zeros((5, 5), int)).max() == 0


def test_npy_sources(spark, tmp_path):
    def save(name, a):
        with open(tmp_path / name, "wb") as f:
            f.write((lambda b: (np.save(b, a), b.getvalue())[1])(io.BytesIO()))
        return f"file://{tmp_path}/{name}"

    stack = np.zeros((2, 3, 3), bool)
    stack[0, 0, :2], stack[1, 0, 1] = True, True
    packed = {(r["y"], r["x"]): r["label"] for r in readers.label_map(spark, save("stack.npy", stack)).collect()}
    assert packed == {(0, 0): 1, (0, 1): 2}
    flat = np.array([[0, 5], [2_000_000, 0]], np.int32)
    path = save("flat.npy", flat)
    assert I.max_label(readers.label_map(spark, path)).first()[0] == 2_000_000
    assert readers.binary_mask(spark, path).filter("v").count() == 2
    assert readers.image_size(spark, path) == (2, 2) and readers.image_size(spark, f"file://{tmp_path}/none.npy") == (1000, 1000)
    assert readers.raster(spark, path, (0, 1, 0, 2)).count() == 2
    assert {r["nucleus_id"]: list(r["v"]) for r in readers.vectors(spark, save("v.npy", np.eye(3))).collect()}[2] == [0, 0, 1]
    with pytest.raises(Exception, match="label map"):
        readers.label_map(spark, save("float.npy", np.zeros((2, 2)))).count()


def test_features_fall_back_to_csv(spark, tmp_path):
    (tmp_path / "f.csv").write_text("vit16_0,vit16_1\n1,2\n")
    assert readers.features(spark, f"file://{tmp_path}/none", f"file://{tmp_path}/f.csv").count() == 1


def test_writers(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    m = spark.createDataFrame([(1, True), (2, False), (3, True)], "label int, passed boolean")
    writers.labels_by_pass(m, out)
    assert spark.read.parquet(f"{out}/passed").count() == 2
    assert '"passed": 2' in spark.read.text(f"{out}/counts", wholetext=True).first()[0]
    r = spark.createDataFrame([("16", 5, "a", 0.1), ("16", 6, "a", 0.4), ("32", 5, "a", 0.2)], "scales string, K int, sample string, ari double")
    writers.comparison_report(r, out)
    assert spark.read.json(f"{out}/best").first()["K"] == 6
    assert spark.read.option("header", True).csv(f"{out}/by_k").count() == 3
    writers.metrics_bundle(spark, {"ari": np.float64(0.5)}, {"a": r}, spark.createDataFrame([("x", "y", 2)], "a string, b string, n int"), out)
    assert readers.metrics_json(spark, f"{out}/metrics").first()["ari"] == 0.5
    assert readers.discover(spark, f"{out}/confusion/*.csv").first()["configuration"] == "confusion"


def test_palette():
    custom = ["#FF0000", "#00FF00", "#0080FF", "#FF00FF"]
    assert K.palette(4, custom=custom) == [(255, 0, 0, 255), (0, 255, 0, 255), (0, 128, 255, 255), (255, 0, 255, 255)]
    assert len(K.palette(50)) == 50 and K.palette(0) == [] and len(set(K.palette(30))) == 30
    assert all(K.contrast(c[:3], (0, 0, 0)) >= 4 for c in K.palette(40))
    assert all(K.contrast(c[:3], (255, 255, 255)) >= 4.5 for c in K.palette(40, background="light")[20:])
    assert K.palette(2, custom=["nonsense", "0080ff"])[0] == (0, 128, 255, 255)
    for bad in ({"alpha": 300}, {"background": "white"}, {"saturation": 2}):
        with pytest.raises(ValueError):
            K.palette(3, **bad)


def test_color_config(tmp_path):
    c = K.ColorConfig(custom_rgb_colors=[(255, 0, 16)], alpha=200)
    assert c.custom_colors == ["#FF0010"] and c.generate(1) == [(255, 0, 16, 200)]
    c.save(str(tmp_path / "c.json"))
    assert K.ColorConfig.load(str(tmp_path / "c.json")).alpha == 200
    (tmp_path / "n.json").write_text('{"color_config": {"alpha": 7, "unknown": 1}}')
    assert K.ColorConfig.load(str(tmp_path / "n.json")).alpha == 7
    assert K.ColorConfig.load(str(tmp_path / "none.json")) == K.ColorConfig()
    assert K.ColorConfig(use_predefined=False).generate(3) != K.ColorConfig().generate(3)
    with pytest.raises(ValueError):
        K.ColorConfig(fallback_to_algorithmic=False).generate(21)
    with pytest.raises(ValueError):
        K.ColorConfig(background="white")


def test_hsl_column(spark):
    import colorsys

    rows = [(h / 12, s / 4, v / 4) for h in range(12) for s in range(5) for v in range(5)]
    df = spark.createDataFrame(rows, "h double, s double, l double")
    got = [tuple(r) for r in df.select(*K.hsl_columns(*map(F.col, "hsl"))).collect()]
    assert all(max(abs(a - int(c * 255 + 1e-9)) for a, c in zip(g, colorsys.hls_to_rgb(h, v, s), strict=True)) == 0 for g, (h, s, v) in zip(got, rows, strict=True))


def test_aligned_and_matched(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0, "a"), (1, 0.0, 9.0, "b")], "id bigint, x double, y double, sample string")
    s = spark.createDataFrame([(5, 0.0, 3.0, "a"), (6, 0.0, 500.0, "a")], "id bigint, x double, y double, sample string")
    assert [(r["l_id"], r["r_id"]) for r in readers.aligned(p, s, ["a"]).collect()] == [(0, 5)]
    assert [(r["l_id"], r["r_id"]) for r in readers.matched(p, s, ["a"]).collect()] == [(5, 0)]
    with pytest.raises(ValueError):
        readers.aligned(p, s, ["b"])


def test_luminance_column(spark):
    r = spark.createDataFrame([(255, 255, 255), (255, 0, 0)], "r int, g int, b int").select(K.luminance_column(*map(F.col, "rgb")).alias("l")).collect()
    assert r[0]["l"] == pytest.approx(1) and r[1]["l"] == pytest.approx(K.luminance((255, 0, 0)))


def test_synthetic_spots_cover_the_range(spark):
    p = spark.createDataFrame([(0.0, 0.0), (100.0, 50.0)], "x double, y double")
    s = I.synthetic_spots(p, 50, ["a", "b"])
    assert {r["x"] for r in s.collect()} == {0, 50, 100} and {r["y"] for r in s.collect()} == {0, 50}
