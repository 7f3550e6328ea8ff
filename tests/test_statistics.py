import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import aggregates as A
from gridloom.operators import clustering as C
from gridloom.operators import spatial as S
from gridloom.operators.agreement import agreement, ari_bootstrap, cramers_v, nmi_permutation
from gridloom.plans import ranking as R


def pairs(spark, a, b):
    return spark.createDataFrame(list(zip(a, b, strict=True)), "a string, b string")


def test_identical_labelings_agree(spark):
    r = agreement(pairs(spark, "xxyyz", "xxyyz"), "a", "b").first()
    assert [r[c] for c in ("ari", "nmi", "kappa", "accuracy")] == pytest.approx([1.0] * 4)


def test_renamed_labels_leave_ari_and_nmi(spark):
    r = agreement(pairs(spark, "xxyyzz", "qqppoo"), "a", "b").first()
    assert r["ari"] == pytest.approx(1) and r["nmi"] == pytest.approx(1) and r["accuracy"] == 0


def test_random_labels_do_not_agree(spark):
    rng = np.random.default_rng(0)
    df = pairs(spark, map(str, rng.integers(0, 4, 2000)), map(str, rng.integers(0, 4, 2000)))
    assert abs(agreement(df, "a", "b").first()["ari"]) <= 0.1
    b = ari_bootstrap(A.contingency(df, "a", "b"), 200, 1)
    assert b["low"] <= b["ari"] <= b["high"]
    assert 0.01 < nmi_permutation(A.contingency(df, "a", "b"), 200, 1)["p_value"] <= 1


def test_one_cluster_each(spark):
    r = agreement(pairs(spark, "xxx", "yyy"), "a", "b").first()
    assert r["nmi"] == pytest.approx(1) and r["ari"] == pytest.approx(1)


def test_cramers_v_of_a_perfect_3x3(spark):
    r = cramers_v(pairs(spark, "xxyyzz", "aabbcc"), "a", "b").first()
    assert r["cramers_v"] == pytest.approx(1) and r["chi2"] == pytest.approx(12)


def test_cramers_v_of_one_column_is_null(spark):
    assert cramers_v(pairs(spark, "xy", "aa"), "a", "b").first()["cramers_v"] is None


def grid(spark, n, label, spacing=50.0):
    rows = [(i * n + j, i * spacing, j * spacing, "S", label(i, j)) for i in range(n) for j in range(n)]
    return spark.createDataFrame(rows, "id bigint, x double, y double, sample string, label int")


def test_moran_of_halves_and_of_a_checkerboard(spark):
    halves = S.analyse(grid(spark, 10, lambda i, j: int(i >= 5)), "label").first()
    assert halves["morans_i"] > halves["expected_i"] and halves["p_value"] < 0.05
    board = S.analyse(grid(spark, 8, lambda i, j: (i + j) % 2), "label", k=4).first()
    assert board["morans_i"] < board["expected_i"] and board["z_score"] < 0


def test_moran_does_not_change_with_scale(spark):
    a = S.analyse(grid(spark, 7, lambda i, j: i * j % 3), "label").first()
    b = S.analyse(grid(spark, 7, lambda i, j: i * j % 3, spacing=0.5), "label").first()
    assert a["morans_i"] == pytest.approx(b["morans_i"])


def test_moran_of_one_cluster_is_zero_and_few_points_are_skipped(spark):
    assert S.analyse(grid(spark, 5, lambda i, j: 0), "label").first()["morans_i"] == 0
    assert S.analyse(grid(spark, 3, lambda i, j: i), "label").count() == 0


def test_summary(spark):
    both = grid(spark, 10, lambda i, j: int(i >= 5)).unionByName(grid(spark, 8, lambda i, j: (i * 7 + j * 3) % 5).withColumn("sample", F.lit("T")).withColumn("id", F.col("id") + 1000))
    rows = {r["sample"]: r for r in S.summary(S.analyse(both, "label")).collect()}
    assert rows["S"]["pattern"] == "clustering" and rows["S"]["n_samples"] == 2 and rows["S"]["evidence"] in ("moderate", "strong")


def test_overlap(spark):
    a = spark.createDataFrame([(0.0, 0.0, "s"), (100.0, 100.0, "s")], "x double, y double, sample string")
    b = spark.createDataFrame([(50.0, 25.0, "s"), (150.0, 125.0, "s")], "x double, y double, sample string")
    r = A.coordinate_overlap(a, b).first()
    assert (r["x_overlap"], r["y_overlap"], r["x_pct"], r["y_pct"], r["good"]) == (50, 75, 50, 75, False)
    assert A.scale_ratios(a, a.withColumn("x", F.col("x") * 10).withColumn("y", F.lit(1.0))).first()[:] == (0.1, None)


def test_spot_features(spark):
    assigned = spark.createDataFrame([(0, 7, 1.0, "a"), (1, 7, 3.0, "a"), (2, 8, 2.0, "b")], "nucleus_id bigint, spot_id bigint, dist double, sample string")
    vectors = spark.createDataFrame([(0, [1.0, 5.0]), (1, [3.0, 1.0]), (2, [9.0, 9.0])], "nucleus_id bigint, v array<double>")
    for method, want in (("mean", [2.0, 3.0]), ("max", [3.0, 5.0]), ("median", [2.0, 3.0])):
        r = A.spot_features(assigned, vectors, method, 2, ("sample",)).collect()
        assert len(r) == 1 and r[0]["agg"] == want and r[0]["n_nuclei"] == 2 and r[0]["mean_distance"] == 2 and r[0]["sample"] == "a"
    with pytest.raises(ValueError):
        A.spot_features(assigned, vectors, "mode")


def test_silhouette_of_two_pairs(spark):
    df = spark.createDataFrame([(0, [0.0], 0), (1, [1.0], 0), (2, [10.0], 1), (3, [11.0], 1), (4, [50.0], 2)], "id bigint, v array<double>, c int")
    s = {r["id"]: r["silhouette"] for r in C.silhouette(df, "id", "v", "c").collect()}
    assert s[0] == pytest.approx((10.5 - 1) / 10.5) and s[1] == pytest.approx((9.5 - 1) / 9.5) and s[4] == 0


def test_silhouette_in_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x, c = rng.normal(size=(60, 3)), rng.integers(0, 3, 60)
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, c, strict=True))], "id bigint, v array<double>, c int").repartition(5)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = []
    for i in range(60):
        a = d[i, (c == c[i]) & (np.arange(60) != i)].mean()
        b = min(d[i, c == k].mean() for k in range(3) if k != c[i])
        want.append((b - a) / max(a, b))
    assert C.silhouette_mean(df, "id", "v", "c") == pytest.approx(np.mean(want))


def test_one_cluster_has_sentinels(spark):
    df = spark.createDataFrame([(0, [0.0], 0), (1, [1.0], 0)], "id bigint, v array<double>, c int")
    r = C.quality(df, "id", "v", "c").first()
    assert (r["silhouette"], r["calinski_harabasz"]) == (-1, 0) and math.isinf(r["davies_bouldin"])


def blobs(spark, n=40):
    rng = np.random.default_rng(1)
    rows = [(k * n + i, (rng.normal(0, 0.2, 2) + [5 * k, 3 * (k % 2)]).tolist(), f"S{i % 2}", k) for k in range(3) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, v array<double>, sample string, truth int")


def test_kmeans_finds_blobs_and_their_number(spark):
    df = blobs(spark)
    assert agreement(C.kmeans(df, "v", 3, restarts=3), "truth", "cluster").first()["ari"] == pytest.approx(1)
    per = df.join(C.kmeans_per_sample(df, "v", 3).drop("sample"), "id")
    assert all(r["ari"] == pytest.approx(1) for r in agreement(per, "truth", "cluster", ["sample"]).collect())
    assert C.choose_k(df, "v", 4)[0] == 3 and C.choose_k(df, "v", 4, "davies_bouldin")[0] == 3
    with pytest.raises(ValueError):
        C.choose_k(df, "v", 4, "other")


def test_other_clusterings_and_their_comparison(spark):
    df = blobs(spark)
    cut = C.bisecting(df, "v", 3)
    assert agreement(cut, "truth", "cluster").first()["ari"] > 0.9
    near = spark.createDataFrame([(b + i, b + j, 1.0) for b in (0, 100) for i in range(8) for j in range(8) if i < j] + [(0, 100, 0.01)], "i bigint, j bigint, w double")
    sides = {r["id"] // 100: set() for r in C.spectral(near, 2).collect()}
    for r in C.spectral(near, 2).collect():
        sides[r["id"] // 100].add(r["cluster"])
    assert all(len(v) == 1 for v in sides.values()) and sides[0] != sides[1]
    gain = C.compare_labelings(cut.withColumn("odd", (F.col("id") % 2).cast("int")), "id", "v", "odd", "cluster").first()
    assert gain["silhouette_gain"] > 0 and gain["davies_bouldin_gain"] < 0


def test_consensus():
    import pandas as pd

    got = C.consensus(pd.DataFrame({"a": [0, 0, 1, 1, 2], "b": [1, 1, 0, 0, 0]}), [1.0, 0.5], 2)
    assert got[0] == got[1] and got[2] == got[3] != got[0]


def test_ranking(spark):
    df = spark.createDataFrame([("a_16px", 0.1, 0.2, 0.1, 10.0, 2.0), ("b_16_32_64px", 0.5, 0.8, 0.6, 90.0, 0.5), ("c_64px", None, 0.4, 0.3, 40.0, None)], "configuration string, border double, coherence double, silhouette double, calinski_harabasz double, davies_bouldin double")
    best = R.composite(df).filter("best").first()
    assert best["configuration"] == "b_16_32_64px" and best["composite"] == pytest.approx(5, abs=1e-4)
    bands = {r["criterion"]: r["band"] for r in R.recommendations(df).collect()}
    assert bands["border"] == bands["coherence"] == bands["silhouette"] == "excellent"
    assert R.strategy(df).filter("best").first()["strategy"] == "multi_scale"


@pytest.mark.parametrize("method", ["mean", "max", "median"])
def test_vector_aggregate_whole_and_by_dimension(spark, monkeypatch, method):
    nan = float("nan")
    rows = [(k, [float((k * 7 + i * 3 + d) % 11) for d in range(5)]) for k in range(4) for i in range(k + 2)]
    rows += [(7, [1.0, None, nan]), (7, [2.0]), (7, None), (7, [4.0, None, 1.0, 5.0]), (8, []), (8, None), (9, [float("inf")]), (9, [float("inf")]), (None, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "g int, v array<float>")
    want = df.select("g", F.posexplode("v")).groupBy("g", "pos").agg(A.METHODS[method](F.col("col").cast("double")).alias("x")).collect()
    want = {(r["g"], r["pos"]): repr(r["x"]) for r in want}
    for whole in (100, 3, 0):
        monkeypatch.setattr(A, "WHOLE", whole)
        got = A.vector_aggregate(df, ["g"], "v", method).collect()
        assert {(r["g"], i): repr(x) for r in got for i, x in enumerate(r["agg"])} == want, whole


def test_vectors_travel_whole(spark):
    df = spark.range(100).select((F.col("id") % 30).alias("g"), F.array(*[F.col("id").cast("float") + d for d in range(64)]).alias("v"))
    plan = A.vector_aggregate(df, ["g"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
