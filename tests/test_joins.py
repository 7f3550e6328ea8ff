from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import joins as J
from gridloom.session import cleared, scratch


def points(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"id bigint, x double, y double{extra}")


def cloud(spark, n, seed, samples=2, span=100.0):
    r = np.random.default_rng(seed)
    xy = np.round(r.uniform(0, span, (n, 2)), 3)
    rows = [(i, float(a), float(b), f"S{i % samples}") for i, (a, b) in enumerate(xy)]
    return rows, points(spark, rows, ", sample string")


def test_majority_vote_counts_neighbours(spark):
    nuclei = points(spark, [(0, 10.0, 10.0, 0), (1, 11.0, 10.0, 0), (2, 12.0, 10.0, 1), (3, 50.0, 50.0, 2)], ", cluster int")
    r = J.majority_vote(points(spark, [(7, 10.0, 10.0)]), nuclei, 5.0).first()
    assert (r["vote"], r["n_nuclei"]) == (0, 3)


def test_majority_vote_without_neighbours(spark):
    nuclei = points(spark, [(0, 100.0, 100.0, 0)], ", cluster int")
    r = J.majority_vote(points(spark, [(7, 0.0, 0.0)]), nuclei, 5.0).first()
    assert (r["vote"], r["n_nuclei"]) == (-1, 0)


def test_majority_vote_tie_goes_to_the_lowest(spark):
    nuclei = points(spark, [(0, 1.0, 0.0, 4), (1, 0.0, 1.0, 2)], ", cluster int")
    assert J.majority_vote(points(spark, [(7, 0.0, 0.0)]), nuclei, 5.0).first()["vote"] == 2


def boxes(spark, rows):
    return spark.createDataFrame(rows, "sample string, x_min double, x_max double, y_min double, y_max double, ord int")


def test_boxes(spark):
    b = boxes(spark, [("IRI1", 0.0, 100.0, 0.0, 100.0, 0), ("IRI2", 200.0, 300.0, 200.0, 300.0, 1)])
    got = {r["id"]: r["assigned"] for r in J.assign_boxes(points(spark, [(0, 50.0, 50.0), (1, 250.0, 250.0)]), b).collect()}
    assert got == {0: "IRI1", 1: "IRI2"}


def test_boxes_nearest_centre_outside(spark):
    b = boxes(spark, [("IRI1", 0.0, 10.0, 0.0, 10.0, 0), ("IRI2", 90.0, 100.0, 90.0, 100.0, 1)])
    assert J.assign_boxes(points(spark, [(0, 20.0, 20.0)]), b).first()["assigned"] == "IRI1"


def test_boxes_overlap(spark):
    b = boxes(spark, [("A", 0.0, 10.0, 0.0, 10.0, 0), ("B", 5.0, 30.0, 5.0, 30.0, 1)])
    p = points(spark, [(0, 6.0, 6.0)])
    assert J.assign_boxes(p, b).first()["assigned"] == "B"
    assert J.assign_boxes(p, b, overlap="nearest").first()["assigned"] == "A"


def test_nearest_against_brute_force(spark):
    left, ldf = cloud(spark, 150, 1)
    right, rdf = cloud(spark, 40, 2)
    got = {r["l_id"]: (r["r_id"], round(r["dist"], 9)) for r in J.nearest(ldf, rdf, 20.0, ["sample"]).collect()}
    want = {}
    for i, x, y, s in left:
        near = [(np.hypot(x - a, y - b), j) for j, a, b, t in right if s == t]
        near = [d for d in near if d[0] <= 20]
        if near:
            d, j = min(near)
            want[i] = (j, round(d, 9))
    assert got == want


def test_nearest_is_strict_if_asked(spark):
    a, b = points(spark, [(0, 0.0, 0.0)]), points(spark, [(1, 5.0, 0.0)])
    assert J.nearest(a, b, 5.0).count() == 1
    assert J.nearest(a, b, 5.0, strict=True).count() == 0


def test_no_match_is_an_error(spark):
    a, b = points(spark, [(0, 0.0, 0.0, "s")], ", sample string"), points(spark, [(1, 1000.0, 1000.0, "s")], ", sample string")
    with pytest.raises(ValueError):
        J.nearest_or_fail(a, b, 10.0, ["sample"])
    assert J.unassigned_report(a, b)["suggested_distance"] > 1000


@pytest.mark.parametrize("k", [1, 3, 8])
def test_knn_against_brute_force(spark, k):
    rows, df = cloud(spark, 120, 3)
    rows[5] = (5, *rows[7][1:3], rows[5][3])  # coincident points of one sample
    df = points(spark, rows, ", sample string")
    got = sorted((r["i"], r["rank"], r["j"]) for r in J.knn_edges(df, k).collect())
    want = []
    for i, x, y, s in rows:
        near = sorted((np.sqrt((x - a) * (x - a) + (y - b) * (y - b)), j) for j, a, b, t in rows if s == t and j != i)
        want += [(i, n, j) for n, (_, j) in enumerate(near[:k], 1)]
    assert got == sorted(want)


def test_knn_with_an_outlier_and_a_small_sample(spark):
    rows, _ = cloud(spark, 50, 4, samples=1)
    rows += [(90, 1e6, 1e6, "S0"), (91, 0.0, 0.0, "T"), (92, 1.0, 0.0, "T")]
    e = J.knn_edges(points(spark, rows, ", sample string"), 5)
    n = {r["i"]: r["count"] for r in e.groupBy("i").count().collect()}
    assert n[90] == 5 and n[91] == 1 and set(n.values()) == {1, 5}


def test_band_graph_is_symmetric_and_skips_coincident_points(spark):
    rows, _ = cloud(spark, 80, 5)
    rows[3] = (3, *rows[9][1:3], rows[9][3])
    e = {(r["i"], r["j"]) for r in J.band_edges(points(spark, rows, ", sample string"), 15.0).collect()}
    assert e and all((j, i) in e for i, j in e) and (3, 9) not in e


def test_delaunay_of_a_square_with_its_centre(spark):
    p = points(spark, [(0, 0.0, 0.0, "a"), (1, 1.0, 0.0, "a"), (2, 1.0, 1.0, "a"), (3, 0.0, 1.0, "a"), (4, 0.5, 0.5, "a")], ", sample string")
    e = {(r["i"], r["j"]) for r in J.delaunay_edges(p).collect()}
    assert {(4, i) for i in range(4)} <= e and (0, 2) not in e and (0, 1) in e


def test_radius_join_against_brute_force(spark):
    left, ldf = cloud(spark, 90, 6)
    right, rdf = cloud(spark, 70, 7)
    got = {(r["l_id"], r["r_id"]) for r in J.radius_join(ldf, rdf, 12.0).collect()}
    assert got == {(i, j) for i, x, y, _ in left for j, a, b, _ in right if np.hypot(x - a, y - b) <= 12}


def test_radius_join_uses_no_nested_loop(spark):
    _, df = cloud(spark, 30, 8)
    plan = J.radius_join(df, df.withColumn("id", F.col("id") + 100), 5.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_knn_candidates_stay_few_beside_a_wide_sample(spark):
    r = np.random.default_rng(21)
    rows = [(i, *map(float, r.uniform(0, 1e6, 2)), "wide") for i in range(50)] + [(100 + i, *map(float, r.uniform(0, 1, 2)), "dense") for i in range(3000)]
    df, k = points(spark, rows, ", sample string"), 8
    frame = J._frames(df, k, "sample")
    own = df.join(frame, "sample")
    assert J._candidates(own, own, 0, "sample").count() <= 50 * k * len(rows)
    e = J.knn_edges(df, k)
    assert e.count() == k * len(rows) and e.groupBy("i").agg(F.sum("w").alias("w")).filter("abs(w - 1) > 1e-9").count() == 0


def test_knn_keeps_k_candidates_before_the_shuffle(spark):
    _, df = cloud(spark, 60, 22)
    own = df.join(J._frames(df, 4, "sample"), "sample")
    rank = F.row_number().over(J.Window.partitionBy("i").orderBy("dist", "j"))
    plan = J._candidates(own, own, 0, "sample").withColumn("rank", rank).filter("rank <= 4")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan and "NestedLoop" not in plan


def test_delaunay_refuses_a_sample_that_is_too_large(spark, monkeypatch):
    monkeypatch.setattr(J, "DELAUNAY_MOST", 20)
    with pytest.raises(ValueError):
        J.delaunay_edges(cloud(spark, 60, 23)[1])


def test_nearest_makes_no_pairs_of_crowds(spark):
    """All lie within the distance of each other: by brute force on some, and nothing written or made is quadratic."""
    r = np.random.default_rng(31)
    p = np.round(np.concatenate([r.normal(0, 5, (6000, 2)), r.normal(30, 1e-4, (3000, 2)), np.full((3000, 2), 7.0)]), 6)
    q = np.round(p[::-1] * 0.97 + 1, 6)
    left, right = (points(spark, [(i, float(x), float(y)) for i, (x, y) in enumerate(c)]) for c in (p, q))
    df = J.nearest(left, right, 80.0)
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r["l_id"]: (r["dist"], r["r_id"]) for r in df.collect()}
    assert len(got) == len(p)
    for i in range(0, len(p), 40):
        d = np.sqrt((p[i, 0] - q[:, 0]) * (p[i, 0] - q[:, 0]) + (p[i, 1] - q[:, 1]) * (p[i, 1] - q[:, 1]))
        assert got[i] == (d.min(), int(np.argmin(d))), i


def test_nearest_leaves_out_what_has_no_place(spark):
    rows = [(0, None, 1.0, "s"), (1, float("nan"), 1.0, "s"), (2, float("inf"), 1.0, "s"), (3, 1.0, 1.0, None), (4, 1.0, 1.0, "s"), (5, 1.0, 1.0, "t")]
    a, b = points(spark, rows, ", sample string"), points(spark, [*rows[:5], (6, 1.0, 1.0, "s")], ", sample string")
    assert [tuple(r) for r in J.nearest(a, b, 5.0, ["sample"]).select("l_id", "r_id", "dist").collect()] == [(4, 4, 0.0)]
    assert {r["l_id"] for r in J.nearest(a, b.filter("id < 0"), 5.0, ["sample"]).collect()} == set()
    assert {r["l_id"]: r["r_id"] for r in J.nearest(a, b, 5.0).drop("l_sample", "r_sample").collect()} == {3: 3, 4: 3, 5: 3}


def test_nearest_keeps_its_result_only(spark):
    place = Path(scratch(spark, "none").removeprefix("file:")).parent
    held = lambda: set(place.iterdir()) if place.exists() else set()
    _, df = cloud(spark, 60, 24)
    before = held()
    assert J.nearest(df, df, 5.0, ["sample"]).count() == 60
    assert [p.name.split("-")[0] for p in held() - before] == ["nearest"]
    with cleared(spark):
        J.nearest(df, df, 5.0).count()
    assert len(held() - before) == 1
