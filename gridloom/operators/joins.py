"""Spatial joins. Points have x, y, an id and usually a sample; joins are equi-joins on grid cells, but for nearest().

The right side, which should be the smaller, is copied to the nine cells around each of its points, so that a join on the cell
(and the sample) finds every pair within a cell's width; the distance is the residual condition.
Cells are a shuffle key like any other: no distance matrix, no nested loop, and a crowded cell is
split by adaptive execution.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.vectors import distance
from gridloom.operators.nearest import nearest
from gridloom.session import small, written


def _cell(c: Column, width: float) -> Column:
    return F.floor(c / F.lit(float(width))).cast("bigint")


def grid_pairs(left: DataFrame, right: DataFrame, width: float, on: list[str], how: str = "inner") -> DataFrame:
    """Pairs in the same or adjoining cells with their dist. Columns get the prefixes l_ and r_; those of `on` stay as they are.

    Every pair within `width` is there, and some farther ones. The right side is the one copied.
    """
    a = left.select(*on, *[F.col(c).alias(f"l_{c}") for c in left.columns if c not in on])
    b = right.select(*on, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in on])
    a = a.withColumn("_cx", _cell(F.col("l_x"), width)).withColumn("_cy", _cell(F.col("l_y"), width))
    near = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    b = b.withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(near))
    b = b.withColumn("_cx", _cell(F.col("r_x"), width) + F.col("_dx")).withColumn("_cy", _cell(F.col("r_y"), width) + F.col("_dy")).drop("_dx", "_dy")
    pairs = a.join(b, [*on, "_cx", "_cy"], how).drop("_cx", "_cy")
    return pairs.withColumn("dist", distance(F.col("l_x"), F.col("l_y"), F.col("r_x"), F.col("r_y")))


def radius_join(left: DataFrame, right: DataFrame, radius: float, on: list[str] | None = None) -> DataFrame:
    """All pairs with dist <= radius."""
    return grid_pairs(left, right, radius, on or []).filter(F.col("dist") <= radius)


def nearest_or_fail(left: DataFrame, right: DataFrame, max_distance: float, on: list[str]) -> DataFrame:
    """nearest(), which must not be empty."""
    found = nearest(left, right, max_distance, on)
    if found.isEmpty():
        raise ValueError(f"no points lie within {max_distance} of each other")
    return found


def unassigned_report(left: DataFrame, right: DataFrame, sample: int = 1000) -> dict:
    """Why nothing was assigned: the 10th percentile of nearest distances of some points, and whether the scales differ tenfold."""

    def spans(df):
        return df.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()

    (lx, ly), (rx, ry) = spans(left), spans(right)
    some = left.orderBy(F.xxhash64("id")).limit(sample)
    pairs = right.crossJoin(F.broadcast(some.select(F.col("id").alias("l_id"), F.col("x").alias("l_x"), F.col("y").alias("l_y"))))
    dists = pairs.groupBy("l_id").agg(F.min(distance(F.col("x"), F.col("y"), F.col("l_x"), F.col("l_y"))).alias("d"))
    return {"suggested_distance": dists.agg(F.percentile("d", F.lit(0.1))).first()[0], "scale_mismatch": bool(rx > 10 * lx or ry > 10 * ly)}


def majority_vote(spots: DataFrame, nuclei: DataFrame, radius: float, on: list[str] | None = None, cluster: str = "cluster") -> DataFrame:
    """The spots with the commonest cluster within radius and the number of nuclei there; -1 and 0 where there is none.

    Of equally common clusters the lowest id wins.
    """
    on = on or []
    pairs = radius_join(spots.select(*on, "id", "x", "y"), nuclei.select(*on, "id", "x", "y", cluster), radius, on)
    votes = pairs.groupBy("l_id", f"r_{cluster}").agg(F.count("*").alias("n"))
    won = votes.groupBy("l_id").agg(F.max(F.struct("n", (-F.col(f"r_{cluster}")).alias("c"))).alias("w"), F.sum("n").alias("n_nuclei"))
    won = won.select(F.col("l_id").alias("id"), (-F.col("w.c")).alias("vote"), "n_nuclei")
    return spots.join(won, "id", "left").withColumns({"vote": F.coalesce("vote", F.lit(-1)).cast("int"), "n_nuclei": F.coalesce("n_nuclei", F.lit(0)).cast("bigint")})


def assign_boxes(points: DataFrame, boxes: DataFrame, overlap: str = "last") -> DataFrame:
    """The points with the sample of the box (inclusive) they lie in; outside all, of the nearest centre.

    In several boxes the last by `ord` holds, or with overlap="nearest" the one with the nearest
    centre. boxes: sample, x_min, x_max, y_min, y_max, ord; a handful of rows, which go along.
    """
    cx, cy = (F.col("x_min") + F.col("x_max")) / 2, (F.col("y_min") + F.col("y_max")) / 2
    known = F.broadcast(boxes.agg(F.collect_list(F.struct("sample", "x_min", "x_max", "y_min", "y_max", "ord", cx.alias("cx"), cy.alias("cy"))).alias("_boxes")))
    far = lambda b: distance(F.col("x"), F.col("y"), b["cx"], b["cy"])
    inside = F.filter("_boxes", lambda b: F.col("x").between(b["x_min"], b["x_max"]) & F.col("y").between(b["y_min"], b["y_max"]))
    by_center = lambda a: F.array_min(F.transform(a, lambda b: F.struct(far(b).alias("d"), b["ord"].alias("o"), b["sample"].alias("s"))))["s"]
    last = F.array_max(F.transform(inside, lambda b: F.struct(b["ord"].alias("o"), b["sample"].alias("s"))))["s"]
    within = last if overlap == "last" else by_center(inside)
    return points.crossJoin(known).withColumn("assigned", F.coalesce(within, by_center(F.col("_boxes")))).drop("_boxes")


#: Points that the choice of the first cell width looks at, of all samples together; the edges do not depend on it.
PROBE = 1 << 20


def _frames(own: DataFrame, k: int, on: str) -> DataFrame:
    """on, _x0, _y0, _extent, _n, _level: each sample's frame, and the level (halvings of its extent) of the first cells.

    That is the first level at which a point shares its cell with 2 k + 1 others or fewer in the mean.
    Points are weighed by themselves, so it suits the dense parts; the sparse ones take wider cells later.
    """
    spans = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-9)) * 1.001
    frame = written(own.groupBy(on).agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"), spans.alias("_extent"), F.count("*").alias("_n")), "frames")
    n = frame.agg(F.sum("_n")).first()[0] or 0
    part = min(1.0, PROBE / max(n, 1))
    probe = own.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(part * (1 << 30))) if part < 1 else own
    deepest = F.least(F.lit(40), F.ceil(F.log("_n") / F.log(F.lit(4.0))) + 6).cast("int")
    placed = probe.join(small(frame), on).withColumn("_l", F.explode(F.sequence(F.lit(0), deepest)))
    cells = placed.groupBy(on, "_l", *_place("_l")).agg(F.count("*").cast("double").alias("c"))
    crowd = cells.groupBy(on, "_l").agg((F.sum(F.col("c") * (F.col("c") - 1)) / F.sum("c") / part).alias("others"))
    level = crowd.groupBy(on).agg(F.coalesce(F.min(F.when(F.col("others") <= 2 * k + 1, F.col("_l"))), F.max("_l")).alias("_level"))
    return written(frame.join(level, on, "left").fillna(0, ["_level"]), "levels")


def _place(level: str) -> list[Column]:
    wide = F.col("_extent") / F.pow(F.lit(2.0), F.col(level))
    return [F.floor((F.col(c) - F.col(f"_{c}0")) / wide).cast("bigint").alias(f"_c{c}") for c in ("x", "y")]


def _candidates(left: DataFrame, own: DataFrame, up: int, on: str) -> DataFrame:
    """Pairs of each left point with the points in its cell and those around it, at cells `up` levels above the first."""
    level, near = F.greatest(F.col("_level") - up, F.lit(0)), F.explode(F.array(*[F.lit(d) for d in (-1, 0, 1)]))
    a = left.withColumn("_at", level).select(on, F.col("id").alias("i"), F.col("x").alias("ax"), F.col("y").alias("ay"), *_place("_at"), "_at", "_extent", "_n")
    b = own.withColumn("_at", level).select(on, F.col("id").alias("j"), F.col("x").alias("bx"), F.col("y").alias("by"), *_place("_at"))
    b = b.withColumn("_dx", near).withColumn("_dy", near).withColumn("_cx", F.col("_cx") + F.col("_dx")).withColumn("_cy", F.col("_cy") + F.col("_dy"))
    pairs = a.join(b, [on, "_cx", "_cy"]).filter("i != j").withColumn("dist", distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
    return pairs.select(on, "i", "j", "dist", "_at", "_extent", "_n")


def knn_edges(points: DataFrame, k: int, on: str = "sample") -> DataFrame:
    """on, i, j, dist, rank, w: each point's k nearest others in its sample; ties go to the lowest id, w is 1 / neighbours.

    Rounds of growing cells, of each sample's own width: a point is done when its k-th neighbour lies
    within a cell's width, since all points as near as that were seen; the others try wider cells, until
    a cell holds the whole sample. Only k candidates of a point leave a task.
    """
    own = points.select(on, "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    frame = _frames(own, k, on)
    most = frame.agg(F.max("_level")).first()[0]
    if most is None:
        return points.sparkSession.createDataFrame([], f"{on} string, i bigint, j bigint, dist double, rank int, w double")
    own = written(own.join(small(frame), on), "placed")
    left, found, up = own, [], 0
    while True:
        pairs = _candidates(left, own, up, on)
        rank = F.row_number().over(Window.partitionBy("i").orderBy("dist", "j"))  # with a limit of k before the shuffle
        top = pairs.withColumn("rank", rank).filter(F.col("rank") <= k)
        top = written(top, "nearest")
        whole = (F.col("_at") == 0) | ((F.col("rank") == k) & (F.col("dist") <= F.col("_extent") / F.pow(F.lit(2.0), F.col("_at"))))
        done = top.filter(whole).select("i").distinct()
        found.append(top.join(done, "i", "left_semi").select(on, "i", "j", "dist", "rank", (F.lit(1.0) / F.least(F.lit(k), F.col("_n") - 1)).alias("w")))
        if up >= most:
            break
        left = written(left.join(done.withColumnRenamed("i", "id"), "id", "left_anti"), "left")
        if left.isEmpty():
            break
        up += 1 if up == 0 else 2
    return reduce(DataFrame.unionByName, found)


def band_edges(points: DataFrame, threshold: float, on: str = "sample") -> DataFrame:
    """on, i, j, dist, w: pairs of a sample with 0 < dist <= threshold; w is 1 / neighbours. Islands have no edge."""
    own = points.select(on, "id", "x", "y")
    pairs = radius_join(own, own, threshold, [on]).filter("dist > 0").select(on, F.col("l_id").alias("i"), F.col("r_id").alias("j"), "dist")
    return pairs.withColumn("w", F.lit(1.0) / F.count("*").over(Window.partitionBy("i")))


DELAUNAY_MOST = 50_000


def delaunay_edges(points: DataFrame, on: str = "sample") -> DataFrame:
    """on, i, j, w: neighbours in the Delaunay triangulation of each sample (distinct points; at least three).

    One task per sample, with the incremental algorithm of Bowyer and Watson in numpy; a sample of more
    than DELAUNAY_MOST points is an error, since its triangulation is no work for one task.
    """
    import numpy as np
    import pandas as pd

    large = points.groupBy(on).agg(F.count("*").alias("n")).filter(F.col("n") > DELAUNAY_MOST).first()
    if large:
        raise ValueError(f"a sample has {large['n']} points, more than {DELAUNAY_MOST}: take knn or distance weights")

    def triangulate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").drop_duplicates(["x", "y"])
        p = pdf[["x", "y"]].to_numpy(float)
        ids, n = pdf["id"].to_numpy(), len(pdf)
        empty = pd.DataFrame({on: [], "i": [], "j": []}).astype({on: object, "i": "int64", "j": "int64"})
        if n < 3:
            return empty
        mid, span = p.mean(0), max(np.ptp(p, axis=0).max(), 1e-9)
        p = np.vstack([(p - mid) / span, [[-50, -30], [50, -30], [0, 60]]])
        tri = np.array([[n, n + 1, n + 2]])

        def circles(t):
            a, b, c = p[t[:, 0]], p[t[:, 1]], p[t[:, 2]]
            d = 2 * (a[:, 0] * (b[:, 1] - c[:, 1]) + b[:, 0] * (c[:, 1] - a[:, 1]) + c[:, 0] * (a[:, 1] - b[:, 1]))
            a2, b2, c2 = (a**2).sum(1), (b**2).sum(1), (c**2).sum(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                ux = (a2 * (b[:, 1] - c[:, 1]) + b2 * (c[:, 1] - a[:, 1]) + c2 * (a[:, 1] - b[:, 1])) / d
                uy = (a2 * (c[:, 0] - b[:, 0]) + b2 * (a[:, 0] - c[:, 0]) + c2 * (b[:, 0] - a[:, 0])) / d
            return np.column_stack([ux, uy, (ux - a[:, 0]) ** 2 + (uy - a[:, 1]) ** 2])

        around = circles(tri)
        for i in range(n):
            bad = ~(((around[:, :2] - p[i]) ** 2).sum(1) > around[:, 2] * (1 + 1e-12))
            edges = np.sort(np.concatenate([tri[bad][:, [0, 1]], tri[bad][:, [1, 2]], tri[bad][:, [2, 0]]]), 1)
            rim, times = np.unique(edges, axis=0, return_counts=True)
            rim = rim[times == 1]
            new = np.column_stack([rim, np.full(len(rim), i)])
            tri, around = np.vstack([tri[~bad], new]), np.vstack([around[~bad], circles(new)])
        tri = tri[(tri < n).all(1)]
        edges = np.concatenate([tri[:, [0, 1]], tri[:, [1, 2]], tri[:, [2, 0]]])
        edges = np.unique(np.concatenate([edges, edges[:, ::-1]]), axis=0)
        return pd.DataFrame({on: pdf[on].iloc[0], "i": ids[edges[:, 0]], "j": ids[edges[:, 1]]}) if len(edges) else empty

    found = points.select(on, "id", "x", "y").groupBy(on).applyInPandas(triangulate, f"{on} string, i bigint, j bigint")
    return found.withColumn("w", F.lit(1.0) / F.count("*").over(Window.partitionBy("i")))


def positional_join(*frames: DataFrame, on: str = "nucleus_id") -> DataFrame:
    """Tables that describe the same objects, joined by their id."""
    return reduce(lambda a, b: a.join(b, on), frames)
