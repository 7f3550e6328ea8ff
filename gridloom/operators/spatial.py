"""Spatial statistics over edge lists (sample, i, j, w) with rows of weights that sum to 1."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from gridloom.operators.joins import band_edges, delaunay_edges, knn_edges
from gridloom.session import small, written

LEAST_POINTS = 10


def two_sided_p(z: Column) -> Column:
    """2 (1 - Phi(|z|)); a row per sample comes here, so Python is no cost."""

    @F.pandas_udf(DoubleType())
    def p(values: pd.Series) -> pd.Series:
        return values.map(lambda v: math.erfc(abs(v) / math.sqrt(2)), na_action="ignore")

    return p(z)


def weights(points: DataFrame, method: str = "knn", k: int = 8, threshold: float | None = None, on: str = "sample") -> DataFrame:
    if method == "knn":
        return knn_edges(points, k, on)
    if method == "distance":
        return band_edges(points, threshold, on)
    if method == "delaunay":
        return delaunay_edges(points, on)
    raise ValueError(f"unknown weights: {method}")


def deviations(points: DataFrame, value: str, on: str = "sample", least: int = LEAST_POINTS) -> DataFrame:
    """on, id, dev: value less its sample's mean, as numbers; samples under `least` points are left out."""
    v = F.col(value).cast("double")
    per = written(points.groupBy(on).agg(F.avg(v).alias("_mean"), F.count("*").alias("_n")).filter(F.col("_n") >= least), "means")
    return points.join(small(per), on).select(on, "id", (v - F.col("_mean")).alias("dev"))


def _lagged(dev: DataFrame, edges: DataFrame, on: str) -> DataFrame:
    """on, i, dev, lag: each point's deviation and the weighted sum of its neighbours'."""
    other = dev.select(F.col("id").alias("j"), F.col("dev").alias("dev_j"))
    lag = edges.join(other, "j").groupBy("i").agg(F.sum(F.col("w") * F.col("dev_j")).alias("lag"), F.sum("w").alias("w"))
    own = dev.select(on, F.col("id").alias("i"), "dev")
    return own.join(lag, "i", "left").withColumns({"lag": F.coalesce("lag", F.lit(0.0)), "w": F.coalesce("w", F.lit(0.0))})


def morans_i(points: DataFrame, edges: DataFrame, value: str, on: str = "sample", least: int = LEAST_POINTS) -> DataFrame:
    """on, n_points, morans_i, expected_i, variance, z_score. The variance, and z with it, is null for 3 points or fewer."""
    s = _lagged(deviations(points, value, on, least), edges, on).groupBy(on).agg(
        F.count("*").alias("n_points"), F.sum("w").alias("ws"), F.sum(F.col("dev") * F.col("lag")).alias("num"), F.sum(F.col("dev") * F.col("dev")).alias("den"))
    n = F.col("n_points").cast("double")
    i = F.when((F.col("den") > 0) & (F.col("ws") > 0), n / F.col("ws") * F.col("num") / F.col("den")).otherwise(F.lit(0.0))
    s = s.withColumn("morans_i", i).withColumn("expected_i", F.lit(-1.0) / F.nullif(n - 1, F.lit(0.0)))
    var = F.when(n > 3, (n * n - 3 * n + 3) / ((n - 1) * (n - 2) * (n - 3)) - F.col("expected_i") * F.col("expected_i"))
    s = s.withColumn("variance", var)
    z = F.when(F.col("variance") > 0, (F.col("morans_i") - F.col("expected_i")) / F.sqrt("variance")).when(F.col("variance").isNotNull(), F.lit(0.0))
    return s.withColumn("z_score", z).select(on, "n_points", "morans_i", "expected_i", "variance", "z_score")


def local_morans_i(points: DataFrame, edges: DataFrame, value: str, on: str = "sample", least: int = LEAST_POINTS) -> DataFrame:
    """on, id, local_i, p_value, z_score, quadrant. No significance test is made: p is 1, z 0 and the quadrant 1 throughout."""
    out = _lagged(deviations(points, value, on, least), edges, on)
    return out.select(on, F.col("i").alias("id"), (F.col("dev") * F.col("lag")).alias("local_i"), F.lit(1.0).alias("p_value"), F.lit(0.0).alias("z_score"), F.lit(1).alias("quadrant"))


def getis_ord_g(points: DataFrame, on: str = "sample", least: int = LEAST_POINTS) -> DataFrame:
    """on, n_points and a statistic that is not computed: all 0, p 1, no hotspots. local_g() is the real one."""
    sizes = points.groupBy(on).agg(F.count("*").alias("n_points")).filter(F.col("n_points") >= least)
    return sizes.select(on, "n_points", F.lit(0.0).alias("global_g"), F.lit(1.0).alias("global_p_value"), F.lit(0).cast("bigint").alias("n_hotspots"))


def local_g(points: DataFrame, edges: DataFrame, value: str, on: str = "sample") -> DataFrame:
    """on, id, g: Getis and Ord's (1992) G of each point, the neighbours' weighted share of the sample's other values (an extension)."""
    totals = written(points.groupBy(on).agg(F.sum(F.col(value).cast("double")).alias("total")), "totals")
    v = points.select(on, "id", F.col(value).cast("double").alias("v")).join(small(totals), on)
    near = edges.join(v.select(F.col("id").alias("j"), F.col("v").alias("vj")), "j").groupBy("i").agg(F.sum(F.col("w") * F.col("vj")).alias("s"))
    return v.join(near, v["id"] == near["i"], "left").select(on, "id", (F.coalesce("s", F.lit(0.0)) / F.nullif(F.col("total") - F.col("v"), F.lit(0.0))).alias("g"))


def analyse(points: DataFrame, value: str, method: str = "knn", k: int = 8, threshold: float | None = None, on: str = "sample", least: int = LEAST_POINTS) -> DataFrame:
    """A row per sample: Moran's I with p, clusters, and the counts of the local statistics; the weights' settings are honoured."""
    edges = weights(points, method, k, threshold, on)
    m = morans_i(points, edges, value, on, least)
    clusters = points.groupBy(on).agg(F.count_distinct(value).alias("n_clusters"))
    return m.withColumn("p_value", F.coalesce(two_sided_p(F.col("z_score")), F.lit(1.0))).join(clusters, on)


def summary(analysed: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Per sample the pattern, and over all samples how many are significant, and the conclusion."""
    sig = F.col("p_value") < alpha
    pattern = F.when(~sig, "random").when(F.col("morans_i") > F.col("expected_i"), "clustering").otherwise("dispersion")
    every = Window.partitionBy()
    out = analysed.withColumn("pattern", pattern).withColumn("n_significant", F.sum(sig.cast("int")).over(every)).withColumn("n_samples", F.count("*").over(every))
    verdict = F.when(F.col("n_significant") * 2 > F.col("n_samples"), "strong").when(F.col("n_significant") > 0, "moderate").otherwise("limited")
    return out.withColumn("evidence", verdict)


def neighbour_purity(points: DataFrame, label: str, neighbours: int = 10, on: str = "sample") -> DataFrame:
    """on, id, label, purity: the share of a point's nearest others (neighbours - 1 of them) with its label."""
    edges = knn_edges(points, neighbours - 1, on)
    own = points.select(F.col("id").alias("i"), F.col(label).alias("li"))
    other = points.select(F.col("id").alias("j"), F.col(label).alias("lj"))
    same = edges.join(own, "i").join(other, "j").groupBy(on, "i", "li").agg(F.avg((F.col("li") == F.col("lj")).cast("double")).alias("purity"))
    return same.select(on, F.col("i").alias("id"), F.col("li").alias(label), "purity")
