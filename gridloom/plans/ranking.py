"""Ranking configurations by several quality criteria."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-8
#: Criteria of which more is better; Calinski-Harabasz and Davies-Bouldin have a scale of their own.
HIGHER = ("border", "coherence", "silhouette")


def min_max(c: Column) -> Column:
    every = Window.partitionBy()
    return (c - F.min(c).over(every)) / (F.max(c).over(every) - F.min(c).over(every) + F.lit(EPSILON))


def inverted(c: Column) -> Column:
    """1 / (1 + c), where less was better; a missing value counts as the worst."""
    return F.lit(1.0) / (F.lit(1.0) + F.coalesce(c, F.max(c).over(Window.partitionBy())))


def composite(df: DataFrame) -> DataFrame:
    """df (configuration and any of the criteria) with composite, the sum of the criteria scaled to 0 .. 1, and best."""
    out, names = df, []
    for c in HIGHER:
        if c in df.columns:
            out, names = out.withColumn(f"_{c}", F.coalesce(F.col(c), F.lit(0.0))), [*names, f"_{c}"]
    if "calinski_harabasz" in df.columns:
        out = out.withColumn("_c0", F.coalesce("calinski_harabasz", F.lit(0.0))).withColumn("_ch", min_max(F.col("_c0"))).drop("_c0")
        names.append("_ch")
    if "davies_bouldin" in df.columns:
        out, names = out.withColumn("_db", inverted(F.col("davies_bouldin"))), [*names, "_db"]
    total = sum((min_max(F.col(n)) for n in names), F.lit(0.0))
    out = out.withColumn("composite", total).drop(*names)
    rank = F.row_number().over(Window.orderBy(F.desc("composite"), "configuration"))
    return out.withColumn("best", rank == 1)


def best_by(df: DataFrame, criterion: str, bands: tuple[float, float]) -> DataFrame:
    """One row: the configuration of the largest value, the value, and its band (excellent, good, limited)."""
    top = df.filter(F.col(criterion).isNotNull()).orderBy(F.desc(criterion), "configuration").limit(1)
    band = F.when(F.col(criterion) > bands[0], "excellent").when(F.col(criterion) > bands[1], "good").otherwise("limited")
    return top.select(F.lit(criterion).alias("criterion"), "configuration", F.col(criterion).alias("value"), band.alias("band"))


def strategy(df: DataFrame) -> DataFrame:
    """strategy, mean_composite, best: configurations by the patch sizes in their name, the most specific first."""
    name = F.col("configuration")
    kind = F.when(F.contains(name, F.lit("_16_32_64px")), "multi_scale").when(F.contains(name, F.lit("_16px")), "16px").when(F.contains(name, F.lit("_32px")), "32px").when(F.contains(name, F.lit("_64px")), "64px").otherwise("other")
    means = composite(df).groupBy(kind.alias("strategy")).agg(F.avg("composite").alias("mean_composite"))
    return means.withColumn("best", F.row_number().over(Window.orderBy(F.desc("mean_composite"), "strategy")) == 1)


def recommendations(df: DataFrame) -> DataFrame:
    """criterion, configuration, value, band: the best of each criterion, and of all together."""
    bands = {"border": (0.3, 0.15), "coherence": (0.7, 0.5), "silhouette": (0.5, 0.25)}
    top = composite(df).filter("best").select(F.lit("composite").alias("criterion"), "configuration", F.col("composite").alias("value"), F.lit(None).cast("string").alias("band"))
    for c, b in bands.items():
        if c in df.columns:
            top = top.unionByName(best_by(df, c, b))
    return top
