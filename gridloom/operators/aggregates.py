"""Aggregates over points and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.vectors import distance, doubles
from gridloom.session import small, written

METHODS = {"mean": F.avg, "median": F.median, "max": F.max}


#: Rows of a group up to which its vectors are aggregated whole, in one row.
WHOLE = 1 << 14


def _middle(x: Column) -> Column:
    """Median of an array of doubles."""
    n = F.size(x)
    low, high = F.get(x, F.floor((n - 1) / 2).cast("int")), F.get(x, F.floor(n / 2).cast("int"))
    return F.when(low == high, low).otherwise(low * 0.5 + high * 0.5)


#: Of the values of a dimension, an array of doubles without nulls.
WHOLES = {
    "mean": lambda x: F.aggregate(x, F.lit(0.0), lambda a, e: a + e) / F.nullif(F.size(x), F.lit(0)),
    "median": lambda x: F.get(F.transform(F.array(F.sort_array(x)), _middle), F.lit(0)),
    "max": F.array_max,
}


def vector_aggregate(df: DataFrame, by: list[str], v: str, method: str = "mean", out: str = "agg", rows: DataFrame | None = None) -> DataFrame:
    """by, out: the elementwise mean, median or maximum of the vectors of each group.

    The vectors of a group travel as they are; only those of groups of more than WHOLE rows are dealt out by dimension, as
    partial aggregates. rows: by and the n rows of each group, where that is known.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}; there are {', '.join(METHODS)}")
    rows = df.groupBy(*by).agg(F.count("*").alias("n")) if rows is None else rows
    large = written(rows.filter(F.col("n") > WHOLE).select(*by), "large")
    some = not large.isEmpty()
    few = df.join(small(large), by, "left_anti") if some else df
    width, values = F.array_max(F.transform("_vs", F.size)), lambda i: F.array_compact(F.transform("_vs", lambda a: F.get(a, i).cast("double")))
    whole = few.groupBy(*by).agg(F.collect_list(v).alias("_vs")).withColumn("_w", width).filter("_w > 0")
    whole = whole.select(*by, F.transform(F.sequence(F.lit(1), "_w"), lambda i: WHOLES[method](values(i - 1))).alias(out))
    if not some:
        return whole
    dims = df.join(small(large), by, "left_semi").select(*by, F.posexplode(doubles(F.col(v)))).groupBy(*by, "pos").agg(METHODS[method]("col").alias("_v"))
    return whole.unionByName(dims.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_v"))), lambda s: s["_v"]).alias(out)))


def spot_features(assigned: DataFrame, features: DataFrame, method: str = "mean", least: int = 1, meta: tuple[str, ...] = ()) -> DataFrame:
    """Per spot: n_nuclei, mean_distance, the aggregate of its nuclei's vectors, and meta (of its first nucleus).

    assigned: nucleus_id, spot_id, dist, meta; features: nucleus_id, v. Spots with fewer than
    `least` nuclei are left out.
    """
    first = F.min_by(F.struct("nucleus_id", *meta), "nucleus_id")
    sizes = assigned.groupBy("spot_id").agg(F.count("*").alias("n_nuclei"), F.avg("dist").alias("mean_distance"), first.alias("_first"))
    sizes = sizes.filter(F.col("n_nuclei") >= least).select("spot_id", "n_nuclei", "mean_distance", *[F.col(f"_first.{m}").alias(m) for m in meta])
    sizes = written(sizes, "sizes")
    kept = assigned.select("nucleus_id", "spot_id").join(sizes, "spot_id", "left_semi")
    joined = kept.join(features.select("nucleus_id", "v"), "nucleus_id")
    return sizes.join(vector_aggregate(joined, ["spot_id"], "v", method, rows=sizes.select("spot_id", F.col("n_nuclei").alias("n"))), "spot_id")


def bounds(points: DataFrame, by: str = "sample") -> DataFrame:
    """Bounding box of each sample, with the middle of the range."""
    box = points.groupBy(by).agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.count("*").alias("n_points"))
    return box.withColumn("x_center", (F.col("x_min") + F.col("x_max")) / 2).withColumn("y_center", (F.col("y_min") + F.col("y_max")) / 2)


def coordinate_overlap(a: DataFrame, b: DataFrame, by: str = "sample") -> DataFrame:
    """Per sample of both: overlap of the ranges on each axis, as a length and per cent of the wider range; good if over 50 on both."""
    p = bounds(a, by).select(by, *[F.col(c).alias(f"a_{c}") for c in ("x_min", "x_max", "y_min", "y_max")])
    q = bounds(b, by).select(by, *[F.col(c).alias(f"b_{c}") for c in ("x_min", "x_max", "y_min", "y_max")])
    out = p.join(q, by)
    for s in ("x", "y"):
        width = F.greatest(F.lit(0.0), F.least(f"a_{s}_max", f"b_{s}_max") - F.greatest(f"a_{s}_min", f"b_{s}_min"))
        most = F.greatest(F.col(f"a_{s}_max") - F.col(f"a_{s}_min"), F.col(f"b_{s}_max") - F.col(f"b_{s}_min"))
        out = out.withColumn(f"{s}_overlap", width).withColumn(f"{s}_pct", F.when(most > 0, F.col(f"{s}_overlap") / most * 100).otherwise(F.lit(0.0)))
    return out.withColumn("good", (F.col("x_pct") > 50) & (F.col("y_pct") > 50))


def scale_ratios(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: span of a by span of b on each axis; null where b has none."""
    p = a.agg((F.max("x") - F.min("x")).alias("ax"), (F.max("y") - F.min("y")).alias("ay"))
    q = b.agg((F.max("x") - F.min("x")).alias("bx"), (F.max("y") - F.min("y")).alias("by"))
    return p.crossJoin(q).select((F.col("ax") / F.nullif("bx", F.lit(0.0))).alias("x_ratio"), (F.col("ay") / F.nullif("by", F.lit(0.0))).alias("y_ratio"))


def contingency(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """by, a, b, n: counts of pairs of labels, the cells that occur."""
    return df.groupBy(*(by or []), F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def row_proportions(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Cells with each one's share of its row."""
    return cells.withColumn("share", F.col("n").cast("double") / F.sum("n").over(Window.partitionBy(*(by or []), "a")))


def best_match(cells: DataFrame) -> DataFrame:
    """a, total, best_b (the lowest, where several are most), best_n, fraction."""
    rows = cells.groupBy("a").agg(F.sum("n").alias("total"), F.max("n").alias("best_n"))
    top = cells.join(rows, "a").filter("n = best_n").groupBy("a", "total", "best_n").agg(F.min("b").alias("best_b"))
    return top.select("a", "total", "best_b", "best_n", (F.col("best_n").cast("double") / F.col("total")).alias("fraction"))


def label_histogram(df: DataFrame, label: str) -> DataFrame:
    """label, n for 0 .. the largest label, those that do not occur with 0."""
    counts = df.groupBy(F.col(label).cast("int").alias("label")).agg(F.count("*").alias("n"))
    most = counts.agg(F.max("label")).first()[0]  # one number; the labels themselves are made where they are joined
    every = df.sparkSession.range(0 if most is None else most + 1).select(F.col("id").cast("int").alias("label"))
    return every.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def describe(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """count, mean, sample deviation, least, quartiles (exact, by linear interpolation), most."""
    c = F.col(column).cast("double")
    q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*(by or [])).agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), q.alias("_q"), F.max(c).alias("max"))
    return out.select(*(by or []), "count", "mean", "std", "min", *[F.col("_q")[i].alias(n) for i, n in enumerate(("p25", "p50", "p75"))], "max")


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """bin, n, low, high: equal bins from the least to the largest value, the last one closed; empty bins are left out."""
    c = F.col(column)
    ends = F.broadcast(df.agg(F.min(column).cast("double").alias("_lo"), F.max(column).cast("double").alias("_hi")))
    width = F.col("_hi") - F.col("_lo")
    at = F.least(F.lit(bins - 1), F.floor((c - F.col("_lo")) / F.nullif(width, F.lit(0.0)) * bins))
    out = df.filter(c.isNotNull()).crossJoin(ends).groupBy(at.cast("bigint").alias("bin"), "_lo", "_hi").agg(F.count("*").alias("n"))  # ends is one row
    return out.select("bin", "n", (F.col("_lo") + width * F.col("bin") / bins).alias("low"), (F.col("_lo") + width * (F.col("bin") + 1) / bins).alias("high"))


def is_border(x: Column, y: Column, width: float, height: float, threshold: float) -> Column:
    return (x <= threshold) | (x >= width - threshold) | (y <= threshold) | (y >= height - threshold)


def border_quality(points: DataFrame, label: str, width: float, height: float, threshold: float) -> DataFrame:
    """One row: how far clusters gather the points near the image's border. Without such points the cluster figures are null."""
    marked = points.withColumn("_b", is_border(F.col("x"), F.col("y"), width, height, threshold).cast("double"))
    per = marked.groupBy(label).agg(F.avg("_b").alias("share"), F.count("*").alias("n"), F.sum("_b").alias("nb"))
    out = per.agg(
        F.sum("n").alias("total"), F.sum("nb").cast("bigint").alias("border"), F.max("share").alias("max_concentration"), F.avg("share").alias("mean_concentration"),
        F.stddev_pop("share").alias("imbalance"), F.count(F.when(F.col("share") > 0.7, 1)).alias("high_clusters"), F.count("*").alias("k"))
    high = F.col("high_clusters").cast("double") / F.col("k")
    some = lambda c: F.when(F.col("border") > 0, c)
    return out.select(
        "total", "border", (F.col("total") - F.col("border")).alias("interior"), (F.col("border").cast("double") / F.col("total")).alias("border_fraction"),
        some(F.col("max_concentration")).alias("max_concentration"), some(F.col("mean_concentration")).alias("mean_concentration"), some(F.col("imbalance")).alias("imbalance"),
        some(F.col("high_clusters")).alias("high_clusters"), some(high).alias("high_fraction"), some(F.col("mean_concentration") * 0.6 + high * 0.4).alias("quality"))


def size_balance(points: DataFrame, label: str) -> DataFrame:
    """One row: k, least and most, their ratio, and the coefficient of variation of cluster sizes."""
    sizes = points.groupBy(label).agg(F.count("*").cast("double").alias("n"))
    out = sizes.agg(F.count("*").alias("k"), F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.avg("n").alias("m"), F.stddev_pop("n").alias("s"))
    return out.select("k", "min_size", "max_size", (F.col("max_size") / F.col("min_size")).alias("size_ratio"), (F.col("s") / F.col("m")).alias("size_cv"))


def center_separation(points: DataFrame, label: str, v: str = "v") -> DataFrame:
    """One row: least and mean distance of the clusters' mean vectors, and most by least. A pair of clusters and a dimension is a row."""
    c = points.select(F.col(label).alias("_c"), F.posexplode(doubles(F.col(v))).alias("pos", "_x")).groupBy("_c", "pos").agg(F.avg("_x").alias("m"))
    other = c.select(F.col("_c").alias("_d"), "pos", F.col("m").alias("m2"))
    pairs = c.join(other, "pos").filter(F.col("_c") < F.col("_d"))
    d = pairs.groupBy("_c", "_d").agg(F.sqrt(F.sum((F.col("m") - F.col("m2")) * (F.col("m") - F.col("m2")))).alias("d"))
    return d.agg(F.min("d").alias("min_separation"), F.avg("d").alias("mean_separation"), (F.max("d") / F.nullif(F.min("d"), F.lit(0.0))).alias("separation_ratio"))


def success_by_distance(dists: DataFrame, thresholds: tuple[float, ...] = (100, 200, 500, 1000, 2000), enough: float = 0.8) -> DataFrame:
    """threshold, n, share of distances within it, and whether it is the first with enough of them. dists: dist (null: none found)."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")
    out = dists.select("dist", t).groupBy("threshold").agg(F.count(F.when(F.col("dist") <= F.col("threshold"), 1)).alias("n"), F.count("*").alias("total"))
    out = out.withColumn("share", F.col("n").cast("double") / F.col("total")).drop("total")
    first = F.min(F.when(F.col("share") >= enough, F.col("threshold"))).over(Window.partitionBy())
    return out.withColumn("chosen", F.coalesce(F.col("threshold") == first, F.lit(False)))
