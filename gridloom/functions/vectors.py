"""Vector columns: arrays of numbers, always taken to DOUBLE before arithmetic."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.session import small, written

EPSILON = 1e-8


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda a, x: a + x * x))


def l2_normalise(v: Column) -> Column:
    # The norm is bound once; inside the lambda it would be computed anew for each element.
    return F.get(F.transform(F.array(norm(v)), lambda n: F.transform(doubles(v), lambda x: x / (n + F.lit(EPSILON)))), F.lit(0))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def detect_scales(columns: list[str], prefix: str = "vit", width: int = 384) -> dict[int, tuple[int, int]]:
    """scale -> (first, last + 1) positions of columns "<prefix><scale>_<i>", by scale.

    Without such names, blocks of `width` columns, numbered from 0; a rest that fills no block is
    left out.
    """
    found: dict[int, list[int]] = {}
    for i, c in enumerate(columns):
        if m := re.fullmatch(rf"{re.escape(prefix)}(\d+)_\d+", c):
            found.setdefault(int(m[1]), []).append(i)
    if found:
        return {s: (min(p), max(p) + 1) for s, p in sorted(found.items())}
    return {k: (k * width, (k + 1) * width) for k in range(len(columns) // width)}


def select_scales(df: DataFrame, scales: list[int], keep: list[str], prefix: str = "vit") -> DataFrame:
    """keep, and the columns of the asked scales in ascending order of scale, whatever order was asked for."""
    own = [c for c in df.columns if c not in keep]
    ranges = detect_scales(own, prefix)
    unknown = [s for s in scales if s not in ranges]
    if unknown:
        raise ValueError(f"no such scales: {unknown}; there are {list(ranges)}")
    return df.select(*keep, *[c for s in sorted(set(scales)) for c in own[slice(*ranges[s])]])


def scale_block(v: Column, blocks: dict[int, tuple[int, int]], scale: int) -> Column:
    first, end = blocks[scale]
    return F.slice(doubles(v), first + 1, end - first)


def fuse(blocks: list[Column], method: str = "concatenate") -> Column:
    """Vectors of several scales as one: end to end, or elementwise average or maximum."""
    if method == "concatenate":
        return F.concat(*[doubles(b) for b in blocks])
    if method == "average":
        total = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), map(doubles, blocks))
        return F.transform(total, lambda x: x / F.lit(float(len(blocks))))
    if method == "max":
        return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y)), map(doubles, blocks))
    raise ValueError(f"unknown fusion: {method}")


def scale_weights(df: DataFrame, v: str, blocks: dict[int, tuple[int, int]]) -> DataFrame:
    """scale, weight: the mean over a scale's dimensions of their population variance, as shares."""
    name = F.element_at(F.create_map(*[x for s, (a, b) in blocks.items() for i in range(a, b) for x in (F.lit(i), F.lit(s))]), F.col("pos"))
    dims = df.select(F.posexplode(doubles(F.col(v)))).groupBy("pos").agg(F.var_pop("col").alias("var"))
    per = dims.withColumn("scale", name).groupBy("scale").agg(F.avg("var").alias("spread"))
    every = F.sum("spread").over(_all())
    return per.select("scale", (F.col("spread") / F.nullif(every, F.lit(0.0))).alias("weight"))


def weighted_fusion(df: DataFrame, v: str, blocks: dict[int, tuple[int, int]], out: str = "fused") -> DataFrame:
    """Scales normalised, weighted by their spread, end to end, and normalised again; one scale stays as it is.

    Two passes: the first finds a weight per scale, a handful of numbers.
    """
    if len(blocks) < 2:
        return df.withColumn(out, doubles(F.col(v)))
    weights = {r["scale"]: r["weight"] for r in scale_weights(df, v, blocks).collect()}

    def weighted(scale: int) -> Column:
        return F.transform(l2_normalise(scale_block(F.col(v), blocks, scale)), lambda x: x * F.lit(weights[scale]))

    joined = df.withColumn("_joined", F.concat(*map(weighted, sorted(blocks))))
    return joined.withColumn(out, l2_normalise(F.col("_joined"))).drop("_joined")


def _all():
    from pyspark.sql import Window

    return Window.partitionBy()


def standardise(df: DataFrame, v: str, out: str = "z", by: list[str] | None = None) -> DataFrame:
    """Each dimension to mean 0 and population deviation 1 (over each group of `by`); constant ones to 0."""
    by = by or []
    dims = df.select(*by, F.posexplode(doubles(F.col(v)))).groupBy(*by, "pos").agg(F.avg("col").alias("mean"), F.stddev_pop("col").alias("std"))
    dims = dims.withColumn("std", F.when(F.col("std") > 0, F.col("std")).otherwise(F.lit(1.0)))
    fit = dims.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "std"))).alias("_fit"))
    joined = df.join(small(written(fit, "scalers")), by) if by else df.crossJoin(F.broadcast(fit))  # one row, as wide as a vector
    return joined.withColumn(out, F.zip_with(doubles(F.col(v)), F.col("_fit"), lambda x, f: (x - f["mean"]) / f["std"])).drop("_fit")
