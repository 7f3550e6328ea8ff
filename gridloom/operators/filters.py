"""Range filters over measurements of segmented objects."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


@dataclass(frozen=True)
class Thresholds:
    """Inclusive ranges. An infinite end is no bound at all."""

    pixels: tuple[float, float] = (0, 1e9)
    circularity: tuple[float, float] = (0.0, 1.0)
    solidity: tuple[float, float] = (0.0, 1.0)
    eccentricity: tuple[float, float] = (0.0, 1.0)
    aspect_ratio: tuple[float, float] = (0.0, INF)
    hole_fraction: tuple[float, float] = (0.0, 1.0)
    mean_intensity: tuple[float, float] = (-INF, INF)
    exclude_border: bool = False

    def validate(self) -> Thresholds:
        for name in ("pixels", "circularity", "solidity", "eccentricity", "hole_fraction"):
            low, high = getattr(self, name)
            if not (0 <= low <= high and (name == "pixels" or high <= 1)):
                raise ValueError(f"invalid range of {name}: {low} to {high}")
        return self


def derived(df: DataFrame, height: int | None = None, width: int | None = None) -> DataFrame:
    """Adds aspect_ratio, hole_fraction, circularity and, for a known image size, border_touch.

    A zero divisor gives null. bbox_2 and bbox_3 are exclusive ends.
    """
    c = F.col
    round_ = F.lit(4.0) * F.pi() * c("area") / F.nullif(c("perimeter") * c("perimeter"), F.lit(0.0))
    out = df.withColumns({
        "aspect_ratio": c("major_axis_length") / F.nullif(c("minor_axis_length"), F.lit(0.0)),
        "hole_fraction": (c("filled_area") - c("area")).cast("double") / F.nullif(c("area").cast("double"), F.lit(0.0)),
        "circularity": F.when(round_.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), round_))),
    })
    if height is None or width is None:
        return out
    return out.withColumn("border_touch", (c("bbox_0") <= 0) | (c("bbox_1") <= 0) | (c("bbox_2") >= height) | (c("bbox_3") >= width))


def within(column: Column, low: float, high: float) -> Column | None:
    """column in [low, high], without the infinite ends; None if both are."""
    parts = [column >= F.lit(low)] if low != -INF else []
    parts += [column <= F.lit(high)] if high != INF else []
    return reduce(lambda a, b: a & b, parts) if parts else None


def passed(df: DataFrame, th: Thresholds) -> DataFrame:
    """Adds passed: every range holds; null fails, so that the rest is the complement."""
    th.validate()
    names = {"area": th.pixels, "circularity": th.circularity, "solidity": th.solidity, "eccentricity": th.eccentricity, "aspect_ratio": th.aspect_ratio, "hole_fraction": th.hole_fraction}
    if "mean_intensity" in df.columns:
        names["mean_intensity"] = th.mean_intensity
    tests = [F.col(n).isNotNull() & (t if (t := within(F.col(n), *r)) is not None else F.lit(True)) for n, r in names.items() if n != "mean_intensity" or r != (-INF, INF)]
    if th.exclude_border:
        tests.append(~F.col("border_touch"))
    return df.withColumn("passed", F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False)))


def excluded_counts(df: DataFrame, th: Thresholds) -> DataFrame:
    """metric, n_outside, n_missing: how many rows each range excludes by itself, and how many lack the metric."""
    names = {"area": th.pixels, "circularity": th.circularity, "solidity": th.solidity, "eccentricity": th.eccentricity, "aspect_ratio": th.aspect_ratio, "hole_fraction": th.hole_fraction}
    counts = []
    for name, r in names.items():
        test = within(F.col(name), *r)
        out = F.count(F.when(~test, 1)) if test is not None else F.lit(0)
        counts.append(F.struct(F.lit(name).alias("metric"), out.cast("bigint").alias("n_outside"), F.count(F.when(F.col(name).isNull(), 1)).alias("n_missing")))
    return df.agg(F.array(*counts).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def in_samples(df: DataFrame, samples: list[str], column: str = "sample", fail_empty: bool = False) -> DataFrame:
    out = df.filter(F.col(column).isin(samples))
    if fail_empty and out.isEmpty():
        raise ValueError(f"no rows of the samples {samples}")
    return out


def match_samples(df: DataFrame, samples: list[str], column: str = "sample") -> DataFrame:
    """Rows of each wanted sample, renamed to it: exact matches, else the values that hold its name in any case."""
    have = [r[0] for r in df.select(column).distinct().orderBy(column).collect()]  # a value per sample
    parts = []
    for s in samples:
        hit = [s] if s in have else [h for h in have if h and s.lower() in h.lower()][:1]
        parts += [df.filter(F.col(column) == h).withColumn(column, F.lit(s)) for h in hit]
    return reduce(DataFrame.unionByName, parts) if parts else df.limit(0)


def large_groups(df: DataFrame, by: list[str], least: int, strict: bool = False) -> DataFrame:
    """Rows of the groups with at least (or more than) so many rows."""
    n = df.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > least if strict else F.col("_n") >= least)
    return df.join(n.select(*by), by, "left_semi")


def region_slice(height: int, width: int, region: tuple[float, float, float, float], clamp: bool = True) -> tuple[int, int, int, int]:
    """(y0, y1, x0, x1) in pixels from fractions (y0, y1, x0, x1), truncated."""
    y0, y1, x0, x1 = region
    out = [int(y0 * height), int(y1 * height), int(x0 * width), int(x1 * width)]
    if clamp:
        out = [min(max(0, v), most) for v, most in zip(out, (height, height, width, width), strict=True)]
    return tuple(out)


def crop(pixels: DataFrame, box: tuple[float, float, float, float], height: int, width: int) -> DataFrame:
    """Pixels of a box (y0, y1, x0, x1): fractions if all are in [0, 1], else pixels; an empty box is an error."""
    y0, y1, x0, x1 = region_slice(height, width, box) if all(0 <= v <= 1 for v in box) else (max(0, int(box[0])), min(height, int(box[1])), max(0, int(box[2])), min(width, int(box[3])))
    if y1 <= y0 or x1 <= x0:
        raise ValueError(f"the box is empty: {box}")
    return pixels.filter((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1))
