"""How queries are registered, and the stand-in tables that they run on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with the SQL that gives the same rows where SQL can."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def r6(c: Column | str) -> Column:
    """Rounded to six digits, without negative zeros."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def points(spark: SparkSession, sf: str) -> DataFrame:
    """id, x, y, sample, label, v: embeddings as points at their first two dimensions."""
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), (F.lit(1000.0) * e[0].cast("double")).alias("x"), (F.lit(1000.0) * e[1].cast("double")).alias("y"),
        F.concat(F.lit("S"), F.col("vec_id") % 3).alias("sample"), "label", e.alias("v"))


def spots(spark: SparkSession, sf: str) -> DataFrame:
    """All points, stretched and moved: the other side of joins."""
    return points(spark, sf).withColumn("x", F.col("x") * 0.97 + 7).withColumn("y", F.col("y") * 1.02 - 5)


def nuclei(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf)


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Measurements of objects: columns of lineitem as stand-ins for their ranges."""
    c = F.col
    return table(spark, sf, "lineitem").select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("label"), c("l_quantity").alias("area"), (c("l_extendedprice") / 2000).alias("perimeter"),
        (c("l_quantity") * (1 + c("l_tax"))).alias("filled_area"), (1 + c("l_extendedprice") / 10000).alias("major_axis_length"), (c("l_discount") * 100).alias("minor_axis_length"),
        (1 - c("l_tax")).alias("solidity"), (c("l_discount") * 10).alias("eccentricity"))


PIXEL_ROWS, PIXEL_COLS = 48, 64


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """y, x, label, v: 6 * 6 squares, 8 apart, with labels 0 .. 22, on a pattern of intensities."""
    p = spark.range(PIXEL_ROWS * PIXEL_COLS).select(F.floor(F.col("id") / PIXEL_COLS).cast("int").alias("y"), (F.col("id") % PIXEL_COLS).cast("int").alias("x"))
    square = F.floor(F.col("x") / 8) + F.floor(F.col("y") / 8) * 8
    return p.select("y", "x", F.when((F.col("x") % 8 < 6) & (F.col("y") % 8 < 6), square % 23).otherwise(0).cast("int").alias("label"), ((F.col("x") * 7 + F.col("y") * 13) % 256).alias("v"))


PTS = "pts AS (SELECT vec_id AS id, 1000 * CAST(embedding[1] AS DOUBLE) AS x, 1000 * CAST(embedding[2] AS DOUBLE) AS y, 'S' || (vec_id % 3) AS sample, label, embedding AS v FROM embeddings)"
SPOTS = f"{PTS}, spots AS (SELECT * REPLACE (x * 0.97e0 + 7 AS x, y * 1.02e0 - 5 AS y) FROM pts), nuclei AS (SELECT * FROM pts)"
DIMS = f"{PTS}, dims AS (SELECT id, sample, label, unnest(range(64)) AS pos, CAST(unnest(v) AS DOUBLE) AS val FROM pts)"
DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
METRICS = """m AS (SELECT l_orderkey * 10 + l_linenumber AS label, l_quantity AS area, l_extendedprice / 2000 AS perimeter, l_quantity * (1 + l_tax) AS filled_area,
  1 + l_extendedprice / 10000 AS major_axis_length, l_discount * 100 AS minor_axis_length, 1 - l_tax AS solidity, l_discount * 10 AS eccentricity FROM lineitem),
d AS (SELECT *, major_axis_length / nullif(minor_axis_length, 0) AS aspect_ratio, (filled_area - area) / nullif(area, 0) AS hole_fraction,
  CASE WHEN perimeter <> 0 THEN least(1, greatest(0, 4 * pi() * area / (perimeter * perimeter))) END AS circularity FROM m)"""
PIX = f"pix AS (SELECT y, x, CASE WHEN x % 8 < 6 AND y % 8 < 6 THEN ((x // 8) + (y // 8) * 8) % 23 ELSE 0 END AS label, (x * 7 + y * 13) % 256 AS v FROM range({PIXEL_ROWS}) a(y), range({PIXEL_COLS}) b(x))"
