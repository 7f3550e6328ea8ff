"""Derived columns: codes, zones, flipped axes, renamed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Cell type to tissue zone.
ZONES = {
    "PT-S1/S2": "cortex", "DCT": "cortex", "CNT": "cortex", "glomeruli": "cortex",
    "PT-S3": "outer_medulla", "TAL": "medulla", "collecting duct": "medulla", "interstitial cells": "interstitial",
    "FR-PT": "injury", "Injured tubule": "injury", "undetermined": "other", "gaps": "other",
}


def zone(cell_type: Column) -> Column:
    """The zone of a cell type; null for one that is not listed."""
    return F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv])[cell_type]


def encode_labels(df: DataFrame, label: str, out: str = "code") -> DataFrame:
    """df with codes 0 .. k - 1 of the sorted distinct labels; a null label has none.

    Ranks are taken over the distinct labels, not over the rows.
    """
    codes = df.select(F.col(label).alias("_label")).filter(F.col(label).isNotNull()).distinct()
    codes = codes.withColumn(out, (F.row_number().over(Window.orderBy("_label")) - 1).cast("bigint"))
    return df.join(codes, F.col(label) == F.col("_label"), "left").drop("_label")


def flip_y(points: DataFrame, by: str = "sample") -> DataFrame:
    """points with y counted from the top of their sample; the tops are an aggregate, so a large sample is no single task."""
    top = points.groupBy(F.col(by).alias("_by")).agg(F.max("y").alias("_top"))
    return points.join(top, F.col(by).eqNullSafe(F.col("_by"))).withColumn("y", F.col("_top") - F.col("y")).drop("_by", "_top")


def as_spots(points: DataFrame, condition: str = "IRI") -> DataFrame:
    """points (id, x, y, ...) under the names of the spot table, with a condition if they have none."""
    out = points.withColumnsRenamed({"id": "spot_id", "x": "spot_x", "y": "spot_y", "x_center": "spot_x", "y_center": "spot_y"})
    return out if "condition" in out.columns else out.withColumn("condition", F.lit(condition))
