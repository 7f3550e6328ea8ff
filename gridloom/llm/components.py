"""Connected components on DataFrames, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import stage, unstage


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of edges(u, v); no order of u and v is asked for.

    Each round points a node's larger neighbours, then its smaller ones, to the smallest, until no
    edge changes; a round is two aggregates and two joins, written to the shared folder. The sums are
    written before they are joined, so that adaptive execution can split a node with many edges.
    Nothing but a count and a checksum comes to the driver.
    """
    now = stage(_pointed(edges.select("u", "v")), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(_pointed(large), "large")
        lower = stage(large.groupBy("u").agg(F.min("v").alias("m")), "lower")
        small = large.join(lower, "u")
        small = small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v")))
        after = stage(_pointed(small), "edges")
        unstage(now, least, large, lower)
        now = after
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        seen = mark
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def _pointed(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller node."""
    return edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
