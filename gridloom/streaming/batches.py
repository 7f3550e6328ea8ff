"""Batch operators on arriving points: each micro-batch goes through an operator into a Parquet folder.

A batch is written to a folder named by its number, overwritten if it comes again after a failure,
so that each point's result is there once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gridloom.operators.clustering import ClusterModel
from gridloom.operators.joins import nearest
from gridloom.session import cleared


def each_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts a query that writes operator(batch) to path/batch=<number>."""

    def write(batch: DataFrame, number: int) -> None:
        with cleared(batch.sparkSession):
            operator(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def assign_stream(stream: DataFrame, spots: DataFrame, max_distance: float, path: str, checkpoint: str) -> StreamingQuery:
    """Arriving points (id, x, y) with their nearest spot of a fixed table."""
    return each_batch(stream, lambda batch: nearest(batch, spots, max_distance), path, checkpoint)


def cluster_stream(stream: DataFrame, v: str, start: ClusterModel, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """One-pass mini-batch k-means of arriving vectors: after each batch the model lies under path/batch=<number>.

    A batch that comes again starts from the model before it, so that no vector counts twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        model = ClusterModel.load(spark, f"{path}/batch={number - 1}") if number else start
        model.partial_fit(batch, v).save(spark, f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
