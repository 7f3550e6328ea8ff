"""The bounded training sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import fold


def training_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, text, label, key: the rows of at most `most` labelled ids outside fold 0.

    The first ids by md5 among the labelled ones whose hash is under a threshold (with a twentieth
    to spare, so that no task sorts more than a few times the sample), and so the sample is the
    same in each run. Null labels and ids are skipped, and of several labels of an id the largest
    counts. An id whose document repeats has several rows, which one_per_id() brings down to one.
    """
    key = F.md5(F.col("doc_id").cast("string").cast("binary"))
    marked = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    marked = marked.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    n = marked.count()
    if n > 1.05 * most:
        marked = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * 1.05 * most / n))
    chosen = F.broadcast(marked.withColumn("key", key).orderBy("key").limit(most))
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id").select("doc_id", "text", "label", "key")


def one_per_id(vectors: DataFrame) -> DataFrame:
    """key, label, x: the least x of each key, so that the rows are bounded as the ids are."""
    return vectors.groupBy("key", "label").agg(F.min("x").alias("x"))
