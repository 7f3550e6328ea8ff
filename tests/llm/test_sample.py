from pyspark.sql import functions as F

from gridloom.llm.common import fold
from gridloom.llm.labels import one_per_id, training_sample


def test_sample_is_bounded_repeatable_and_outside_fold_0(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(4000).selectExpr("id AS doc_id", "id % 2 AS quality")
    a, b = (training_sample(docs, labels, "quality", 300).collect() for _ in range(2))
    assert 270 <= len(a) <= 300 and sorted(a) == sorted(b)
    every = training_sample(docs, labels, "quality", 10_000)
    assert every.count() == docs.filter(fold(F.col("doc_id")) != 0).count()
    assert every.filter(fold(F.col("doc_id")) == 0).count() == 0


def test_long_and_repeated_texts_are_in_the_sample(spark):
    docs = spark.range(40).selectExpr("id % 20 AS doc_id", "repeat('long text ', 40000) || id AS text")
    labels = spark.range(20).selectExpr("id AS doc_id", "1 AS quality")
    rows = training_sample(docs, labels, "quality", 10_000)
    wanted = docs.select("doc_id").distinct().filter(fold(F.col("doc_id")) != 0).count()
    assert rows.count() == 2 * wanted
    got = one_per_id(rows.withColumn("x", F.col("text").cast("binary"))).collect()
    assert len(got) == wanted
