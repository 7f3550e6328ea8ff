import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"w{i % 7919}" for i in range(60_000))
    rows = [
        (1, "one two three four five six", "en", "a", 27), (2, "one two three four five six", "en", "a", 27), (2, "one two three four five six", "en", "a", 27),
        (3, None, None, None, None), (4, "", "en", None, 0), (5, " \n\t ", None, "b", 4), (None, "no id at all, but words", "fr", "b", 23), (None, "no id at all, but words", "fr", "b", 23),
        (6, "é" * 5 + " mail me at x.y@example.com or +1 (555) 123-4567", "fr", "c", 50), (7, long, "en", "a", len(long)), (8, long + " end", "en", "a", len(long) + 4),
        (9, "One two THREE four five six", "en", "c", 27), (10, "line\nline\nline\n", "en", "c", 15), (10, "another text of the same id", "en", "c", 27), (11, "日本語 <|endoftext|> \x1c ² ▁▁x", "ja", "c", 20),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("score", "_row", "digest", "size", "kept", "length", "text_hash", "label", "key", "g", "part", "node", "_0", "chunk", "_digest", "_key_id", "_gone_id", "_hash", "_size", "_id", "_source", "_of", "_n", "_first", "w", "lines"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
