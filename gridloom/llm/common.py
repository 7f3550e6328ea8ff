"""What the operators share: staged tables, word patterns and small column helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of the contracts, in Java's, Python's and RE2's syntax alike.
WORD = r"[^\x20\x09-\x0D]+"

_TABLES = ("documents", "labels", "benchmark", "pages", "conversations", "embeddings")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in _TABLES:
        raise ValueError(f"no such table: {name}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder and any other master a folder in
    the warehouse, which all executors share.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        if local:
            own = tempfile.mkdtemp(prefix="stages-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            named = f"file://{own}"
        else:
            named = f"{spark.conf.get('spark.sql.warehouse.dir')}/_stages"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_staged: list[str] = []


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder, if it is there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def drop_staged(spark: SparkSession) -> None:
    """Deletes what stage() has written in this process; results that still read it must be written before."""
    while _staged:
        delete(spark, _staged.pop())


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: it cuts lineage, outlives executors
    and gives values such as monotonically_increasing_id() once and for all."""
    spark = df.sparkSession
    path = new_path(spark, name)
    _staged.append(path)
    df.write.option("compression", "zstd").parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._staged_at = path
    return again


def unstage(*tables: DataFrame) -> None:
    """Deletes tables that stage() has returned; nothing may read them any more."""
    for df in tables:
        if df._staged_at in _staged:
            _staged.remove(df._staged_at)
            delete(df.sparkSession, df._staged_at)


def staged_alone(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """Stages what build() gives, and deletes the tables that were staged on the way."""
    before = set(_staged)
    out = stage(build(), name)
    for path in [x for x in _staged if x not in before and x != out._staged_at]:
        _staged.remove(path)
        delete(out.sparkSession, path)
    return out


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """Hands texts to Python workers in batches of at most so many rows, so that a worker stays small."""
    conf = df.sparkSession.conf
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, str(rows))
    return df


def pick(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns only, with a row number that holds once staged; other columns can't clash."""
    kinds = {"text": "string", "lang": "string", "source": "string"}
    cols = [docs[n].cast(kinds[n]).alias(n) if n in kinds else docs[n].alias(n) for n in names]
    return small_batches(docs).select(*cols).withColumn("_row", F.monotonically_increasing_id())


def masked(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list[Column]]:
    """docs under column names of its own, so that no added name can clash; those names; and what gives the old ones back."""
    own = {c: f"c{i}_of_docs" for i, c in enumerate(docs.columns)}
    return docs.toDF(*own.values()), own, [F.col(v).alias(k) for k, v in own.items()]


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def fold(doc_id: Column, mod: int = 5) -> Column:
    """crc32(doc_id as text) mod 5, the contracts' fold; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod, F.lit(0))


def let(value: Column, body) -> Column:
    """Binds a value once for a lambda that uses it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sum(df: DataFrame, group: list[str], chunk: str, order: list, value: Column, name: str) -> DataFrame:
    """df with the sum of value before each row, within group in the order of chunk, then of order.

    In two levels, the sums of chunks and those within a chunk, so that a large group is no single
    task; what a task has of a group is a row per chunk.
    """
    sums = df.groupBy(*group, chunk).agg(F.sum(value).alias("_sum"))
    before = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy(*group).orderBy(chunk)) - F.col("_sum")).drop("_sum")
    within = Window.partitionBy(*group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = df.withColumn("_in", F.sum(value).over(within) - value).join(before, [*group, chunk])
    return both.withColumn(name, F.col("_before") + F.col("_in")).drop("_before", "_in")


def small(df: DataFrame, rows: int) -> DataFrame:
    """Marks a table for broadcast if it has at most so many rows; else leaves the join to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def split_join(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """The inner join of rows to other, which has a row per key, without a task for a frequent key.

    Keys with a ten-thousandth of the rows or more, so at most 10,000, are joined by broadcast, the
    others by shuffle. Both tables must be staged, since they are read more than once.
    """
    often = max(100, rows.count() // 10_000)
    hot = rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") >= often).select(key)
    hot = F.broadcast(stage(hot, "often"))
    first = rows.join(F.broadcast(other.join(hot, key)), key)
    return first.unionByName(rows.join(hot, key, "left_anti").join(other, key))
