"""Sessions, schemas and row identity."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POINTS = "id BIGINT, x DOUBLE, y DOUBLE, sample STRING, label INT"
COORDS = "nucleus_id BIGINT, x_center INT, y_center INT"
SPOTS = "spot_id BIGINT, x DOUBLE, y DOUBLE, sample STRING, condition STRING, figure_idents STRING, banksy DOUBLE"
FEATURES = "nucleus_id BIGINT, scale INT, v ARRAY<FLOAT>"
PIXELS = "y INT, x INT, label INT"
BOXES = "sample STRING, x_min DOUBLE, x_max DOUBLE, y_min DOUBLE, y_max DOUBLE, ord INT"


def session(name: str = "gridloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators' SQL is written for."""
    builder = SparkSession.builder.appName(name)
    builder = builder.master(master) if master else builder
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return builder.config(map=settings | conf).getOrCreate()


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, if it has the columns; else a ValueError that names the missing ones."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


_open = threading.local()


@contextmanager
def cleared(spark: SparkSession):
    """Tables that this thread writes to scratch() paths within are deleted at the end."""
    made: list[str] = []
    outer = getattr(_open, "made", ())
    _open.made = (*outer, made)
    try:
        yield
    finally:
        _open.made = outer
        for path in made:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder, and any other one in the warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if spark.sparkContext.master.startswith("local"):
            own = tempfile.mkdtemp(prefix="scratch-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            named = f"file://{own}"
        else:
            named = f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
        spark.conf.set("spark.checkpoint.dir", named)
    path = f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for made in getattr(_open, "made", ()):
        made.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: it is computed once and outlives executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """A written table, marked for broadcast if it has at most so many rows; else the join is left to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def with_ids(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Consecutive ids from 0 in the order of the columns, without a single-task sort; rows equal in these are ordered by the others.

    Range partitions are written and counted, and a row's id is its place in its partition plus the
    rows of the partitions before.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64(*df.columns)
    dealt = written(df.withColumn("_tie", tie).repartitionByRange(n, *order, "_tie").withColumn("_part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")  # a row per partition
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order, "_tie")) - 1
    out = dealt.withColumn("_place", place).join(F.broadcast(before), "_part")
    return out.withColumn(name, (F.col("_before") + F.col("_place")).cast("bigint")).drop("_part", "_place", "_before", "_tie")


def same_length(a: DataFrame, b: DataFrame) -> None:
    """Tables that describe the same objects row by row must be of equal length."""
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"tables of {n} and {m} rows do not match")
