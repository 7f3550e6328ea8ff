"""Queries on points that mostly lie within the distance of each other: the SQL's rows, and no pairs on the way."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_queries import same

from gridloom.operators import aggregates as A
from gridloom.plans import catalog


@pytest.fixture(scope="module")
def crowd(tmp_path_factory):
    """A folder with embeddings: a cloud, near copies, and exact copies of one point."""
    r = np.random.default_rng(41)
    v = np.concatenate([r.normal(0, 0.02, (600, 64)), r.normal(0.03, 1e-5, (300, 64)), np.repeat(r.normal(0, 0.02, (1, 64)), 300, 0)]).astype("float32")
    v = r.permutation(v)
    place = tmp_path_factory.mktemp("crowd")
    embedding = pa.array(list(v), pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": pa.array(range(len(v)), pa.int64()), "embedding": embedding, "label": pa.array([i % 9 for i in range(len(v))], pa.int32())}), place / "embeddings.parquet")
    return place


def against_sql(spark, crowd, name):
    df = catalog.QUERIES[name](spark, str(crowd))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "_cx" not in plan and "nearest-" in " ".join(df.inputFiles())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{crowd}/embeddings.parquet')")
    same(df.toPandas(), con.execute(catalog.ORACLES[name]).df())


def test_distance_histogram(spark, crowd):
    against_sql(spark, crowd, "distance_histogram")


def test_success_by_distance(spark, crowd):
    against_sql(spark, crowd, "success_by_distance")


@pytest.mark.parametrize("name", ["spot_mean", "spot_max", "spot_median"])
def test_spot_features(spark, crowd, name, monkeypatch):
    against_sql(spark, crowd, name)
    monkeypatch.setattr(A, "WHOLE", 5)
    against_sql(spark, crowd, name)
