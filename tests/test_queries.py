"""Every registered query against DuckDB on the same tables, or for its rows where SQL has no equal."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from conftest import DATA

import __spark_entry__ as entry
from gridloom.plans import catalog


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    assert len(a) == len(b)
    cols = sorted(a.columns)
    keys = sorted(cols, key=lambda c: a[c].dtype.kind == "f")
    a, b = (x[cols].sort_values(keys, ignore_index=True) for x in (a, b))
    for c in cols:
        if a[c].dtype.kind in "fiu" and b[c].dtype.kind in "fiu":
            assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=1e-6, atol=2e-6, equal_nan=True), c
        else:
            assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    if name in catalog.ORACLES:
        same(got, duck.execute(catalog.ORACLES[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["sample", "n", "n_a", "n_b", "ari", "nmi", "accuracy", "kappa"]
    assert df.count() == 3


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
