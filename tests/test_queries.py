"""Every query with an oracle against DuckDB on the smallest data."""

import collections
import glob
import os

import numpy as np
import pandas as pd
import pytest

from marginalia.plans import registry

duckdb = pytest.importorskip("duckdb")


def plain(x):
    if isinstance(x, (list, np.ndarray)):
        return tuple(map(plain, x))
    if isinstance(x, float):
        return None if x != x else round(x, 6)
    return None if x is None or x is pd.NaT or x is pd.NA else x.item() if isinstance(x, np.generic) else x


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(df.columns), collections.Counter(tuple(map(plain, r)) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_equals_duckdb(spark, data, duck, name):
    assert rows(registry.queries()[name](spark, data).toPandas()) == rows(duck.sql(registry.oracles()[name]).df())


def test_every_query_runs(spark, data):
    for name in set(registry.queries()) - set(registry.oracles()):
        assert registry.queries()[name](spark, data).columns


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
