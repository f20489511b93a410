"""Every registered query of the engine's own operators against the same SQL in DuckDB."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tidemark.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
        return None
    return round(x, 6) + 0.0 if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    assert got
    if name in ORACLES:
        sql = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]}) q")
        assert sorted(duck.sql(ORACLES[name]).columns) == columns
        assert got == sorted((tuple(map(plain, r)) for r in sql.fetchall()), key=repr)
