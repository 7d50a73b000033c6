"""Queries with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from trackgrid.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df, want = queries.QUERIES[name](spark, DATA), con.sql(queries.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    order = [want.columns.index(c) for c in cols]
    norm = lambda v: f"{v:.9f}" if isinstance(v, float) else str(v)
    assert sorted(str([norm(r[c]) for c in cols]) for r in df.collect()) == sorted(str([norm(r[i]) for i in order]) for r in want.fetchall())
