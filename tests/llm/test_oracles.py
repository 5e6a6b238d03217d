"""Queries of the subpackage that SQL can express, on the smallest tables."""

import os

import duckdb
import pytest

from dossier.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    got, want = queries.queries()[name](spark, DATA), con.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    mine = sorted((tuple(r) for r in got.select(*columns).collect()), key=repr)
    assert mine == sorted(want.project(", ".join(columns)).fetchall(), key=repr) and mine
