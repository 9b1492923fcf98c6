"""The queries of this subpackage that SQL can express, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from keelson.llm import queries

DATA = os.environ.get("KEELSON_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for file in os.listdir(DATA):
        con.execute(f"create view {file[:-8]} as select * from read_parquet('{DATA}/{file}')")
    expected = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in expected.description]
    found = queries.QUERIES[name](spark, DATA).select(*columns)
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, expected.fetchall()))
