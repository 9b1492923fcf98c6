"""Every core query against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from keelson.plans import registry

DATA = os.environ.get("KEELSON_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda x: f"{x:.6f}" if isinstance(x, float) else str(x)
    return sorted([cell(r[i]) for i in order] for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in os.listdir(DATA):
        con.execute(f"create view {name[:-8]} as select * from read_parquet('{DATA}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    found = registry.queries()[name](spark, DATA)
    expected = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    assert sorted(columns) == sorted(found.columns)
    assert canonical([tuple(r) for r in found.collect()], found.columns) == canonical(expected.fetchall(), columns)
