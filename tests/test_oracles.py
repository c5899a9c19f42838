"""Every registered query of the library against the SQL beside it."""

import os

import duckdb
import pytest

from latticework.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for name in os.listdir(SF):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 9))
    return "null" if value is None else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(tuple(map(plain, r)) for r in got.select(columns).collect())
    if name in ORACLES:
        found = duck.sql(ORACLES[name])
        assert sorted(found.columns) == columns
        want = sorted(tuple(map(plain, r)) for r in found.project(", ".join(f'"{c}"' for c in columns)).fetchall())
        assert rows == want
