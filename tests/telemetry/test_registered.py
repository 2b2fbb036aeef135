"""Every registered telemetry query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from tideline.plans import coverage, telemetry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = telemetry.queries() | coverage.queries(), telemetry.oracle_sql() | coverage.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for table in ("events", "orders", "part"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    ours = QUERIES[name](spark, SF)
    columns = sorted(ours.columns)
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    theirs = sorted(str(tuple(dict(zip(names, r))[c] for c in columns)) for r in cursor.fetchall())
    assert sorted(names) == columns
    assert sorted(str(tuple(r)) for r in ours.select(*columns).collect()) == theirs
