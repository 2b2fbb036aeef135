"""The registered queries against their SQL, on small awkward tables and on the driver's smallest ones."""

import os
import random

import duckdb
import pytest
from tests.llm.cases import awkward, frame, words
from tests.llm.test_secrets import HARD
from tests.llm.test_urlrules import URLS, make

from tideline.llm import queries

SF = "/root/testdata/sf0.001"


def same(spark, name, folder):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        path = f"{folder}/{table}.parquet"
        con.execute(f"create view {table} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    ours = queries.queries()[name](spark, folder)
    columns = sorted(ours.columns)
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = [tuple(dict(zip(names, r))[c] for c in columns) for r in cursor.fetchall()]
    assert sorted(map(repr, map(tuple, ours.select(*columns).collect()))) == sorted(map(repr, theirs))
    return theirs


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = f"{tmp_path_factory.mktemp('tables')}"
    shared = words(random.Random(3), 400)
    docs = awkward() + [(200 + i, t, "en", "s0", 1) for i, t in enumerate(HARD)]
    docs += [(300 + i, f"{words(random.Random(i), 20)} {shared[i * 7:]} {shared[:900 - i]}", "de", "s1", 1) for i in range(12)]
    frame(spark, docs).write.parquet(f"{at}/documents.parquet")
    pages, labels, _, _ = make(spark)
    odd = spark.createDataFrame([(1000 + i, u[0]) for i, u in enumerate(URLS)] + [(None, "https://h1.pills-shop.net/x")], "page_id long, url string")
    pages.union(odd).union(odd).write.parquet(f"{at}/pages.parquet")
    labels.write.parquet(f"{at}/labels.parquet")
    return at


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_same_rows_on_awkward_tables(spark, folder, name):
    rows = same(spark, name, folder)
    if name == "op7_urls":  # mined rules are at work
        assert sum(r[0] is not None for r in rows) > 50
    if name == "op2_suffixes":
        assert sum(r[3] > 0 for r in rows) > 12  # n_removed


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_same_rows(spark, name):
    same(spark, name, SF)
