"""Every registered query against its SQL on the smallest data folder."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from vertexloom.plans import queries as registered

FOLDER = "/root/testdata/sf0.001"
SQL = entry_point.oracle_sql()
#: Queries of the optional subpackage without SQL are tested in its own folder.
QUERIES = {k: f for k, f in entry_point.queries().items() if k in SQL or k in registered.ALL}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in sorted(os.listdir(FOLDER)):
        table = file.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{file}'")
    return connection


def ordered(rows):
    return sorted(rows, key=lambda row: [(x is None, str(x)) for x in row])


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, abs_tol=1e-6)
    return a == b


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, duck, name):
    result = QUERIES[name](spark, FOLDER)
    columns = sorted(result.columns)
    found = ordered(tuple(row) for row in result.select(*columns).collect())
    cursor = duck.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    picks = [names.index(c) for c in columns]
    expected = ordered(tuple(row[i] for i in picks) for row in cursor.fetchall())
    assert len(found) == len(expected)
    for a, b in zip(found, expected):
        assert all(map(same, a, b)), (a, b)


def test_entry(spark):
    result = entry_point.entry(spark)
    assert result.columns == ["id", "rank"]
    assert result.count() == 1890
