"""Every registered query with SQL against DuckDB on the smallest test data."""

import datetime as dt
import math
import os

import pytest

from ledgerwatch.catalog import all_checks, all_queries

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from read_parquet('{FOLDER}/{table}.parquet')")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.9g}"
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


def rows_of(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in at) for row in rows)


@pytest.mark.parametrize("name", sorted(all_checks()))
def test_query_matches_sql(spark, duck, name):
    result = all_queries()[name](spark, FOLDER)
    got = rows_of(result.collect(), result.columns)
    cursor = duck.execute(all_checks()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(result.columns)
    assert got == rows_of(cursor.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert rows and sum(r.n for r in rows) > 5000
    assert set(entry.oracle_sql()) <= set(entry.queries())
