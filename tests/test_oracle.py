"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLE = dict(entry.QUERIES), dict(entry.ORACLE)


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF_DIR)
    result = db.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    want = rows(columns, result.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == want
    assert want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
