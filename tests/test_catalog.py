"""Every registered query against its oracle SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare
from conftest import SF_DIR

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_DIR}/{table}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    text, good = compare(spark, con, SF_DIR, name, QUERIES[name], ORACLES.get(name))
    assert good, text


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns[0] == "arn" and rows.count() > 0
