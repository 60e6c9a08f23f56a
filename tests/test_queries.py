"""Every registered query with an SQL counterpart, against DuckDB on the small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from fathomdoc.plans.registry import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def rows(table):
    names = sorted(table.column_names)
    return sorted(tuple(repr(row[n]) for n in names) for row in table.to_pylist())


#: Approximate by measure, so SQL gives other rows; tests/test_cells.py holds them against the exact search.
APPROXIMATE = {"d3_cell_index_neighbours"}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
@pytest.mark.parametrize("name", [n for n in QUERIES if n not in APPROXIMATE])
def test_query_matches_sql(spark, database, name):
    found = QUERIES[name](spark, FOLDER).toArrow()
    expected = database.sql(SQL[name]).to_arrow_table()
    assert sorted(found.column_names) == sorted(expected.column_names)
    assert rows(found) == rows(expected)


def test_every_query_has_sql():
    assert set(QUERIES) - APPROXIMATE == set(SQL)


def test_entry_registers_them():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
