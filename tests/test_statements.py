"""Queries against their DuckDB statements on the smallest tables: searches, sweeps, and what sources and sinks write."""

import math
import os

import duckdb
import pytest

from fernway.plans import catalogue, stored

TABLES = "/root/testdata/sf0.001"
SEARCHES = ("pure_ml_cost", "robust_route", "experiment_values", "experiment_values_summary", "experiment_values_pareto")
STORED = tuple(n for n, f in catalogue.QUERIES.items() if f.__module__ == stored.__name__)

pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(TABLES):
        connection.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS FROM '{TABLES}/{file}'")
    return connection


def _rows(names, rows):
    """Rows as tuples in the order of the columns' names, sorted; NaN equals itself."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple("NaN" if isinstance(r[i], float) and math.isnan(r[i]) else repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", SEARCHES + STORED)
def test_query_gives_the_statements_rows(spark, duck, name):
    got = catalogue.QUERIES[name](spark, TABLES)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = _rows(got.columns, [tuple(r) for r in got.collect()])
    assert rows and rows == _rows(want.columns, want.fetchall())
