"""Every registered query beside its SQL, at the smallest scale."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry_points
from check import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return connection


def test_every_query_has_its_sql():
    assert set(entry_points.REGISTRY) <= set(SQL)


@pytest.mark.parametrize("name", sorted(entry_points.REGISTRY))
def test_query(spark, db, name):
    found = entry_points.queries()[name](spark, FOLDER).toPandas()
    assert compare(name, found, db.sql(SQL[name]).df()) == ""


def test_entry(spark):
    assert entry_points.entry(spark).count() == 50
