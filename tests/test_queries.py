"""Every registered query with SQL gives DuckDB's rows at the smallest size."""

import datetime
import os
from decimal import Decimal

import duckdb
import pytest

from notewell import catalog

DATA = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, Decimal):
        return round(float(value), 6)
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(DATA):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return connection


@pytest.mark.parametrize("key", sorted(catalog.ORACLES))
def test_same_rows_as_duckdb(spark, duck, key):
    frame = catalog.QUERIES[key](spark, DATA)
    columns = sorted(frame.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    result = duck.execute(catalog.ORACLES[key])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert ours == theirs


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
