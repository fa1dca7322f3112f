"""Every registered query against its SQL on the smallest driver tables."""

import datetime
import math

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry

TABLES = "events documents benchmark conversations".split()


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def table(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(normal(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    result = db.execute(sql)
    assert got == table([d[0] for d in result.description], result.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["type", "id", "title", "description", "project", "score"]
