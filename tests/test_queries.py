"""Every registered query against its SQL counterpart in DuckDB, at the smallest scale."""

from __future__ import annotations

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


def _plain(value):
    return 0.0 if value == 0 and isinstance(value, float) else value


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and sum(r["n_rows"] for r in rows if r["rule"] == "none") > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", list(__spark_entry__.queries()))
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    rows = sorted((tuple(_plain(row[c]) for c in columns) for row in df.collect()), key=repr)
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cursor = duck.execute(sql)
    types = {item[0]: str(item[1]) for item in cursor.description}
    assert sorted(types) == columns
    assert {c: TYPES[kind] for c, kind in df.dtypes} == types
    places = [list(types).index(c) for c in columns]
    assert rows == sorted((tuple(_plain(row[i]) for i in places) for row in cursor.fetchall()), key=repr)
