"""Every registered query against its SQL counterpart on the smallest sample."""
import os

import duckdb
import pytest

import __spark_entry__ as entry_module

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def engine(sample):
    connection = duckdb.connect()
    for file in os.listdir(sample):
        name, kind = os.path.splitext(file)
        if kind == ".parquet":
            connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sample}/{file}'")
    yield connection
    connection.close()


def ordered(rows):
    return sorted(rows, key=lambda row: [(v is None, str(type(v)), v if v is not None else 0) for v in row])


#: The corpus queries have tests of their own.
RETAIL = sorted({**entry_module.QUERIES, **entry_module.DUPLICATE_KEY_QUERIES})


def test_every_query_has_sql():
    assert set(RETAIL) <= set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", RETAIL)
def test_query(spark, sample, engine, name):
    got = entry_module.queries()[name](spark, sample)
    want = engine.sql(entry_module.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    wanted_types = dict(zip(want.columns, map(str, want.types)))
    assert {c: TYPES[t] for c, t in got.dtypes} == wanted_types
    places = [want.columns.index(c) for c in columns]
    assert ordered(tuple(r[c] for c in columns) for r in got.collect()) == ordered(
        tuple(r[i] for i in places) for r in want.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["category", "category_revenue"]
