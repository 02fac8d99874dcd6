"""Every registered query against its SQL, run by DuckDB over the same tables."""

from datetime import datetime

import duckdb
import pytest

import __spark_entry__ as registered
from conftest import DATA

SCALES = ["sf0.001", "sf0.01"]
# DuckDB type name -> Spark type name
TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz",
}


@pytest.fixture(scope="module", params=SCALES)
def scale(request):
    db = duckdb.connect()
    for name in registered.TABLES:
        db.execute(f"create view {name} as select * from '{DATA / request.param / name}.parquet'")
    yield request.param, db
    db.close()


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    cells = ([row[i] for i in order] for row in rows)
    return sorted(([_cell(v) for v in row] for row in cells), key=repr)


def _cell(value):
    return value.isoformat() if isinstance(value, datetime) else value


# The optional part has tests of its own.
NAMES = [n for n in registered.queries() if n != "pipeline" and not n.startswith("op")]


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, scale, name):
    sf, db = scale
    df = registered.queries()[name](spark, str(DATA / sf))
    expected = db.sql(registered.oracle_sql()[name])

    assert sorted(df.columns) == sorted(expected.columns)
    types = dict(df.dtypes)
    for column, type_ in zip(expected.columns, expected.types):
        assert types[column] == TYPES[str(type_)], column

    rows = df.collect()
    want = expected.fetchall()
    assert len(rows) == len(want)
    assert canonical(df.columns, rows) == canonical(expected.columns, want)


def test_every_query_has_sql():
    assert set(NAMES) <= registered.oracle_sql().keys()


def test_entry(spark):
    sections = {row.section for row in registered.entry(spark).collect()}
    assert sections == {"summary", "quality", "window", "downstream"}
