"""The driver contract, and every query against its SQL on the smallest data."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module
from symgrove.catalog.registry import ORACLES, QUERIES

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order)
                   for r in rows), key=repr)


def test_entry_has_rows(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["target_id", "role", "rank", "node_id", "tokens"] and not df.isEmpty()


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.keys() <= entry_module.queries().keys()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = entry_module.queries()[name](spark, str(SF))
    cursor = duck.execute(entry_module.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, df.collect()) == _rows(columns, cursor.fetchall())
