"""Every query with SQL against DuckDB on the smallest tables, and the rest for rows."""

import math
from pathlib import Path

import duckdb
import pytest

from seqloom.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return float(v) if hasattr(v, "as_tuple") else v + 0.0 if isinstance(v, float) else v


def _rows(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(_plain(r[i]) for i in at) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    found, want = QUERIES[name](spark, SF), duck.sql(SQL[name])
    assert sorted(found.columns) == sorted(want.columns)
    assert _rows(found.columns, found.collect()) == _rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
