"""Every query with SQL agrees with DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from strataloom import catalog


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def _value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool | str):
        return v
    return round(float(v), 6) if hasattr(v, "__float__") else str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name in catalog.oracle_sql():
        want = duck.execute(catalog.oracle_sql()[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert _rows(df.columns, rows) == _rows(columns, want.fetchall())
    else:
        assert rows


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
