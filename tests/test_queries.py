"""Every query with SQL against DuckDB on the same tables."""

import glob
import math
import os

import duckdb
import pytest

from pagegrain.plans import registry


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    cursor = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    expected = sorted(([norm(r[columns.index(c)]) for c in order] for r in cursor.fetchall()), key=str)
    assert sorted(([norm(r[c]) for c in order] for r in df.collect()), key=str) == expected


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs_without_sql(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0
