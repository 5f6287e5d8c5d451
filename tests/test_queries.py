"""Every registered query against its SQL in DuckDB, as the driver compares them."""

import glob
import os

import duckdb
import pytest

from orrery import catalog


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def key(row):
    return tuple((v is None, str(v) if not isinstance(v, int | float) else v or 0) for v in row)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf)
    want = duck.sql(catalog.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key)
    b = sorted(want.project(", ".join(f'"{c}"' for c in columns)).fetchall(), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for c, v, w in zip(columns, x, y, strict=True):
            assert v == w or isinstance(v, float) and w is not None and abs(v - float(w)) <= 2e-6 * max(1, abs(v)), (c, x, y)


def test_queries_without_sql_are_known():
    assert set(catalog.QUERIES) - set(catalog.SQL) == {"pair_benchmark"}
    assert set(catalog.SQL) <= set(catalog.QUERIES)
