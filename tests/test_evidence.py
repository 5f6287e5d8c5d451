"""The queries over stored files, beyond their rows: what goes through the driver."""

import duckdb
import pytest

from orrery.plans import evidence, evidence_sql


@pytest.fixture
def closed(monkeypatch):
    """Rows of tables mustn't be fetched one by one."""

    def refuse(*_):
        raise AssertionError("rows go through the driver")

    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.toLocalIterator", refuse)


@pytest.mark.parametrize("name", ["json_lines", "file_hashes", "selection_rows", "exported_projection"])
def test_files_are_written_by_tasks(spark, sf, closed, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.sql(evidence_sql.SQL[name])
    got = sorted(map(tuple, evidence.QUERIES[name](spark, sf).select(*want.columns).collect()), key=str)
    assert len(got) and [tuple(pytest.approx(v, abs=2e-6) if isinstance(v, float) else v for v in r) for r in sorted(want.fetchall(), key=str)] == got
