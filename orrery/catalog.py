"""The engine's registered queries, and DuckDB SQL for the same rows; WHOLE has no SQL."""

from __future__ import annotations

from .plans import evidence, evidence_sql, oracle, queries

QUERIES = queries.QUERIES | evidence.QUERIES
WHOLE = queries.WHOLE
SQL = oracle.SQL | evidence_sql.SQL

__all__ = ["QUERIES", "SQL", "WHOLE"]
