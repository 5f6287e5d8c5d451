"""SQLite tables as a Spark data source: ``spark.read.format("sqlite_table").option("path", ..).option("table", ..)``.

Databases are opened read-only, and a table is read by ranges of its row ids, one per partition. The file has to be
where the executors can open it, as SQLite itself reads local files only. Equality filters are pushed into SQLite.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from ..errors import ReplayError

#: Rows that a partition is to have.
PARTITION_ROWS = 100_000


def connect(path: str | Path) -> sqlite3.Connection:
    file = Path(path)
    if not file.is_file():
        raise ReplayError(f"there is no SQLite database at {file}")
    return sqlite3.connect(f"{file.resolve().as_uri()}?mode=ro", uri=True)


def table_names(path: str | Path) -> list[str]:
    with closing(connect(path)) as c:
        return [r[0] for r in c.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]


def require_tables(path: str | Path, *names: str) -> list[str]:
    found = table_names(path)
    if lost := sorted(set(names) - set(found)):
        raise ReplayError(f"{path} has no tables {', '.join(lost)}")
    return found


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _type(declared: str) -> str:
    d = declared.upper()
    if "INT" in d:
        return "bigint"
    if not d or "BLOB" in d:
        return "binary"
    return "double" if any(x in d for x in ("REAL", "FLOA", "DOUB")) else "string"


@dataclass
class RowRange(InputPartition):
    low: int
    high: int


class SqliteTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        with closing(connect(self.options["path"])) as c:
            columns = c.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        return ", ".join(f"`{name}` {_type(kind)}" for _, name, kind, *_ in columns)

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options["path"], self.options["table"], schema, int(self.options.get("partitionrows", PARTITION_ROWS)))


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema, rows: int):
        self.path, self.table, self.columns, self.rows = path, table, schema.names, rows
        self.kinds = [f.dataType.typeName() for f in schema.fields]
        self.where: list[tuple[str, object]] = []

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and isinstance(f.value, str | int):
                self.where.append((f.attribute[0], f.value))
            yield f  # Spark checks them again, as SQLite's comparisons depend on declared types

    def partitions(self) -> list[RowRange]:
        with closing(connect(self.path)) as c:
            low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if low is None:
            return [RowRange(0, 0)]
        return [RowRange(a, min(a + self.rows, high + 1)) for a in range(low, high + 1, self.rows)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        names = ", ".join(map(_quoted, self.columns))
        extra = "".join(f" AND {_quoted(c)} = ?" for c, _ in self.where)
        with closing(connect(self.path)) as c:
            rows = c.execute(f"SELECT {names} FROM {_quoted(self.table)} WHERE rowid >= ? AND rowid < ?{extra}", (partition.low, partition.high, *[v for _, v in self.where]))
            convert = [bytes if k == "binary" else str if k == "string" else float if k == "double" else int for k in self.kinds]
            for row in rows:
                yield tuple(None if v is None else f(v) for f, v in zip(convert, row, strict=True))


def read_table(spark: SparkSession, path: str | Path, table: str, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    require_tables(path, table)
    spark.dataSource.register(SqliteTable)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("sqlite_table").option("path", str(path)).option("table", table).option("partitionRows", partition_rows).load()
