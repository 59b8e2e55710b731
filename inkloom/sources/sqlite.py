"""SQLite databases as a data source: read-only, partitioned by row number."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Declared types of columns and what they are read as (fixed values).
TYPES = {"INTEGER": "long", "REAL": "double", "TEXT": "string", "BLOB": "binary"}


def connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table = options["path"], options["table"]
        self.size = int(options.get("rowsPerPartition", 100_000))

    def partitions(self) -> list[Rows]:
        with connect(self.path) as db:
            first, last = db.execute(f"select min(rowid), max(rowid) from {quoted(self.table)}").fetchone()
        if first is None:
            return []
        return [Rows(at, min(at + self.size - 1, last)) for at in range(first, last + 1, self.size)]

    def read(self, partition: Rows | None) -> Iterator[tuple]:
        if partition is None:  # an empty table
            return
        db = connect(self.path)
        try:
            yield from db.execute(f"select * from {quoted(self.table)} where rowid between ? and ?", (partition.first, partition.last))
        finally:
            db.close()


class SqliteSource(DataSource):
    """``spark.read.format("sqlite").option("path", ...).option("table", ...)``; the file must be reachable by the executors."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with connect(self.options["path"]) as db:
            columns = db.execute(f"pragma table_info({quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']}")
        return ", ".join(f"`{c[1]}` {TYPES.get(c[2].upper(), 'string')}" for c in columns)

    def reader(self, schema) -> DataSourceReader:
        return Reader(dict(self.options))


def read(spark: SparkSession, path: str, table: str, rows: int = 100_000) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("path", path).option("table", table).option("rowsPerPartition", rows).load()
