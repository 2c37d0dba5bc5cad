"""Reading catalogs from SQLite files: a Python data source, a partition for each range of row ids."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..durable import ship
from ..schema import FUNCTIONS, SIDE_TABLES
from .catalogs import Catalog


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteSource(DataSource):
    """Options: path, table, partitions (8). The schema names the columns to read; values must have its types."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_catalog"

    def schema(self) -> T.StructType:
        kinds = {"INTEGER": T.LongType(), "INT": T.LongType(), "REAL": T.DoubleType(), "BLOB": T.BinaryType()}
        with _connect(self.options["path"]) as c:
            return T.StructType([T.StructField(r[1], kinds.get(r[2].split("(")[0].upper(), T.StringType())) for r in c.execute(f'PRAGMA table_info("{self.options["table"]}")')])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options, schema)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.table, self.count, self.fields = options["path"], options["table"], int(options.get("partitions", 8)), schema.fields

    def partitions(self) -> list[InputPartition]:
        with _connect(self.path) as c:
            low, high = c.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [_Range(0, 0)]
        step = max(1, -(-(high + 1 - low) // self.count))
        return [_Range(k, min(k + step, high + 1)) for k in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        allowed = [{T.LongType: int, T.DoubleType: (int, float), T.BinaryType: (bytes, str)}.get(type(f.dataType), str) for f in self.fields]
        convert = [{T.DoubleType: float, T.BinaryType: lambda v: v.encode() if isinstance(v, str) else v}.get(type(f.dataType)) for f in self.fields]
        columns = ", ".join(f'"{f.name}"' for f in self.fields)
        with _connect(self.path) as c:
            for row in c.execute(f'SELECT {columns} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', (partition.low, partition.high)):
                for value, kind, f in zip(row, allowed, self.fields):
                    if value is not None and not isinstance(value, kind):
                        raise ValueError(f"{self.table}.{f.name} holds {value!r}, which is not {f.dataType.simpleString()}")
                yield tuple(v if v is None or to is None else to(v) for v, to in zip(row, convert))


def read_sqlite(spark: SparkSession, path: str, partitions: int = 8) -> Catalog:
    """The catalog in a SQLite file that every executor can open; tables that are absent are empty."""
    ship(spark)
    spark.dataSource.register(SqliteSource)
    with _connect(path) as c:
        there = {r[0] for r in c.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
        columns = {t: {r[1] for r in c.execute(f'PRAGMA table_info("{t}")')} for t in there}

    def load(table: str, schema: T.StructType):
        schema = T.StructType([f for f in schema if f.name in columns[table]])
        return spark.read.format("sqlite_catalog").schema(schema).options(path=path, table=table, partitions=partitions).load()

    sides = {t: load(t, T._parse_datatype_string(s)) for t, s in SIDE_TABLES.items() if t in there}
    return Catalog(load("functions", FUNCTIONS), sides)
