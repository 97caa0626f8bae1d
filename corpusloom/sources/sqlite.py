"""SQLite tables as a Spark source: spark.read.format("sqlite").option("path", ...).option("table", ...).load().

The schema comes from the table, only the columns of `columns` (all by default) are read, and the rows are parted by rowid ranges, each
read by a task of its own. The file must lie where every executor can open it."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def kind_of(declared: str):
    """Spark's type of a declared one, by SQLite's affinities."""
    name = declared.upper()
    if "INT" in name:
        return LongType()
    if any(x in name for x in ("CHAR", "CLOB", "TEXT")):
        return StringType()
    if any(x in name for x in ("REAL", "FLOA", "DOUB")):
        return DoubleType()
    return BinaryType() if not name or "BLOB" in name else DoubleType()


class Rows(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.table, self.parts, self.schema = options["path"], options["table"], int(options.get("numPartitions", "8")), schema

    def partitions(self) -> list[Rows]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            first, last = con.execute(f"select min(rowid), max(rowid) from {quoted(self.table)}").fetchone()
        if first is None:
            return [Rows(0, -1)]
        step = -(-(last - first + 1) // self.parts)
        return [Rows(k, min(k + step - 1, last)) for k in range(first, last + 1, step)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        names = ", ".join(quoted(f.name) for f in self.schema.fields)
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            yield from con.execute(f"select {names} from {quoted(self.table)} where rowid between ? and ?", (partition.first, partition.last))


class SQLite(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as con:
            found = con.execute(f"pragma table_info({quoted(self.options['table'])})").fetchall()
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        known = {name: StructField(name, kind_of(kind)) for _, name, kind, *_ in found}
        return StructType([known[c] for c in (wanted or known)])

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options, schema)


def read_sqlite(spark: SparkSession, path: str, table: str, columns: list[str] | None = None) -> DataFrame:
    """The named columns of a table, in the order given; without names all."""
    spark.dataSource.register(SQLite)
    return spark.read.format("sqlite").option("path", path).option("table", table).option("columns", ",".join(columns or [])).load()
