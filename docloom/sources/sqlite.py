"""SQLite tables as a data source: read by ranges of row ids with pushed filters, written by way of one file a task.

    spark.dataSource.register(Sqlite)
    spark.read.format("sqlite").option("path", path).option("table", "teams").load()

The file must be in a folder that the driver and all executors see, and spark.sql.python.filterPushdown.enabled must be true,
as filters go to SQLite. Values are read as their column's declared type says; what can't be is null.
"""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

#: Rows of a batch, and ranges that a table is read in unless the option partitions says otherwise.
ROWS, RANGES = 10_000, 8
_KINDS = {T.LongType(): "INTEGER", T.DoubleType(): "REAL", T.BinaryType(): "BLOB", T.StringType(): "TEXT"}
_COMPARED = {D.EqualTo: "=", D.EqualNullSafe: "IS", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}


def _local(path: str) -> str:
    parsed = urlparse(path)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"SQLite needs a file system, not {path}")
    return parsed.path


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(_local(path))}?mode=ro", uri=True)


def _name(s: str) -> str:
    return '"' + s.replace('"', '""') + '"'


def _kind(declared: str) -> T.DataType:
    """By the rules of column affinity."""
    d = declared.upper()
    if "INT" in d:
        return T.LongType()
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return T.StringType()
    if "BLOB" in d:
        return T.BinaryType()
    return T.DoubleType() if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")) else T.StringType()


def _value(field: T.StructField) -> str:
    c = _name(field.name)
    if field.dataType == T.StringType():
        return f"CAST({c} AS TEXT)"
    if field.dataType == T.BinaryType():
        return f"CAST({c} AS BLOB)"
    return f"CASE WHEN typeof({c}) IN ('integer', 'real') THEN CAST({c} AS {_KINDS[field.dataType]}) END"


@dataclass
class Range(D.InputPartition):
    first: int | None
    last: int | None


class Reader(D.DataSourceReader):
    def __init__(self, path: str, table: str, schema: T.StructType, ranges: int):
        self.path, self.table, self.schema, self.ranges = path, table, schema, ranges
        self.where: list[str] = []
        self.given: list = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        by = {f.name: f for f in self.schema.fields}
        for f in filters:
            field = by.get(f.attribute[0]) if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            known = field is not None and (getattr(f, "value", None) is None or isinstance(f.value, (int, float, str, tuple)) and not isinstance(f.value, bool))
            if known and type(f) in _COMPARED:
                self.where.append(f"{_value(field)} {_COMPARED[type(f)]} ?")
                self.given.append(f.value)
            elif known and isinstance(f, D.In):
                self.where.append(f"{_value(field)} IN ({', '.join('?' * len(f.value))})")
                self.given += f.value
            elif known and isinstance(f, (D.IsNull, D.IsNotNull)):
                self.where.append(f"{_value(field)} IS {'NOT ' * isinstance(f, D.IsNotNull)}NULL")
            else:
                yield f

    def partitions(self) -> list[Range]:
        with _open(self.path) as con:
            try:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.table)}").fetchone()
            except sqlite3.OperationalError:  # a table without row ids
                return [Range(None, None)]
        if low is None:
            return [Range(0, -1)]
        step = max(1, -(-(high - low + 1) // self.ranges))
        return [Range(a, min(high, a + step - 1)) for a in range(low, high + 1, step)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        where, given = list(self.where), list(self.given)
        if partition.first is not None:
            where, given = ["rowid BETWEEN ? AND ?", *where], [partition.first, partition.last, *given]
        query = f"SELECT {', '.join(map(_value, self.schema.fields))} FROM {_name(self.table)}" + (f" WHERE {' AND '.join(where)}" if where else "")
        kinds = {T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.BinaryType(): pa.binary(), T.StringType(): pa.string()}
        with _open(self.path) as con:
            rows = con.execute(query, given)
            while some := rows.fetchmany(ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType]) for c, f in zip(zip(*some), self.schema.fields)], [f.name for f in self.schema.fields])


@dataclass
class Part(D.WriterCommitMessage):
    path: str | None


class Writer(D.DataSourceWriter):
    """Tasks write files of their own; on commit they are copied into the table in one transaction, file after file."""

    def __init__(self, path: str, table: str, schema: T.StructType, overwrite: bool):
        self.path, self.table, self.overwrite = _local(path), table, overwrite
        self.columns = ", ".join(f"{_name(f.name)} {_KINDS.get(f.dataType, 'REAL' if isinstance(f.dataType, (T.FloatType, T.DecimalType)) else 'INTEGER' if isinstance(f.dataType, (T.IntegralType, T.BooleanType)) else 'TEXT')}" for f in schema.fields)
        self.width = len(schema.fields)

    def write(self, iterator) -> Part:
        part = f"{self.path}.part-{uuid.uuid4().hex}"
        with sqlite3.connect(part) as con:
            con.execute(f"CREATE TABLE t ({self.columns})")
            con.executemany(f"INSERT INTO t VALUES ({', '.join('?' * self.width)})", (tuple(r) for r in iterator))
        con.close()
        return Part(part)

    def commit(self, messages: list) -> None:
        con = sqlite3.connect(self.path)
        try:
            for k, m in enumerate(messages):
                con.execute("ATTACH ? AS part", (m.path,))
                with con:
                    if k == 0 and self.overwrite:
                        con.execute(f"DROP TABLE IF EXISTS {self._target()}")
                    con.execute(f"CREATE TABLE IF NOT EXISTS {self._target()} ({self.columns})")
                    con.execute(f"INSERT INTO {self._target()} SELECT * FROM part.t")
                con.execute("DETACH part")
            if self.overwrite and messages:
                with con:
                    con.execute("BEGIN")
                    con.execute(f"DROP TABLE IF EXISTS {_name(self.table)}")
                    con.execute(f"ALTER TABLE {self._target()} RENAME TO {_name(self.table)}")
        finally:
            con.close()
        self.abort(messages)

    def _target(self) -> str:
        return _name(f"{self.table}_new") if self.overwrite else _name(self.table)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and m.path and os.path.exists(m.path):
                os.remove(m.path)


class Sqlite(D.DataSource):
    """Options: path, table, and partitions for reading."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        with _open(self.options["path"]) as con:
            columns = con.execute(f"PRAGMA table_info({_name(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']} in {self.options['path']}")
        return T.StructType([T.StructField(c[1], _kind(c[2] or "")) for c in columns])

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options["path"], self.options["table"], schema, int(self.options.get("partitions", RANGES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], self.options["table"], schema, overwrite)


def read(spark: SparkSession, path: str, table: str, partitions: int = RANGES) -> DataFrame:
    """A table of the file; the session's pushing of filters to Python sources is turned on, as this one takes them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(Sqlite)
    return spark.read.format("sqlite").option("path", path).option("table", table).option("partitions", partitions).load()


def write(df: DataFrame, path: str, table: str, mode: str = "overwrite") -> None:
    """Writes df as a table of the file; overwrite replaces the table once all rows are there, append adds to it."""
    df.sparkSession.dataSource.register(Sqlite)
    df.write.format("sqlite").mode(mode).option("path", path).option("table", table).save()
