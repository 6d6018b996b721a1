"""SQLite tables as a partitioned source.

Each task opens the file read-only and reads one range of row ids, so a large
table is scanned in parallel and nothing passes through the driver.
"""

from __future__ import annotations

import sqlite3

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS_PER_BATCH = 10_000
SPARK_TYPES = {"INTEGER": T.LongType(), "REAL": T.DoubleType(), "BLOB": T.BinaryType()}


def _open(path: str) -> sqlite3.Connection:
    connection = sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)
    connection.execute("PRAGMA query_only = ON")
    return connection


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class IdRange(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteSource(DataSource):
    """Options: path, table, rowsPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> T.StructType:
        with _open(self.options["path"]) as connection:
            found = connection.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not found:
            raise ValueError(f"no table {self.options['table']} in {self.options['path']}")
        return T.StructType([T.StructField(c[1], SPARK_TYPES.get(c[2].upper(), T.StringType()))
                             for c in found])

    def reader(self, schema: T.StructType) -> "SqliteReader":
        return SqliteReader(self.options, schema)


class SqliteReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.table = options["path"], options["table"]
        self.step = int(options.get("rowsPerPartition", 1_000_000))
        self.schema = schema

    def partitions(self):
        with _open(self.path) as connection:
            low, high = connection.execute(
                f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if low is None:
            return [IdRange(0, 0)]
        return [IdRange(a, min(a + self.step, high + 1)) for a in range(low, high + 1, self.step)]

    def read(self, partition):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(self.schema)
        columns = ", ".join(_quoted(n) for n in self.schema.fieldNames())
        connection = _open(self.path)
        try:
            cursor = connection.execute(
                f"SELECT {columns} FROM {_quoted(self.table)} WHERE rowid >= ? AND rowid < ?",
                (partition.low, partition.high))
            while rows := cursor.fetchmany(ROWS_PER_BATCH):
                arrays = [pa.array(v, type=f.type) for v, f in zip(zip(*rows), arrow)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        finally:
            connection.close()


def read_sqlite(spark: SparkSession, path: str, table: str, rows_per_partition: int = 1_000_000) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return (spark.read.format("sqlite_table").option("path", path).option("table", table)
            .option("rowsPerPartition", str(rows_per_partition)).load())


def table_names(path: str) -> list[str]:
    with _open(path) as connection:
        return [r[0] for r in connection.execute(
            "SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]


def require_tables(path: str, needed=("ec_data", "coord_data"), optional=("modis_data",)) -> dict[str, bool]:
    """Raise when a needed table is absent; tell which optional ones exist."""
    found = set(table_names(path))
    absent = [t for t in needed if t not in found]
    if absent:
        raise ValueError(f"missing tables: {', '.join(absent)}")
    return {t: t in found for t in optional}


def decode_floats(blob: Column) -> Column:
    """Little-endian float32 bytes -> array<float>, a batch at a time."""
    @F.pandas_udf("array<float>")
    def decode(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4"))

    return decode(blob)
