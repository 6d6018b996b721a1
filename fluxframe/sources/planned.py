"""Reading files whose partitions depend on their shapes, with no file opened by the driver."""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource
from pyspark.sql.pandas.types import to_arrow_schema


def read_planned(spark: SparkSession, paths: Sequence[str], source: type[DataSource], options: dict[str, str],
                 schema: T.StructType | str | None = None) -> DataFrame:
    """The rows of ``paths`` as ``source`` reads them, one path at a time.

    A first pass opens the files, dealt over the tasks, and yields the pieces
    each is cut into; these are dealt over the tasks again and read. Only paths
    pass through the driver, so they alone are bounded by its memory. Without
    ``schema`` a task takes it from the first file. Without paths there are no
    rows, and a schema is needed. Pieces are a function of the file, so a task
    that runs again reads the same.
    """
    if not paths and schema is None:
        raise ValueError("no files and no schema")
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if schema is None:
        schema = _described(spark, paths[0], source, options)
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)

    def opened(path: str):
        return source({**options, "path": path}).reader(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                parts = [pickle.dumps(part) for part in opened(path).partitions()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(parts), pa.string()), pa.array(range(len(parts)), pa.int64()),
                     pa.array(parts, pa.binary())], ["path", "at", "part"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = to_arrow_schema(schema)
        for batch in batches:
            for path, part in zip(*(batch.column(c).to_pylist() for c in ("path", "part")), strict=True):
                for found in opened(path).read(pickle.loads(part)):
                    if not isinstance(found, pa.RecordBatch):
                        found = pa.RecordBatch.from_pylist([dict(zip(layout.names, found, strict=True))], layout)
                    yield found

    files = spark.createDataFrame([(p,) for p in paths], "path string")
    pieces = files.repartition(max(1, min(len(paths), slots)), "path").mapInArrow(cut, "path string, at long, part binary")
    # asked for by number: the rows are small, but what they stand for is not, so they must not be merged
    return pieces.repartition(max(len(paths), slots), F.xxhash64("path", "at")).mapInArrow(read, schema)


def _described(spark: SparkSession, path: str, source: type[DataSource], options: dict[str, str]) -> T.StructType:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in batch.column("path").to_pylist():
                found = source({**options, "path": first}).schema()
                yield pa.RecordBatch.from_arrays([pa.array([found if isinstance(found, str) else found.json()])], ["schema"])

    described = spark.createDataFrame([(path,)], "path string").coalesce(1).mapInArrow(run, "schema string").first()[0]
    return T.StructType.fromJson(json.loads(described)) if described.startswith("{") else T.StructType.fromDDL(described)
