"""Numbered CSV files with commit and abort.

Tasks write below a hidden folder of the run, each attempt to files of its own.
Only when all tasks are done do the files of the attempts that counted take
their names; where anything fails before that, the folder goes and whatever was
there stays. So a task that fails, or runs twice, leaves nothing behind.
"""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

RANK = "__rank"


def _place(path: str):
    """File system and path of a plain path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: rank and where it was written; and rows."""

    files: list[tuple[int, str]]
    rows: int


class RankWriter(DataSourceArrowWriter):
    def __init__(self, path: str, count: int):
        self.path, self.count, self.run = path.rstrip("/"), count, uuid.uuid4().hex

    @property
    def pending(self) -> str:
        return f"{self.path}/.pending-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, _ = _place(self.path)
        _, folder = _place(self.pending)
        files.create_dir(folder, recursive=True)
        attempt, done, rows = uuid.uuid4().hex, [], 0
        rank, sink, out = None, None, None

        def close():
            if sink is not None:
                sink.close()

        for batch in iterator:
            ranks = batch.column(RANK).to_pylist()
            body = batch.drop_columns([RANK])
            start = 0
            while start < len(ranks):
                stop = next((k for k in range(start + 1, len(ranks)) if ranks[k] != ranks[start]), len(ranks))
                if ranks[start] != rank:
                    close()
                    rank = ranks[start]
                    place = f"{folder}/{attempt}-{rank}.csv"
                    sink = io.TextIOWrapper(files.open_output_stream(place), "utf-8", newline="")
                    out = csv.writer(sink, lineterminator="\n")
                    out.writerow(body.schema.names)
                    done.append((rank, place))
                out.writerows(zip(*(c.to_pylist() for c in body.slice(start, stop - start).columns), strict=True))
                rows += stop - start
                start = stop
        close()
        return Written(done, rows)

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = _place(self.path)
        made = {rank: place for m in messages if m for rank, place in m.files}
        for rank in range(self.count):
            target = f"{folder}/rank_{rank:05d}.csv"
            if rank in made:
                files.move(made[rank], target)
            else:  # fewer rows than files
                files.open_output_stream(target).close()
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        files, folder = _place(self.pending)
        if files.get_file_info(folder).type != fs.FileType.NotFound:
            files.delete_dir(folder)


class RankFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rank_files"

    def writer(self, schema, overwrite: bool) -> RankWriter:
        return RankWriter(self.options["path"], int(self.options["count"]))


def write_rank_files(df: DataFrame, path: str, count: int, order: str = "__sample_order") -> None:
    """``rank_00000.csv`` and on: ``count`` files, each a contiguous stretch of ``order`` (0, 1, ...).

    Rows are dealt by position, so every file is one task's; files already there
    are replaced when all are written. ``path`` must be one that all executors
    share, as a plain path or a URI.
    """
    spark = df.sparkSession
    base, extra = divmod(df.count(), count)
    bulky = extra * (base + 1)
    place = F.col(order)
    rank = F.when(place < bulky, F.floor(place / (base + 1))).otherwise(
        extra + F.floor((place - bulky) / max(base, 1))).cast("int")
    spark.dataSource.register(RankFiles)
    shown = [F.col(f"`{f.name}`").cast("string").alias(f.name) for f in df.schema.fields]
    (df.withColumn(RANK, rank).repartition(count, RANK).sortWithinPartitions(RANK, order).select(*shown, RANK)
     .write.format("rank_files").mode("append").option("path", path).option("count", str(count)).save())
