"""What several operators share: words, batches bounded by bytes, held-out rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from fluxframe.session import settle

#: Lower-casing of A-Z only, over UTF-8 bytes.
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[bytes]:
    """Words of ``[^\\x20\\x09-\\x0D]+`` as UTF-8; bytes.split() cuts at just those six characters."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slice batches so that ``column`` holds about ``limit`` bytes in each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        total = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            floor = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, floor + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def crc_of_id(column: str) -> Column:
    """crc32 of the id written as text; NULL for NULL."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def held_out(column: str) -> Column:
    """True for the third of rows that no model learns from; a row without an id is never learned from either."""
    return F.coalesce(crc_of_id(column) % 3 == 1, F.lit(True))


def bounded_sample(rows: DataFrame, group: str, key: str, most: int) -> DataFrame:
    """At most ``most`` rows of each group: those whose keys have the smallest hashes.

    Groups are counted first, combined in the map tasks, and all but about twice
    the wanted rows are left out by their hash before anything is ranked, so a
    group that holds most of the table is no burden for the task that ranks it.
    """
    # written: a table of one row per group, whose known size lets Spark send it to the rows
    sizes = settle(rows.groupBy(group).agg(F.count(F.lit(1)).alias("__n")))
    top = 1 << 40
    near = (rows.withColumn("__h", F.pmod(F.xxhash64(key), F.lit(top))).join(sizes, group)
            .where(F.col("__h") < F.lit(2.0 * most * top) / F.col("__n")))
    order = Window.partitionBy(group).orderBy("__h", key)
    return (near.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= most)
            .drop("__h", "__n", "__rank"))


def documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns operators read, under fixed names; whatever else is there is left behind.

    Texts are taken whole, whatever their length.
    """
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def with_row(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` and ``row``, a struct of all columns, whatever their names."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def tasks(df: DataFrame) -> int:
    """As many partitions as the session shuffles into; asked for by number, they are not merged for being small."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each value of ``key``, which follow each other, as one table; single rows are left out."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.column(key)
        if held and held[-1].column(key)[-1] != own[0]:
            if sum(b.num_rows for b in held) > 1:
                yield pa.Table.from_batches(held)
            held = []
        changes = (np.flatnonzero(pc.not_equal(own[1:], own[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist()
        for start, stop in zip([0, *changes], [*changes, batch.num_rows], strict=True):
            if start:
                if held[-1].num_rows > 1 or len(held) > 1:
                    yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
    if sum(b.num_rows for b in held) > 1:
        yield pa.Table.from_batches(held)
