"""Physical layout: id rebuild, clustering, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from fluxframe.operators.numbering import number_rows
from fluxframe.operators.ordering import dense_order, row_hash


def rebuild_ids(table: DataFrame, key: str = "coord_id", time: str = "timestamp", row_id: str = "id") -> DataFrame:
    """Ids 1..n in (location, time, old id) order; a table without ids gets them as its first column.

    Without old ids a hash of the row settles ties.
    """
    had_ids = row_id in table.columns
    order = [c for c in (key, time) if c in table.columns]
    if had_ids:
        # the order alone is sorted and numbered; the rows are joined with the numbers
        fresh = number_rows(table, [*order, row_id], "__new_id", start=1)
    else:
        fresh = dense_order(table, [*order, row_hash(table)], "__new_id", start=1)
    columns = table.columns if had_ids else [row_id, *table.columns]
    return fresh.withColumn(row_id, F.col("__new_id")).select(*columns)


def clustered(table: DataFrame, columns: Sequence[str] = ("coord_id", "timestamp", "id"),
              partitions: int | None = None) -> DataFrame:
    """Range-cluster by all the columns: a lookup by key and time then skips
    most row groups, and no key, however large, fills one file alone."""
    args = ([partitions] if partitions else []) + list(columns)
    return table.repartitionByRange(*args).sortWithinPartitions(*columns)


def save_clustered(table: DataFrame, name: str, columns: Sequence[str], analyse: bool = True) -> None:
    """Write as a table with the layout and gather column statistics."""
    clustered(table, columns).write.mode("overwrite").format("parquet").saveAsTable(name)
    if analyse:
        listed = ", ".join(f"`{c}`" for c in columns)
        table.sparkSession.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR COLUMNS {listed}")


def row_estimate(table: DataFrame, row_id: str = "id") -> DataFrame:
    """Row count and highest id of any table; ``footers.footer_estimate`` answers for stored ones without reading."""
    return table.agg(F.count("*").alias("row_count"), F.max(row_id).alias("max_id"))
