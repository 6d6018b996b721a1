"""Fact and dimension tables cut into the same buckets by location, each bucket sorted.

Tables saved here with one number of buckets can be joined by location, and
windows over a location computed, without any exchange: rows of a location are
in one bucket, whichever table they come from.

The layout is kept beside the data, so that any later session can open the
table again without a metastore.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from fluxframe.operators.ordering import find_hot, keyed_join
from fluxframe.session import hot_key_rows

LAYOUT = "_layout"
KEY = "coord_id"
ORDER = ("coord_id", "timestamp", "id")


def _name(path: str) -> str:
    return "located_" + hashlib.md5(path.rstrip("/").encode()).hexdigest()


def save_colocated(table: DataFrame, path: str, buckets: int, key: str = KEY, order: Sequence[str] = ORDER) -> DataFrame:
    """Write ``table`` to ``path``, bucketed by ``key`` and sorted by those of ``order`` it has; returns it opened.

    A bucket is written by one task and is one file, but for keys with more rows
    than a task should hold: their rows are dealt to several tasks by hash, and
    each writes a sorted file of its own.
    """
    spark = table.sparkSession
    order = [c for c in order if c in table.columns] or [key]
    hot = find_hot(table, [key])
    dealt = table.withColumn("__part", F.lit(0))
    if hot.table is not None:
        parts = F.lit(max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        marked = keyed_join(dealt, hot.table.withColumn("__hot", F.lit(True)), [key], "left")
        dealt = marked.withColumn("__part", F.when(F.col("__hot"), F.pmod(F.xxhash64(*order), parts)).otherwise(0).cast("int")).drop("__hot")
    name = _name(path)
    spark.sql(f"drop table if exists {name}")
    (dealt.repartition(buckets, key, "__part").drop("__part") if hot.table is not None else table.repartition(buckets, key)) \
        .write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, key).sortBy(*order).saveAsTable(name)
    layout = {"columns": [[f.name, f.dataType.simpleString()] for f in table.schema.fields], "key": key,
              "order": order, "buckets": buckets}
    spark.createDataFrame([(json.dumps(layout),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{LAYOUT}")
    return open_colocated(spark, path)


def open_colocated(spark: SparkSession, path: str) -> DataFrame:
    """A table saved by ``save_colocated``, in this or another session, with its buckets known to the optimiser."""
    name = _name(path)
    layout = json.loads(spark.read.text(f"{path}/{LAYOUT}").first()[0])
    columns = ", ".join(f"`{n}` {kind}" for n, kind in layout["columns"])
    order = ", ".join(f"`{c}`" for c in layout["order"])
    spark.sql(f"""create table if not exists {name} ({columns}) using parquet
        clustered by (`{layout["key"]}`) sorted by ({order}) into {layout["buckets"]} buckets location '{path}'""")
    return spark.table(name)


def colocate(facts: DataFrame, dim: DataFrame, folder: str, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Save facts and their dimension below ``folder`` in the same buckets; returns both opened.

    The default number of buckets lets one hold as many rows as a task should.
    """
    if buckets is None:
        buckets = max(1, -(-facts.count() // hot_key_rows(facts.sparkSession)))
    return (save_colocated(facts, f"{folder}/ec_data", buckets), save_colocated(dim, f"{folder}/coord_data", buckets))
