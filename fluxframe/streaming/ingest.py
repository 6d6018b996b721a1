"""Files that keep arriving: append facts, upsert images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from fluxframe import schema
from fluxframe.plans.image_store import create_store, store_images


def append_facts(spark: SparkSession, incoming: str, table: str, progress: str,
                 predictors=None) -> StreamingQuery:
    """Append every new file of facts once; ``progress`` remembers which were seen.

    The file sink commits each batch exactly once, also after a restart.
    """
    layout = schema.grid_facts(predictors) if predictors else schema.grid_facts()
    stream = schema.nan_to_null(spark.readStream.schema(layout).parquet(incoming))
    return (stream.writeStream.format("parquet").option("path", table)
            .option("checkpointLocation", progress).trigger(availableNow=True).start())


def upsert_images(spark: SparkSession, incoming: str, store: str, progress: str,
                  overwrite: bool) -> StreamingQuery:
    """Insert every new file of images. Repeating a batch changes nothing."""
    create_store(spark, store)

    def write(batch: DataFrame, _: int) -> None:
        store_images(spark, store, batch, overwrite)

    stream = spark.readStream.schema(schema.grid_images()).parquet(incoming)
    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", progress)
            .trigger(availableNow=True).start())
