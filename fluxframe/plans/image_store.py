"""The image table on disk, partitioned by date."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from fluxframe import schema
from fluxframe.operators.dims import newest_per_key, upsert
from fluxframe.session import counted, settle

KEYS = ("coord_id", "modis_date")


def existing_images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.grid_images()).parquet(path)


def create_store(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], schema.grid_images()).write.mode("ignore").partitionBy("modis_date").parquet(path)


def by_date(images: DataFrame, files_per_date: int) -> DataFrame:
    """Bring the images of a date together in at most ``files_per_date`` tasks."""
    return images.repartition("modis_date", F.pmod(F.xxhash64("coord_id"), F.lit(files_per_date)))


def store_images(spark: SparkSession, path: str, incoming: DataFrame, overwrite: bool,
                 files_per_date: int = 8) -> dict[str, int]:
    """Insert images, ignoring or replacing known (coord_id, modis_date).

    Returns how many cells came with a location (``matched``) and how many
    images were written, both counted while the rows pass.

    Only the dates that come in are read. Ignoring appends what is new, at most
    ``files_per_date`` files for each date; replacing rewrites those dates alone,
    and in one commit. One writer at a time: two that run together may both
    append an image that neither has seen.
    """
    came, wrote = Observation(), Observation()
    incoming = incoming.observe(came, F.count(F.lit(1)).alias("matched"))
    unique = newest_per_key(incoming, KEYS, ["data"], last=overwrite).select("coord_id", "modis_date", "data")
    unique = settle(unique.observe(wrote, F.count(F.lit(1)).alias("written")))
    # as many values as there are days, never as there are rows
    days = [r[0] for r in unique.select("modis_date").distinct().collect()]
    known = existing_images(spark, path).where(F.col("modis_date").isin(*days))
    if overwrite:
        merged = settle(upsert(known, unique, KEYS, overwrite=True))
        (by_date(merged, files_per_date).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("modis_date").parquet(path))
    else:
        wrote = Observation()
        fresh = unique.join(known.select(*KEYS), list(KEYS), "left_anti").observe(wrote, F.count(F.lit(1)).alias("written"))
        by_date(fresh, files_per_date).write.mode("append").partitionBy("modis_date").parquet(path)
    return {"matched": counted(came, "matched"), "written": counted(wrote, "written")}


def file_layouts(spark: SparkSession, path: str) -> DataFrame:
    """modis_date, and ``layout``, the columns and types of a file, for every different layout of a date.

    The footers are read by the tasks, one for each file; no column is read.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)
             .load(path).select("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            found = []
            for uri in batch.column("path").to_pylist():
                system, place = fs.FileSystem.from_uri(uri)
                with system.open_input_file(place) as file:
                    own = pq.read_schema(file)
                found.append(", ".join(sorted(f"{f.name} {_kind(f.type)}" for f in own)))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.string())], ["path", "layout"])

    date = F.regexp_extract("path", r"/modis_date=(\d+)/", 1).cast("int").alias("modis_date")
    return (files.repartition("path").mapInArrow(run, "path string, layout string").select(date, "layout")
            .where(F.col("modis_date").isNotNull()).distinct())


def _kind(kind: pa.DataType) -> str:
    return f"array<{kind.value_type}>" if pa.types.is_list(kind) else str(kind)


def _filled(field: T.StructField, names: list[str], given: Mapping[str, Column]) -> Column:
    kind = T.ArrayType(T.FloatType()) if field.name == "data" else field.dataType
    found = [F.col(field.name)] if field.name in names else []
    found += [given[field.name]] if field.name in given else []
    return F.coalesce(*[c.cast(kind) for c in found], F.lit(None).cast(kind))


#: Layout of a file that needs no migration; the date is in the folder's name.
CURRENT = "coord_id int64, data array<float>"


def migrate_store(spark: SparkSession, path: str, missing: Mapping[str, Column] | None = None,
                  files_per_date: int = 8) -> list[int]:
    """Bring date folders that other programs wrote to the layout of the store; returns their dates.

    Footers alone tell which dates differ, by a column too few or too many or
    of another type; other dates are neither read nor written. ``missing`` gives
    an expression of the file's own columns for a column that a file may lack or
    hold NULL in; a row that has no value even then fails the run, and the
    store stays as it was. Of several images of one location and date the
    greatest ``data`` stays. A folder whose files differ among each other is read
    by all their columns. The rewritten dates take their places in one commit;
    a second run finds nothing to do.
    """
    # as many values as there are days, never as there are rows
    days = sorted(r[0] for r in file_layouts(spark, path).where(F.col("layout") != CURRENT)
                  .select("modis_date").distinct().collect())
    if not days:
        return []
    # one read for each layout, of which there are few, so that types may differ between dates
    layouts = (file_layouts(spark, path).where(F.col("modis_date").isin(days)).groupBy("modis_date")
               .agg(F.array_join(F.array_sort(F.collect_set("layout")), "; ").alias("layouts"))
               .groupBy("layouts").agg(F.collect_list("modis_date").alias("days")).collect())
    parts = [spark.read.option("mergeSchema", True).option("basePath", path)
             .parquet(*[f"{path}/modis_date={d}" for d in row["days"]]) for row in layouts]
    # an expression may name a column that only some of the folders have
    names = list(dict.fromkeys(c for part in parts for c in part.columns))
    given, old = dict(missing or {}), None
    for part in parts:
        part = part.withColumns({c: F.lit(None) for c in names if c not in part.columns})
        part = part.select(*[_filled(f, names, given).alias(f.name) for f in schema.grid_images()])
        old = part if old is None else old.unionByName(part)
    absent = F.concat(F.lit("no "), F.concat_ws(", ", *[F.when(F.col(f.name).isNull(), f.name) for f in schema.grid_images()]))
    whole = old.where(F.when(F.col("coord_id").isNull() | F.col("data").isNull(), F.raise_error(absent).cast("boolean"))
                      .otherwise(True))
    merged = settle(newest_per_key(whole, KEYS, ["data"], last=True))
    (by_date(merged, files_per_date).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("modis_date").parquet(path))
    return days
