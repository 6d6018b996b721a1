"""Gridded NetCDF files as long tables. Needs xarray on the executors."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fluxframe.sources.planned import read_planned

RENAMED = {"latitude": "lat", "longitude": "lon", "valid_time": "timestamp", "ELEVATION": "elev"}


class TimeChunk(InputPartition):
    def __init__(self, path: str, first: int, stop: int):
        self.path, self.first, self.stop = path, first, stop


class NetcdfSource(DataSource):
    """Options: path (comma-separated), time (dimension), steps (per task)."""

    @classmethod
    def name(cls) -> str:
        return "netcdf_long"

    def schema(self) -> T.StructType:
        import xarray

        with xarray.open_dataset(self.options["path"].split(",")[0]) as ds:
            fields = [T.StructField(str(d), T.TimestampNTZType() if "time" in str(d) else T.DoubleType())
                      for d in ds.dims]
            fields += [T.StructField(str(v), T.DoubleType()) for v in ds.data_vars]
        return T.StructType(fields)

    def reader(self, schema):
        return NetcdfReader(self.options, schema)


class NetcdfReader(DataSourceReader):
    def __init__(self, options, schema):
        self.paths = options["path"].split(",")
        self.time = options.get("time", "valid_time")
        self.steps = int(options.get("steps", 24))
        self.schema = schema

    def partitions(self):
        import xarray

        chunks = []
        for path in self.paths:
            with xarray.open_dataset(path) as ds:
                count = ds.sizes.get(self.time, 1)
            chunks += [TimeChunk(path, a, min(a + self.steps, count)) for a in range(0, count, self.steps)]
        return chunks

    def read(self, part):
        import pyarrow as pa
        import xarray
        from pyspark.sql.pandas.types import to_arrow_schema

        with xarray.open_dataset(part.path) as ds:
            piece = ds.isel({self.time: slice(part.first, part.stop)}) if self.time in ds.sizes else ds
            rows = piece.to_dataframe().reset_index()[self.schema.fieldNames()]
        yield from pa.Table.from_pandas(rows, schema=to_arrow_schema(self.schema),
                                        preserve_index=False).to_batches()


def read_netcdf(spark: SparkSession, paths: Sequence[str], steps: int = 24, time: str = "valid_time") -> DataFrame:
    """Rows of all files, which have the variables of the first; axes are read by the tasks."""
    return tidy_names(read_planned(spark, paths, NetcdfSource, {"steps": str(steps), "time": time}))


def tidy_names(df: DataFrame) -> DataFrame:
    """Drop the region column, use the library's names, NaN -> NULL."""
    from fluxframe.schema import nan_to_null

    return nan_to_null(df.drop("region_id").withColumnsRenamed(RENAMED))


def write_netcdf_slices(long: DataFrame, folder: str, variables: Sequence[str]) -> DataFrame:
    """One NetCDF file per time step, written by the tasks; returns the files.

    A group is one time step of a de-duplicated grid, whose size is that of the
    grid however long the series is. Every file has the axes of the whole series,
    NaN where a step has no row. ``folder`` must be a path all executors share;
    a file takes its name only when it is complete, so a repeated task does no
    harm.
    """
    lats, lons = ([r[0] for r in long.select(c).distinct().orderBy(c).collect()] for c in ("lat", "lon"))

    def write(pdf):
        import pandas as pd

        step = int(pdf["timestamp"].iloc[0])
        ds = pdf.set_index(["lat", "lon"])[list(variables)].astype("float32").to_xarray()
        ds = ds.reindex(lat=lats, lon=lons)
        ds = ds.sortby("lat", ascending=False).rename(lat="latitude", lon="longitude")
        path = f"{folder}/{step}.nc"
        part = f"{path}.{uuid.uuid4().hex}"
        ds.to_netcdf(part)
        os.replace(part, path)
        return pd.DataFrame({"timestamp": [step], "path": [path], "cells": [len(pdf)]})

    return (long.select("timestamp", "lat", "lon", *variables).groupBy("timestamp")
            .applyInPandas(write, "timestamp long, path string, cells long"))
