"""Parquet tables and text configuration."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from fluxframe import schema


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def clean_table(spark: SparkSession, path: str, wanted: list[str] | None = None) -> DataFrame:
    """A parquet table with NaN turned into NULL, projected to wanted columns."""
    df = spark.read.parquet(path)
    if wanted is not None:
        df = schema.require_columns(df, wanted).select(*wanted)
    return schema.nan_to_null(df)


def quarters(df: DataFrame, ts: str) -> DataFrame:
    """Partition columns for year-by-quarter runs."""
    return df.withColumns({"year": F.year(ts), "quarter": F.quarter(ts)})


def load_config(path: str | Path, defaults: dict | None = None, overrides: dict | None = None) -> dict:
    """YAML mapping; defaults are weakest, explicit overrides strongest."""
    import yaml

    loaded = yaml.safe_load(Path(path).read_text()) or {}
    if not isinstance(loaded, dict):
        raise ValueError(f"{path} does not hold a mapping")
    given = {k: v for k, v in (overrides or {}).items() if v is not None}
    return {**(defaults or {}), **loaded, **given}


def find_config(run: str | Path, explicit: str | Path | None = None) -> Path:
    """The given file, else ``config.yml`` in the run folder or beside it."""
    run = Path(run)
    for candidate in [Path(explicit)] if explicit else [run / "config.yml", run.parent / "config.yml"]:
        if candidate.exists():
            return candidate
    raise FileNotFoundError(f"no configuration for {run}")


def latest_checkpoint(files: DataFrame, path: str = "path") -> DataFrame:
    """``last.pth`` where there is one, else the highest ``checkpoint-<n>.pth``."""
    leaf = F.element_at(F.split(path, "/"), -1)
    number = F.regexp_extract(leaf, r"^checkpoint-(\d+)\.pth$", 1).try_cast("long")
    rank = F.when(leaf == "last.pth", F.lit(2 ** 62)).otherwise(number)
    return (files.withColumn("__rank", rank).where(F.col("__rank").isNotNull())
            .agg(F.max_by(path, "__rank").alias(path)).where(F.col(path).isNotNull()))


def dataset_layout(df: DataFrame) -> dict[str, object]:
    """Cube, flat or other, by the coordinate columns present."""
    columns = set(df.columns)
    if {"time", "latitude", "longitude"} <= columns:
        kind = "cube"
    elif "sample" in columns:
        kind = "flat"
    else:
        kind = "other"
    dims = schema.present(df, ["time", "latitude", "longitude", "sample"])
    return {"kind": kind, "dims": dims, "variables": [c for c in df.columns if c not in dims]}


def describe(df: DataFrame) -> DataFrame:
    """One row per column: type, values present, smallest and largest."""
    listed = []
    for f in df.schema.fields:
        simple = not f.dataType.simpleString().startswith(("array", "struct", "map", "binary"))
        low = F.min(f.name).cast("string") if simple else F.lit(None).cast("string")
        high = F.max(f.name).cast("string") if simple else F.lit(None).cast("string")
        listed.append(F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"),
                               F.count(f.name).alias("present"), low.alias("low"), high.alias("high")))
    return df.agg(F.array(*listed).alias("c")).select(F.explode("c").alias("c")).select("c.*")
