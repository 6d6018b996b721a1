"""CSV shards and metric files."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fluxframe.functions.scalars import to_number
from fluxframe.operators.merge import POSITION


def shard_paths(spark: SparkSession, folder: str, count: int | None = None) -> list[str]:
    """The expected shard files, or all there are; an absent one is an error."""
    if count is not None and count <= 0:
        raise ValueError("the number of shards must be positive")
    # the file index also lists empty files, which a scan would skip
    found = spark.read.option("pathGlobFilter", "rank_*.csv").text(folder).inputFiles()
    listed = {p.rsplit("/", 1)[-1]: p for p in found}
    wanted = sorted(listed) if count is None else [f"rank_{n:05d}.csv" for n in range(count)]
    absent = [name for name in wanted if name not in listed]
    if absent or not wanted:
        raise FileNotFoundError(f"missing shards in {folder}: {', '.join(absent) or 'all'}")
    return [listed[name] for name in wanted]


def headers(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """The header of each file that has one, by its name, found in a single pass over all of them.

    Lines are read in the order of the file, so that the first is the one of the
    smallest running number in the file's first block; only that leaves a task.
    """
    leaf = F.element_at(F.split("_metadata.file_path", "/"), -1)
    lines = spark.read.text(paths).where("_metadata.file_block_start = 0 and value != ''").select(
        leaf.alias("file"), "value", F.monotonically_increasing_id().alias("line"))
    # one row per file
    found = lines.groupBy("file").agg(F.min_by("value", "line").alias("value")).collect()
    return {r["file"]: next(csv.reader([r["value"].removeprefix("\ufeff")])) for r in found}


def _scan(spark: SparkSession, paths: list[str], names: list[str]) -> DataFrame:
    """Values as text. Spark itself checks every header against the names."""
    layout = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.option("header", True).option("enforceSchema", False).schema(layout).csv(paths)
    leaf = F.element_at(F.split("_metadata.file_path", "/"), -1)
    return df.withColumns({"__shard": leaf, "__block": F.col("_metadata.file_block_start"),
                           "__line": F.monotonically_increasing_id()})


def read_shards(spark: SparkSession, paths: list[str], strict: bool = True) -> DataFrame:
    """All shards in one scan, with columns that keep the input order.

    Empty shards are skipped. Strict shards must have one header; otherwise
    columns are matched by name with the first shard's.
    """
    named = headers(spark, paths)
    known = [(p, named[leaf]) for p in paths if (leaf := p.rsplit("/", 1)[-1]) in named]
    if not known:
        raise ValueError("all shards are empty")
    first = known[0][1]
    if strict:
        for p, names in known:
            if names != first:
                raise ValueError(f"the header of {p} is {names}, expected {first}")
        return _scan(spark, paths, first)
    groups: dict[tuple[str, ...], list[str]] = {}
    for p, names in known:
        groups.setdefault(tuple(names), []).append(p)
    frames = []
    for names, members in groups.items():
        df = _scan(spark, members, list(names))
        lacking = {n: F.lit(None).cast("string") for n in first if n not in names}
        frames.append(df.withColumns(lacking).select(*first, *POSITION))
    return reduce(DataFrame.union, frames)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A metrics file; ``nan`` cells and the TOTAL row's empty class become NULL."""
    df = spark.read.option("header", True).csv(path)

    def typed(c):
        if c in ("site", "igbp"):
            return F.col(c)
        return to_number(F.col(c)).cast("long" if c.startswith("num_") else "double").alias(c)
    return df.select(*[typed(c) for c in df.columns])
