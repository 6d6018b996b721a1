"""Merging prediction shards: union, duplicates, order, dense cube."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from fluxframe import schema
from fluxframe.functions import text
from fluxframe.functions.scalars import to_number, whole_column_timestamp
from fluxframe.operators.dims import newest_per_key
from fluxframe.operators.ordering import keyed_join, row_hash
from fluxframe.operators.spatial import numbered_axes
from fluxframe.session import counted, settle

ORDER = "__sample_order"
COORDINATES = ("timestamp", "lat", "lon")
BASE = ("lat", "lon", "igbp", "timestamp")
#: Where a row stood in the input, as noted by the reader of shards.
POSITION = ("__shard", "__block", "__line")
#: Longitudes in one tile of a cube.
TILE = 128


def numbered(shards: Sequence[DataFrame]) -> list[DataFrame]:
    """Tables given one by one, with the columns that keep the input order."""
    return [s.withColumns({"__shard": F.format_string("%08d", F.lit(n)), "__block": F.lit(0).cast("long"),
                           "__line": F.monotonically_increasing_id()}) for n, s in enumerate(shards)]


def union_shards(shards: Sequence[DataFrame], strict: bool = True) -> DataFrame:
    """All rows of all shards.

    Strict shards must agree on their columns; else columns follow the first
    shard by name.
    """
    if strict:
        schema.require_same_header(shards)
        return reduce(DataFrame.union, shards)
    columns = shards[0].columns
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True).select(*columns), shards)


def output_columns(df: DataFrame, targets: Sequence[str] | None) -> list[str]:
    if targets is None:
        return [c for c in df.columns if c != ORDER and c not in POSITION]
    return [*BASE, *text.pick_targets(df.columns, targets)]


def positions(df: DataFrame) -> list[str]:
    """The columns that tell the input order: those a reader of shards adds, else the sample order."""
    if set(POSITION) <= set(df.columns):
        return list(POSITION)
    return [ORDER] if ORDER in df.columns else []


def in_output_order(df: DataFrame) -> DataFrame:
    """By sample order where shards carry it, else by place and time; ties keep the input order.

    Where no input order is known, a hash of the row settles ties.
    """
    keys = [ORDER] if ORDER in df.columns else ["lat", "lon", "timestamp"]
    ties = [c for c in positions(df) if c not in keys]
    return df.orderBy(*[to_number(F.col(k)) for k in keys], *(ties or [row_hash(df)]))


def duplicate_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows in duplicate groups, and the number of such groups."""
    return (df.groupBy(*keys).count().where(F.col("count") > 1)
            .agg(F.coalesce(F.sum("count"), F.lit(0)).alias("duplicate_rows"),
                 F.count("*").alias("duplicate_groups")))


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All members of duplicate groups; groups are counted before any join."""
    repeated = df.groupBy(*keys).count().where(F.col("count") > 1).drop("count")
    return keyed_join(df, repeated, keys, "left_semi")


def resolve_duplicates(df: DataFrame, keys: Sequence[str], policy: str, order: Sequence[str]) -> DataFrame:
    """One row per key: the first or last in order, or the mean.

    With ``mean`` numbers are averaged and other columns take their first
    present value; the order itself has no mean and is left out. ``error``
    refuses duplicates and shows five examples.
    """
    if policy in ("first", "last"):
        return newest_per_key(df, keys, order, last=policy == "last")
    if policy == "mean":
        return _mean_per_key(df, keys, order)
    if policy == "error":
        examples = df.groupBy(*keys).count().where(F.col("count") > 1).limit(5).collect()
        if examples:
            raise ValueError(f"duplicate rows for {list(keys)}, such as {[r.asDict() for r in examples]}")
        return df
    raise ValueError(f"unknown duplicate policy: {policy}")


def _mean_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keys are counted by hash; only rows of keys that occur more than once are grouped, all others pass."""
    columns = [c for c in df.columns if c not in order]
    numbers = [f.name for f in df.schema.fields if schema.is_number(f) and f.name in columns and f.name not in keys]
    sequence = F.struct(*order) if order else F.lit(0)
    repeated = df.groupBy(*keys).count().where(F.col("count") > 1).select(*keys)
    several = keyed_join(df, repeated, keys, "left_semi").groupBy(*keys).agg(
        *[F.avg(c).alias(c) for c in numbers],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), sequence)).alias(c)
          for c in columns if c not in (*keys, *numbers)])
    single = keyed_join(df, repeated, keys, "left_anti").select(*columns)
    return single.withColumns({c: F.col(c).cast("double") for c in numbers}).unionByName(several.select(*columns))


def is_static(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """One row: does every cell keep one label over time? Missing is a label."""
    pairs = df.select(*keys, F.coalesce(label, F.lit("")).alias("__label")).distinct()
    per_cell = pairs.groupBy(*keys).agg(F.count("*").alias("__labels"))
    return per_cell.agg(F.bool_and(F.col("__labels") <= 1).alias("is_static"), F.count("*").alias("cells"))


def cube_axes(df: DataFrame) -> dict[str, DataFrame]:
    """Cube positions: time ascending, latitude descending, longitude ascending. The axes must be numbers."""
    return numbered_axes(df, {"timestamp": "time_index", "lat": "lat_index", "lon": "lon_index"}, descending=["lat"])


def _cells(variables: Sequence[str], labels: Sequence[str], at: Column) -> Column:
    """The cells of a group in their order; numbers in single precision."""
    entry = F.struct(at.cast("int").alias("at"), *[F.col(v).cast("float").alias(v) for v in variables],
                     *[F.col(v).cast("string").alias(v) for v in labels])
    return F.array_sort(F.collect_list(entry)).alias("__cells")


def _filled(v: str, label: bool, size: Column) -> Column:
    """One variable of the cells of a group as an array of ``size``, with holes where no cell is."""
    hole = F.lit(None).cast("string") if label else F.lit(float("nan")).cast("float")

    def holes(count):
        return F.array_repeat(hole, count.cast("int"))

    # before each cell come as many holes as positions were skipped
    def step(cell, k):
        before = F.coalesce(F.get("__cells", k - 1)["at"], F.lit(-1))
        return F.concat(holes(cell["at"] - before - 1), F.array(F.coalesce(cell[v], hole)))
    tail = size - 1 - F.element_at("__cells", -1)["at"]
    return F.coalesce(F.concat(F.flatten(F.transform("__cells", step)), holes(tail)), holes(size)).alias(v)


def dense_cube(df: DataFrame, variables: Sequence[str], axes: dict[str, DataFrame] | None = None,
               labels: Sequence[str] = ()) -> DataFrame:
    """Rows of a dense cube: every (time, latitude) and one filled array per variable.

    Numbers become single precision and NaN where there is no row; ``labels``
    are text variables, NULL there. Works per grid line, so the largest group is
    one line of the grid, and lines without any row are made as well. Duplicates
    must have been resolved. The cube has as many cells as its axes multiply to;
    where they grow with the rows, ``cube_tiles`` holds the same cube in less.
    """
    axes = axes or cube_axes(df)
    lons, lats = axes["lon"].count(), axes["lat"].count()
    placed = df
    for column, axis in axes.items():
        placed = placed.join(axis, column)
    occupied = placed.groupBy("time_index", "lat_index").agg(_cells(variables, labels, F.col("lon_index")))
    grid = axes["timestamp"].withColumn("lat_index", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(lats - 1, 0)).cast("long"))))
    lines = grid.join(axes["lat"], "lat_index").join(occupied, ["time_index", "lat_index"], "left")
    return lines.select("time_index", "timestamp", "lat_index", "lat",
                        *[_filled(v, v in labels, F.lit(lons)) for v in (*variables, *labels)])


def cube_tiles(df: DataFrame, variables: Sequence[str], axes: dict[str, DataFrame] | None = None,
               labels: Sequence[str] = (), width: int = TILE) -> DataFrame:
    """The dense cube in tiles, ``width`` neighbouring longitudes of a (time, latitude) each, as chunked files hold it.

    ``lon_start`` is the position of a tile's first cell; the last tile of a line
    is cut at its end. A tile is filled like a line of ``dense_cube``. Tiles
    without any row are not stored and stand for holes, so there are at most
    ``width`` cells for each row however far the axes reach, and the largest
    group is one tile.
    """
    axes = axes or cube_axes(df)
    lons = axes["lon"].count()
    placed = df
    for column, axis in axes.items():
        placed = placed.join(axis, column)
    at = F.col("lon_index") % width
    tiles = placed.groupBy("time_index", "timestamp", "lat_index", "lat", (F.col("lon_index") - at).alias("lon_start")).agg(
        _cells(variables, labels, at))
    size = F.least(F.lit(width), F.lit(lons) - F.col("lon_start"))
    return tiles.select("time_index", "timestamp", "lat_index", "lat", "lon_start",
                        *[_filled(v, v in labels, size) for v in (*variables, *labels)])


def long_from_cube(cube: DataFrame, variables: Sequence[str], lons: DataFrame) -> DataFrame:
    """Lines or tiles back to one row per cell; holes are dropped. ``lons`` maps lon_index to lon."""
    zipped = F.arrays_zip(*variables)
    first = F.col("lon_start") if "lon_start" in cube.columns else F.lit(0)
    cells = cube.select("timestamp", "lat", first.alias("__first"), F.posexplode(zipped).alias("__at", "v"))
    cells = cells.select("timestamp", "lat", (F.col("__first") + F.col("__at")).alias("lon_index"), "v.*")
    some = F.lit(False)
    for v in variables:
        some = some | ~F.isnan(v)
    return cells.where(some).join(lons, "lon_index").drop("lon_index")


def settle_unique(df: DataFrame, policy: str, order: Sequence[str],
                  keys: Sequence[str] = COORDINATES) -> tuple[DataFrame, dict[str, int]]:
    """``resolve_duplicates`` written once, with the rows that went in and came out, counted while they pass.

    Members and number of duplicate groups are counted only where there are any.
    """
    before, after = Observation(), Observation()
    rows = df.observe(before, F.count(F.lit(1)).alias("n"))
    # what is counted must pass once; the other policies read their input several times
    source = rows if policy in ("first", "last") else settle(rows)
    unique = settle(resolve_duplicates(source, keys, policy, order).observe(after, F.count(F.lit(1)).alias("n")))
    counts = {"input": counted(before, "n"), "output": counted(after, "n"), "duplicate_rows": 0, "duplicate_groups": 0}
    if counts["input"] != counts["output"]:
        counts |= duplicate_report(df if source is rows else source, keys).first().asDict()
    return unique, counts


def cube_attributes(counts: dict[str, int], shards: int, policy: str) -> dict[str, object]:
    """Bookkeeping stored beside a cube."""
    # fixed values: attribute names that readers of a cube know
    return {"num_shards": shards, "num_input_rows": counts["input"], "num_output_rows": counts["output"],
            "netcdf_duplicate_policy": policy,
            "num_duplicate_coordinate_rows": counts["duplicate_rows"],
            "num_duplicate_coordinate_groups": counts["duplicate_groups"],
            "timestamp_source_column": "timestamp", "timestamp_source_format": "YYYYMMDDHHMMSS"}


def require_coordinates(df: DataFrame) -> DataFrame:
    schema.require_columns(df, COORDINATES)
    holes = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in COORDINATES]).first().asDict()
    empty = [c for c, n in holes.items() if n]
    if empty:
        raise ValueError(f"coordinates with missing values: {empty}")
    return df


def numeric_output(df: DataFrame) -> DataFrame:
    """Coerce coordinates and pred_/gt_ columns; text that is no number becomes NULL."""
    def wanted(c):
        return c in ("lat", "lon", "timestamp") or c.startswith(("pred_", "gt_"))
    return df.withColumns({
        f.name: to_number(F.col(f.name)).cast("long" if f.name == "timestamp" else "double")
        for f in df.schema.fields if wanted(f.name) and isinstance(f.dataType, T.StringType)})


def merge_shards(shards: Sequence[DataFrame], targets: Sequence[str] | None = None, strict: bool = True,
                 sort: bool = True, policy: str | None = None) -> DataFrame:
    """Shards -> one table of the wanted columns, de-duplicated where asked.

    ``first`` and ``last`` go by the input order: shard and line where
    ``shards.read_shards`` noted them, else the sample order.
    """
    rows = union_shards(shards, strict)
    columns = output_columns(rows, targets)
    if policy:
        rows = require_coordinates(numeric_output(rows))
        order = positions(rows)
        if not order and policy != "error":
            raise ValueError("which duplicate comes first is unknown: read shards with their positions")
        rows = resolve_duplicates(rows, COORDINATES, policy, order)
        columns = [c for c in columns if c in rows.columns]
    if sort:
        rows = in_output_order(rows)
    return rows.select(*columns)


def time_coordinate(df: DataFrame, column: str = "timestamp") -> DataFrame:
    return whole_column_timestamp(df, column)
