"""Grid operators: positions, coast stencil, interpolation, lookup, map bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from fluxframe.functions import geo, text
from fluxframe.operators.ordering import Hot, Limit, dense_order, find_hot, previous, running_sum
from fluxframe.session import settle


def axis_positions(df: DataFrame, column: str, out: str, descending: bool = False) -> DataFrame:
    """0-based rank of every distinct value of an axis."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    return dense_order(values, [F.desc(column) if descending else F.asc(column)], out)


def numbered_axes(df: DataFrame, columns: dict[str, str], descending: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Positions of the distinct values of several numeric axes, found in one pass.

    ``columns`` names the position column of each axis. Values keep their own
    types, each in a column of its own, so that whole numbers and decimals of any
    length join exactly. Text is refused: its order is not that of numbers. NULL
    and NaN have no position.
    """
    if texts := [c for c in columns if not isinstance(df.schema[c].dataType, T.NumericType)]:
        raise TypeError(f"axes must be numeric, cast them first: {texts}")

    def own(c: str):
        value = F.col(c)
        return F.when(~F.isnan(value), value) if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) else value
    entries = F.array(*[F.struct(F.lit(a).alias("axis"), *[
        (own(c) if c == a else F.lit(None).cast(df.schema[c].dataType)).alias(f"v{k}") for k, c in enumerate(columns)])
        for a in columns])
    values = df.select(F.explode(entries).alias("e")).select("e.*").distinct()
    names = [f"v{k}" for k in range(len(columns))]
    values = values.where(F.greatest(*[F.col(n).isNotNull() for n in names], F.lit(False)))
    sort = [F.desc(n) if c in descending else F.asc(n) for n, c in zip(names, columns, strict=True)]
    numbered = dense_order(values, ["axis", *sort], "n")
    # one row per axis
    starts = {r["axis"]: r["start"] for r in numbered.groupBy("axis").agg(F.min("n").alias("start")).collect()}
    return {c: numbered.where(F.col("axis") == c).select(
        F.col(n).alias(c), (F.col("n") - starts.get(c, 0)).alias(out))
        for n, (c, out) in zip(names, columns.items(), strict=True)}


def with_positions(df: DataFrame, columns: dict[str, str], descending: Sequence[str] = ()) -> DataFrame:
    """Attach axis positions, given as ``column: position column``."""
    for column, axis in numbered_axes(df, columns, descending).items():
        df = df.join(axis, column)
    return df


def to_matrix(df: DataFrame, row: str, column: str, value: str, columns: Sequence) -> DataFrame:
    """Long cells -> one row per ``row`` with a column per listed value. Several
    different values of one cell are an error, and so is a value that is not listed."""
    listed = F.coalesce(F.col(column).isin(*columns), F.lit(False))
    refused = F.raise_error(F.concat(F.lit("column not listed: "), F.coalesce(F.col(column).cast("string"), F.lit("NULL"))))
    df = df.where(F.coalesce(F.when(~listed, refused).cast("boolean"), F.lit(True)))
    single = F.when(F.min(value) == F.max(value), F.max(value)).when(
        F.count(value) > 0, F.raise_error(F.lit("a cell has several values")).cast(df.schema[value].dataType))
    return df.groupBy(row).pivot(column, list(columns)).agg(single)


def from_matrix(matrix: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """The inverse; empty cells are left out."""
    return matrix.unpivot(row, [c for c in matrix.columns if c != row], column, value).where(F.col(value).isNotNull())


def neighbour_count(cells: DataFrame, flag: str, i: str = "i", j: str = "j",
                    out: str = "neighbours") -> DataFrame:
    """How many of the eight surrounding cells carry the flag; outside counts as no.

    Flagged cells announce themselves to their neighbours, so nothing is paired
    and the work grows with the number of flagged cells.
    """
    steps = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))
             for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
    votes = (cells.where(F.col(flag)).select(i, j, F.explode(F.array(*steps)).alias("s"))
             .groupBy((F.col(i) + F.col("s.a")).alias(i), (F.col(j) + F.col("s.b")).alias(j))
             .agg(F.count("*").alias(out)))
    return cells.join(votes, [i, j], "left").withColumn(out, F.coalesce(out, F.lit(0)))


def land_or_coast(cells: DataFrame, share: str = "lsm", lat: str = "lat", lon: str = "lon",
                  threshold: float = 0.5) -> DataFrame:
    """Keep land cells and cells next to land.

    ``cells`` has one row per coordinate. Neighbours are taken on the grid of
    values that occur, without wrapping at the date line. A missing share is
    not land, and a NaN, which Spark would call larger, is not either.
    """
    land = F.coalesce((F.col(share) > threshold) & ~F.isnan(share), F.lit(False))
    # read four times below, so worked out once
    placed = with_positions(settle(cells.withColumn("land", land)), {lat: "i", lon: "j"})
    counted = neighbour_count(placed, "land")
    return counted.where(F.col("land") | (F.col("neighbours") > 0))


def bilinear(points: DataFrame, grid: DataFrame, x: str, y: str, value: str, origin: tuple[float, float],
             step: tuple[float, float], size: tuple[int, int], point_id: Sequence[str],
             out: str) -> DataFrame:
    """Bilinear interpolation of a regular grid at given points.

    ``grid`` has integer ``gx, gy`` and the value. Each point asks for its four
    corners by equality and their weighted values are summed. Outside the grid,
    or where a corner is missing, the result is NULL.
    """
    fx = (F.col(x) - origin[0]) / step[0]
    fy = (F.col(y) - origin[1]) / step[1]
    placed = points.withColumns({"__fx": fx, "__fy": fy})
    placed = placed.withColumns({
        "__ix": F.least(F.floor("__fx"), F.lit(size[0] - 2)),
        "__iy": F.least(F.floor("__fy"), F.lit(size[1] - 2))})
    inside = F.col("__fx").between(0, size[0] - 1) & F.col("__fy").between(0, size[1] - 1)
    u, v = F.col("__fx") - F.col("__ix"), F.col("__fy") - F.col("__iy")
    corners = F.array(*[F.struct((F.col("__ix") + a).alias("gx"), (F.col("__iy") + b).alias("gy"),
                                 ((u if a else 1 - u) * (v if b else 1 - v)).alias("w"))
                        for a in (0, 1) for b in (0, 1)])
    asked = (placed.where(inside).select(*point_id, F.explode(corners).alias("c"))
             .select(*point_id, "c.gx", "c.gy", "c.w"))
    usable = F.when(~F.isnan(value), F.col(value))
    summed = (asked.join(grid.select("gx", "gy", value), ["gx", "gy"], "left")
              .groupBy(*point_id)
              .agg(F.when(F.count(usable) == 4, F.sum(F.col("w") * usable)).alias(out)))
    return points.join(summed, list(point_id), "left")


def sample_raster(points: DataFrame, raster: DataFrame, lat: str, lon: str, west: float, north: float,
                  step: float, rows: int, cols: int, nearest_centre: bool = False) -> DataFrame:
    """Attach the raster value at each point by index arithmetic.

    ``raster`` has row, col and value columns. By default a point takes the
    pixel it lies in, else the pixel with the nearest centre; on a regular grid
    that is the nearest neighbour.
    """
    if nearest_centre:
        row = geo.nearest_pixel(-F.col(lat), -(north - step / 2), step, rows)
        col = geo.nearest_pixel(F.col(lon), west + step / 2, step, cols)
    else:
        row = geo.floor_pixel(-F.col(lat), -north, step, rows)
        col = geo.floor_pixel(F.col(lon), west, step, cols)
    return points.withColumns({"row": row, "col": col}).join(raster, ["row", "col"], "left").drop("row", "col")


def mosaic(tiles: DataFrame, order: str = "tile") -> DataFrame:
    """One raster from overlapping tiles; the first tile with a pixel wins."""
    others = [c for c in tiles.columns if c not in ("row", "col", order)]
    first = F.min_by(F.struct(*others), order).alias("v")
    return tiles.groupBy("row", "col").agg(first).select("row", "col", "v.*")


def tile_grid(spark, size: int) -> DataFrame:
    """The download tiles of the globe, numbered in request order."""
    lons = F.sequence(F.lit(-180), F.lit(180 - size), F.lit(size))
    lats = F.sequence(F.lit(-90), F.lit(90 - size), F.lit(size))
    return (spark.range(1).select(F.explode(lons).alias("west"))
            .select("west", F.explode(lats).alias("south"))
            .withColumns({"east": F.col("west") + size, "north": F.col("south") + size}))


def split_at_dateline(points: DataFrame, keys: Sequence[str], order: Sequence[str], lon: str = "lon",
                      jump: float = 180.0, limit: Limit = None) -> DataFrame:
    """Number the pieces of each line, cut where the longitude jumps.

    Pieces of a single point are dropped.
    """
    limit = limit if isinstance(limit, Hot) else find_hot(points, keys, limit)
    stepped = previous(points, keys, order, {"__before": lon}, limit=limit)
    cut = F.when(F.abs(F.col(lon) - F.col("__before")) > jump, 1).otherwise(0).cast("long")
    numbered = running_sum(stepped.withColumn("__cut", cut), keys, order, "__cut", "segment", limit=limit)
    numbered = numbered.drop("__before", "__cut")
    lone = numbered.groupBy(*keys, "segment").count().where(F.col("count") < 2).drop("count")
    return numbered.join(lone, [*keys, "segment"], "left_anti")


def outline_rings(features: DataFrame, skip: str = "Antarctica") -> DataFrame:
    """Rings of (multi)polygon features as (ring, position, lon, lat) rows.

    ``features`` has name, kind and, as text, the coordinates.
    """
    point = "array<double>"
    kept = features.where((F.col("name") != skip) | F.col("name").isNull())
    single = F.from_json("coordinates", f"array<array<{point}>>")
    several = F.flatten(F.from_json("coordinates", f"array<array<array<{point}>>>"))
    rings = F.when(F.col("kind") == "Polygon", single).when(F.col("kind") == "MultiPolygon", several)
    listed = kept.select("feature", F.posexplode(rings).alias("ring", "points"))
    return (listed.select("feature", "ring", F.posexplode("points").alias("position", "p"))
            .select("feature", "ring", "position", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat")))


def pixel_bins(points: DataFrame, frame: geo.MapFrame, lat: str = "lat", lon: str = "lon",
               label: str = "igbp") -> DataFrame:
    """Number of located points per map pixel and class."""
    px, py = frame.pixels(F.col(lon), F.col(lat))
    shown = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    return (shown.groupBy(px.alias("px"), py.alias("py"),
                          F.coalesce(label, F.lit("NULL")).alias("label"))
            .agg(F.count("*").alias("n")))


def legend(points: DataFrame, label: str = "igbp") -> DataFrame:
    """Classes that occur, in legend order, with count, colour and name."""
    counted = points.groupBy(F.coalesce(label, F.lit("NULL")).alias("label")).agg(F.count("*").alias("n"))
    shown = text.legend_only(counted, "label")
    return text.in_legend_order(shown, "label").withColumns({
        "colour": text.class_colour(F.col("label")), "name": text.class_name(F.col("label"))})
