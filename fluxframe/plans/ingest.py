"""Raw gridded weather -> normalised facts and their dimension."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from fluxframe import schema, vocab
from fluxframe.functions import scalars, text
from fluxframe.operators import dims, layout, spatial
from fluxframe.operators.ordering import keyed_join
from fluxframe.session import settle


@dataclass(frozen=True)
class RasterFrame:
    """Place of a north-up raster."""

    west: float
    north: float
    step: float
    rows: int
    cols: int


def land_share(mask: DataFrame, origin: tuple[float, float], step: tuple[float, float],
               size: tuple[int, int], points: DataFrame) -> DataFrame:
    """Interpolate the land mask (0..360 longitudes) at the facts' coordinates."""
    east = F.when(F.col("lon") < 0, F.col("lon") + 360.0).otherwise(F.col("lon"))
    return spatial.bilinear(points.withColumn("__east", east), mask, "__east", "lat", "lsm",
                            origin, step, size, ["lat", "lon"], "lsm").drop("__east")


def build_dataset(raw: DataFrame, mask: DataFrame, cover: DataFrame, cover_frame: RasterFrame,
                  mask_origin: tuple[float, float], mask_step: tuple[float, float],
                  mask_size: tuple[int, int], strict_bounds: bool = True) -> tuple[DataFrame, DataFrame]:
    """(facts with ids, dimension) of land and coast cells.

    ``raw`` has lat, lon, elev, timestamp and predictors; ``mask`` gx, gy, lsm;
    ``cover`` row, col, code. Everything about places is worked out once per
    distinct coordinate, then joined to the hourly rows.
    """
    # one row per place with its first hour, written once: everything about
    # places, their numbers included, comes from here, and the raw rows are read
    # only once more
    narrow = schema.nan_to_null(raw.select("lat", "lon", "elev", "timestamp"))
    places = settle(narrow.groupBy("lat", "lon", "elev").agg(
        F.min(scalars.timestamp_to_int(F.col("timestamp"))).alias("first_seen")))
    coordinates = places.select("lat", "lon").distinct()
    shares = land_share(mask, mask_origin, mask_step, mask_size, coordinates)
    kept = spatial.land_or_coast(shares).select("lat", "lon")
    coded = spatial.sample_raster(kept, cover.select("row", "col", "code"), "lat", "lon",
                                  cover_frame.west, cover_frame.north, cover_frame.step,
                                  cover_frame.rows, cover_frame.cols, nearest_centre=True)
    classed = coded.select("lat", "lon", text.class_of_code(F.col("code"), at_ingest=True).alias("igbp"))
    # coordinates are copies of the raw ones, so equality is exact
    dim = dims.surrogate_keys(places.join(classed, ["lat", "lon"]), ["lat", "lon", "elev", "igbp"], "first_seen")

    found = schema.present(raw, vocab.PREDICTORS)
    rows = keyed_join(schema.nan_to_null(raw), dim.select("coord_id", "lat", "lon", "elev"), ["lat", "lon", "elev"],
                      "inner")
    rows = rows.withColumns({"DOY": scalars.day_of_year(F.col("timestamp")).cast("double"),
                             "TOD": scalars.time_of_day(F.col("timestamp")).cast("double")})
    facts = scalars.normalise_all(rows, strict_bounds).withColumn(
        "timestamp", scalars.timestamp_to_int(F.col("timestamp")))
    names = ["DOY", "TOD", *[p for p in found if p not in ("DOY", "TOD")]]
    return layout.rebuild_ids(facts.select("coord_id", "timestamp", *names)), dim


def image_cells(cells: DataFrame, dim: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Image rows of known locations, optionally only of those with facts."""
    if facts is not None:
        dim = dim.join(facts.select("coord_id"), "coord_id", "left_semi")
    return dims.cells_to_images(cells, dim)

