"""Raster files: discovery and pairing, strips, tiles, photos, outlines.

Reading GeoTIFF or photo content needs an optional package on the executors;
everything after the pixels are in rows is plain Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fluxframe import vocab
from fluxframe.functions.arrays import cells_of_strip, clean_reflectance, clean_snow, clean_water
from fluxframe.functions.text import raster_name_parts
from fluxframe.operators.dims import unknown_codes
from fluxframe.session import settle
from fluxframe.sources.planned import read_planned

#: Degrees of longitude and latitude, as coordinates of facts are.
COVER_CRS = "EPSG:4326"


def list_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Paths only: the content column is pruned, so no file is opened."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", True).load(folder).select("path"))


def pair_files(files: DataFrame, dates: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """(timestamp, a4_path, a2_path) of timestamps with both products, in order."""
    stamp, product = raster_name_parts(F.col("path"))
    named = files.select("path", stamp.alias("timestamp"), product.alias("product")).where("timestamp != ''")
    if dates is not None:
        named = named.where(F.substring("timestamp", 1, 8).isin(*dates))
    pairs = named.groupBy("timestamp").agg(
        F.min(F.when(F.col("product") == "A4", F.col("path"))).alias("a4_path"),
        F.min(F.when(F.col("product") == "A2", F.col("path"))).alias("a2_path"))
    pairs = pairs.where(F.col("a4_path").isNotNull() & F.col("a2_path").isNotNull()).orderBy("timestamp")
    return pairs if limit is None else pairs.limit(limit)


class Strip(InputPartition):
    def __init__(self, path: str, row: int, height: int):
        self.path, self.row, self.height = path, row, height


class StripSource(DataSource):
    """GeoTIFF as horizontal strips. Options: path (comma-separated), height."""

    @classmethod
    def name(cls) -> str:
        return "raster_strips"

    def schema(self) -> str:
        return ("path string, strip int, row int, height int, width int, west double, north double, "
                "step double, bands array<array<double>>, crs string")

    def reader(self, schema):
        return StripReader(self.options)


class StripReader(DataSourceReader):
    def __init__(self, options):
        self.paths = options["path"].split(",")
        self.height = int(options.get("height", vocab.TILE_PIXELS))

    def partitions(self):
        import rasterio

        found = []
        for path in self.paths:
            with rasterio.open(path) as raster:
                found += [Strip(path, row, min(self.height, raster.height - row))
                          for row in range(0, raster.height, self.height)]
        return found

    def read(self, part):
        import rasterio
        from rasterio.windows import Window

        with rasterio.open(part.path) as raster:
            place = raster.transform
            if place.a <= 0 or place.e >= 0:
                raise ValueError(f"{part.path} is not north-up")
            pixels = raster.read(window=Window(0, part.row, raster.width, part.height))
            yield (part.path, part.row // self.height, part.row, part.height, raster.width,
                   float(place.c), float(place.f), float(place.a),
                   pixels.reshape(len(pixels), -1).astype(float).tolist(),
                   None if raster.crs is None else raster.crs.to_string())


def read_strips(spark: SparkSession, paths: Sequence[str], height: int = vocab.TILE_PIXELS) -> DataFrame:
    """Strips of all files; their sizes are read by the tasks."""
    options = {"height": str(height)}
    return read_planned(spark, paths, StripSource, options, StripSource({}).schema())


def require_raster(strips: DataFrame, bands: Sequence[int], width: int, height: int, crs: str | None = None) -> DataFrame:
    """Every file must have an allowed number of bands, the expected size and, if one is given, that reference system."""
    shape = [F.max("width").alias("width"), F.sum("height").alias("height"), F.max(F.size("bands")).alias("bands")]
    misfit = (F.col("width") != width) | (F.col("height") != height) | ~F.col("bands").isin(*bands)
    if crs is not None:
        shape.append(F.max("crs").alias("crs"))
        misfit = misfit | ~F.col("crs").eqNullSafe(F.lit(crs))
    wrong = strips.groupBy("path").agg(*shape).where(misfit)
    found = wrong.limit(1).collect()
    if found:
        raise ValueError(f"unexpected raster: {found[0].asDict()}")
    return strips


def strip_pixels(strips: DataFrame, band: int = 1) -> DataFrame:
    """Strips of one band -> (row, col, code) with pixel-centre coordinates."""
    pixels = strips.select("row", "width", "west", "north", "step",
                           F.posexplode(F.element_at("bands", band)).alias("at", "code"))
    return pixels.select(
        (F.col("row") + F.floor(F.col("at") / F.col("width"))).cast("int").alias("row"),
        (F.col("at") % F.col("width")).cast("int").alias("col"),
        F.col("code").cast("int").alias("code"))


def land_cover(strips: DataFrame, width: int, height: int) -> DataFrame:
    """(row, col, code) of a land-cover raster, after its shape, reference system and codes have been checked.

    It must have one band of the expected size in ``COVER_CRS``, and no code
    without a class. Strips are written once: the checks and the caller read that.
    """
    strips = settle(strips)
    pixels = strip_pixels(require_raster(strips, [1], width, height, COVER_CRS))
    unknown = unknown_codes(pixels).limit(5).collect()
    if unknown:
        raise ValueError(f"codes without a class: {sorted(r['code'] for r in unknown)}")
    return pixels


def read_land_cover(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    return land_cover(read_strips(spark, [path]), width, height)


def strips_to_cells(reflectance: DataFrame, snow_water: DataFrame, columns: int = vocab.GRID_COLS) -> DataFrame:
    """Paired strips (key modis_date, strip) -> one cleaned 9*8*8 tensor per cell."""
    joined = (reflectance.select("modis_date", "strip", F.col("bands").alias("a4"))
              .join(snow_water.select("modis_date", "strip", F.col("bands").alias("a2")),
                    ["modis_date", "strip"]))
    water = F.element_at("a2", F.when(F.size("a2") > 2, 3).otherwise(2))
    cleaned = F.concat(F.transform("a4", clean_reflectance),
                       F.array(clean_snow(F.element_at("a2", 1)), clean_water(water)))
    tiles = joined.select("modis_date", "strip",
                          F.transform(cleaned, lambda b: cells_of_strip(b, columns=columns)).alias("bands"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(columns - 1)),
                        lambda i: F.flatten(F.transform("bands", lambda b: b[i])))
    return tiles.select("modis_date", F.col("strip").alias("grid_row"),
                        F.posexplode(cells).alias("grid_col", "data"))


def decode_photos(files: DataFrame, size: tuple[int, int] | None = None) -> DataFrame:
    """binaryFile rows -> standardised (3, H, W) floats, flat. Needs Pillow."""
    import pandas as pd

    # Channel means and deviations of the photo encoder.
    means, deviations = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)

    def run(batches):
        import io

        import numpy as np
        from PIL import Image

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                with Image.open(io.BytesIO(content)) as image:
                    pixels = np.asarray(image.convert("RGB"), dtype=np.float32) / 255
                scaled = (pixels - np.float32(means)) / np.float32(deviations)
                rows.append((path, *pixels.shape[:2], scaled.transpose(2, 0, 1).ravel()))
            yield pd.DataFrame(rows, columns=["path", "height", "width", "pixels"])

    return files.select("path", "content").mapInPandas(
        run, "path string, height int, width int, pixels array<float>")


def read_outlines(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON -> (feature, name, kind, coordinates as text)."""
    layout = ("features array<struct<properties: struct<ADMIN: string>, "
              "geometry: struct<type: string, coordinates: string>>>")
    loaded = spark.read.schema(layout).option("multiLine", True).json(path)
    return (loaded.select(F.posexplode("features").alias("feature", "f"))
            .select("feature", F.col("f.properties.ADMIN").alias("name"), F.col("f.geometry.type").alias("kind"),
                    F.col("f.geometry.coordinates").alias("coordinates"))
            .where(F.col("kind").isNotNull()))
