"""Geographic expressions: cells, projection, pixels."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from fluxframe import vocab
from fluxframe.functions.scalars import clamp


def wrap_longitude(lon: Column) -> Column:
    """0..360 -> -180..180."""
    turned = lon + 180.0
    return turned - 360.0 * F.floor(turned / 360.0) - 180.0


def cell_key(degrees: Column) -> Column:
    """Integer key of a quarter-degree edge, ties to even."""
    return F.rint(degrees * float(vocab.CELLS_PER_DEGREE)).cast("int")


def cell_bounds(row: Column, col: Column) -> dict[str, Column]:
    """Edges of a global quarter-degree cell counted from the north-west corner."""
    north = 90.0 - row * vocab.CELL_DEGREES
    west = -180.0 + col * vocab.CELL_DEGREES
    return {"lat_min": north - vocab.CELL_DEGREES, "lat_max": north,
            "lon_min": west, "lon_max": west + vocab.CELL_DEGREES}


def floor_pixel(value: Column, origin: float, step: float, count: int) -> Column:
    """Pixel that contains a coordinate, clipped to the raster."""
    return clamp(F.floor((value - origin) / step), 0, count - 1).cast("int")


def nearest_pixel(value: Column, first_centre: float, step: float, count: int) -> Column:
    """Pixel whose centre is nearest, clipped to the raster."""
    return clamp(F.floor((value - first_centre) / step + 0.5), 0, count - 1).cast("int")


def tile_origin(degrees: Column, low: int, size: int) -> Column:
    """Lower edge of the download tile a coordinate falls into."""
    return (low + size * F.floor((degrees - low) / size)).cast("int")


def robinson(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Robinson projection by linear interpolation between 5-degree bands."""
    lat = clamp(lat, -90.0, 90.0)
    size = F.abs(lat)
    band = F.least(F.floor(size / 5.0), F.lit(17)).cast("int")
    share = (size - band * 5.0) / 5.0

    def interpolated(table):
        values = F.array(*[F.lit(v) for v in table])
        low, high = F.element_at(values, band + 1), F.element_at(values, band + 2)
        return low + share * (high - low)

    x_scale, y_scale = vocab.ROBINSON_SCALE
    return (x_scale * interpolated(vocab.ROBINSON_X) * F.radians(lon),
            y_scale * interpolated(vocab.ROBINSON_Y) * F.signum(lat))


@dataclass(frozen=True)
class MapFrame:
    """How a projection is fitted, centred, into a pixel box."""

    projection: str
    left: float
    top: float
    scale: float
    x_min: float
    y_max: float

    @classmethod
    def fit(cls, projection: str, left: float, top: float, right: float, bottom: float) -> "MapFrame":
        if projection == "robinson":
            x_half, y_half = vocab.ROBINSON_SCALE[0] * math.pi, vocab.ROBINSON_SCALE[1]
        else:
            x_half, y_half = 180.0, 90.0
        scale = min((right - left) / (2 * x_half), (bottom - top) / (2 * y_half))
        return cls(projection,
                   left + (right - left - 2 * x_half * scale) / 2,
                   top + (bottom - top - 2 * y_half * scale) / 2,
                   scale, -x_half, y_half)

    def place(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Where on the map, in pixels and parts of them."""
        x, y = robinson(lon, lat) if self.projection == "robinson" else (lon, lat)
        return self.left + (x - self.x_min) * self.scale, self.top + (self.y_max - y) * self.scale

    def pixels(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        px, py = self.place(lon, lat)
        return F.rint(px).cast("int"), F.rint(py).cast("int")
