"""Array expressions: raster cleaning, Fourier features, projections, norms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fluxframe import vocab


def clean_reflectance(values: Column) -> Column:
    """Outside 0..30000 is invalid (-1); above 10000 saturates; scaled to 0..1."""
    def one(v):
        return F.when((v < 0) | (v > 30000), F.lit(-1.0)).otherwise(
            F.least(v, F.lit(10000)) / 10000.0).cast("float")
    return F.transform(values, one)


def clean_snow(values: Column) -> Column:
    """Above 1 or missing is invalid (-1)."""
    def one(v):
        # a NaN compares as the largest value, so it falls to -1 as well
        return F.when(v <= 1, v).otherwise(F.lit(-1)).cast("float")
    return F.transform(values, one)


def clean_water(values: Column) -> Column:
    """Water class -> 1 water / 0 land. Fill values count as class 0, hence water."""
    table = F.array(*[F.lit(float(v)) for v in vocab.WATER_OF_CLASS])

    def one(v):
        known = F.when(v.between(0, 7), v).otherwise(F.lit(0)).cast("int")
        return F.element_at(table, known + 1).cast("float")
    return F.transform(values, one)


def water_band(bands: Column) -> Column:
    """The water band is the third of three bands, or the second of two."""
    return F.element_at(bands, F.when(F.size(bands) > 2, 3).otherwise(2))


def image_tensor(reflectance: Column, snow_water: Column) -> Column:
    """Seven reflectance bands plus snow and water -> one flat 9*8*8 array."""
    return F.concat(F.flatten(F.transform(reflectance, clean_reflectance)),
                    clean_snow(F.element_at(snow_water, 1)),
                    clean_water(water_band(snow_water)))


def channel(tensor: Column, index: int) -> Column:
    return F.slice(tensor, index * vocab.PIXELS + 1, vocab.PIXELS)


def negative_share(values: Column) -> Column:
    return F.size(F.filter(values, lambda v: v < 0)) / F.size(values)


def channel_is_masked(values: Column, ratio: float = 0.3) -> Column:
    """A channel with too many invalid (negative) pixels is ignored."""
    return negative_share(values) > ratio


def fourier(x: Column, frequencies: int) -> Column:
    """sin(pi 2^k x) for all k, followed by the cosines."""
    ks = [float(2 ** k) * 3.141592653589793 for k in range(frequencies)]
    return F.array(*[F.sin(x * k) for k in ks], *[F.cos(x * k) for k in ks])


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda u, v: u.cast("double") * v.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm_l2(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def norm_max(a: Column) -> Column:
    return F.array_max(F.transform(a, lambda v: F.abs(v)))


def first_or_empty(a: Column) -> Column:
    return F.slice(a, 1, 1)


def cells_of_strip(pixels: Column, rows: int = vocab.TILE_PIXELS, width: int = vocab.TILE_PIXELS,
                   columns: int = vocab.GRID_COLS) -> Column:
    """Cut one band of an 8-pixel-high strip (row-major) into flat square tiles."""
    line = columns * width

    def tile(col):
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)),
                                     lambda r: F.slice(pixels, r * line + col * width + 1, width)))
    return F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), tile)
