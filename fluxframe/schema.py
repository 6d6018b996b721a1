"""Table shapes, missing-value rules and column checks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from fluxframe import vocab


def grid_facts(predictors: Sequence[str] = vocab.PREDICTORS) -> T.StructType:
    return T.StructType(
        [T.StructField("id", T.LongType(), False),
         T.StructField("coord_id", T.LongType(), False),
         T.StructField("timestamp", T.LongType(), False)]
        + [T.StructField(p, T.DoubleType()) for p in predictors])


def site_facts(predictors: Sequence[str] = vocab.PREDICTORS,
               targets: Sequence[str] = vocab.TARGETS) -> T.StructType:
    return T.StructType(
        [T.StructField("id", T.LongType(), False),
         T.StructField("site", T.StringType(), False),
         T.StructField("timestamp", T.LongType(), False)]
        + [T.StructField(c, T.DoubleType()) for c in (*predictors, *targets)])


def coord_dim() -> T.StructType:
    return T.StructType(
        [T.StructField("coord_id", T.LongType(), False),
         T.StructField("lat", T.DoubleType(), False),
         T.StructField("lon", T.DoubleType(), False),
         T.StructField("elev", T.DoubleType()),
         T.StructField("igbp", T.StringType())])


def site_dim() -> T.StructType:
    return T.StructType(
        [T.StructField("site", T.StringType(), False),
         T.StructField("lat", T.DoubleType()),
         T.StructField("lon", T.DoubleType()),
         T.StructField("elev", T.DoubleType()),
         T.StructField("igbp", T.StringType())])


def grid_images() -> T.StructType:
    return T.StructType(
        [T.StructField("coord_id", T.LongType(), False),
         T.StructField("modis_date", T.IntegerType(), False),
         T.StructField("data", T.ArrayType(T.FloatType(), False), False)])


def predictions(targets: Sequence[str]) -> T.StructType:
    return T.StructType(
        [T.StructField("__sample_order", T.LongType()),
         T.StructField("lat", T.DoubleType()),
         T.StructField("lon", T.DoubleType()),
         T.StructField("igbp", T.StringType()),
         T.StructField("timestamp", T.LongType())]
        + [T.StructField(f"pred_{t}", T.DoubleType()) for t in targets])


def is_float(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.FloatType, T.DoubleType))


def is_number(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NULL is the only missing marker: run this once at every source."""
    floats = {f.name: F.when(~F.isnan(f.name), F.col(f.name))
              for f in df.schema.fields if is_float(f)}
    return df.withColumns(floats) if floats else df


def finite(col: Column) -> Column:
    """True only for a present, finite number (NaN and infinities excluded)."""
    return F.coalesce(F.abs(col) < F.lit(float("inf")), F.lit(False))


def require_columns(df: DataFrame, needed: Iterable[str]) -> DataFrame:
    absent = sorted(set(needed) - set(df.columns))
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return df


def require_tables(spark, needed: Iterable[str]) -> list[str]:
    absent = [t for t in needed if not spark.catalog.tableExists(t)]
    if absent:
        raise ValueError(f"missing tables: {', '.join(absent)}")
    return [t.name for t in spark.catalog.listTables()]


def present(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """The wanted columns the table really has, in the wanted order."""
    return [c for c in wanted if c in df.columns]


def require_same_header(frames: Sequence[DataFrame]) -> None:
    for n, frame in enumerate(frames[1:], start=1):
        if frame.columns != frames[0].columns:
            raise ValueError(f"shard {n} has columns {frame.columns}, expected {frames[0].columns}")


def with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def drop_empty(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Leave out those of the columns that hold no value at all."""
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first().asDict()
    return df.drop(*[c for c, n in counts.items() if n == 0])


def create_tables(spark, predictors: Sequence[str] = vocab.PREDICTORS, prefix: str = "") -> list[str]:
    """Create the empty grid tables anew; returns their names."""
    layouts = {"ec_data": grid_facts(predictors), "coord_data": coord_dim(), "modis_data": grid_images()}
    for name, layout in layouts.items():
        spark.sql(f"drop table if exists {prefix}{name}")
        spark.createDataFrame([], layout).write.saveAsTable(prefix + name)
    return [prefix + name for name in layouts]
