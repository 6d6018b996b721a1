"""Smoothed series of logged values."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fluxframe.operators.ordering import Limit, keyed_join, over_last_rows


def smoothed(series: DataFrame, name: str, step: str, value: str, window: int = 20,
             limit: Limit = None) -> DataFrame:
    """Median, mean, deviation, maximum over the last rows, and the overall mean.

    The median of an even number of values is the lower middle one.
    """
    rolled = over_last_rows(series, [name], [step], window, {
        "__last": F.collect_list(value),
        "avg": F.avg(value), "std": F.stddev_samp(value), "max": F.max(value)}, limit=limit)
    # counted from 0; nothing where all of the last values are missing
    middle = F.floor((F.size("__last") - 1) / 2).cast("int")
    rolled = rolled.withColumn("median", F.get(F.array_sort("__last"), middle)).drop("__last")
    overall = series.groupBy(name).agg(F.avg(value).alias("global_avg"))
    return keyed_join(rolled, overall, [name])


def remaining_time(series: DataFrame, name: str, seconds: str, total: int) -> DataFrame:
    """Seconds left per series, from its mean time per step."""
    done = series.groupBy(name).agg(F.avg(seconds).alias("per_step"), F.count("*").alias("steps"))
    return done.withColumn("eta_seconds",
                           F.floor(F.col("per_step") * F.greatest(F.lit(total) - F.col("steps"), F.lit(0))))
