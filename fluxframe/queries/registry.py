"""Named queries over the driver's tables, each with SQL of equal meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fluxframe.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    """Register a function under its own name."""
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function
    return register


def events(spark, folder):
    return table(spark, folder, "events")


def customers_on_the_map(spark, folder) -> DataFrame:
    """Customers as locations: balances spread over longitudes and latitudes."""
    east = F.col("c_acctbal") * 7.0 + 180.0
    up = F.col("c_acctbal") * 3.0 + 90.0
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("coord_id"), "c_nationkey", "c_mktsegment",
        (up - 180.0 * F.floor(up / 180.0) - 90.0).alias("lat"),
        (east - 360.0 * F.floor(east / 360.0) - 180.0).alias("lon"))


#: The same as SQL.
ON_THE_MAP = """(select c_custkey as coord_id, c_nationkey, c_mktsegment,
  (c_acctbal*3.0e0+90.0e0) - 180.0e0*floor((c_acctbal*3.0e0+90.0e0)/180.0e0) - 90.0e0 as lat,
  (c_acctbal*7.0e0+180.0e0) - 360.0e0*floor((c_acctbal*7.0e0+180.0e0)/360.0e0) - 180.0e0 as lon
  from customer)"""


def moment(text: str):
    return F.lit(text).cast("timestamp_ntz")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})
