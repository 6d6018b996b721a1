"""Every query against its SQL, and again with keys cut into small chunks."""

import math

import duckdb
import pytest

import __spark_entry__ as driver
from fluxframe.queries import ORACLE, QUERIES
from fluxframe.session import HOT_KEY_ROWS

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
WINDOWED = ("trailing_rows_stats", "trailing_frames", "asof_latest", "asof_distinct_images", "grid_samples_full",
            "rolling_meter", "segment_split", "batch_losses", "flagship")


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return connection


def shown(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def compare(spark, sf, duck, name):
    got = driver.queries()[name](spark, sf)
    names = sorted(got.columns)
    result = duck.execute(driver.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    place = [columns.index(n) for n in names]
    expected = sorted(tuple(shown(r[p]) for p in place) for r in result.fetchall())
    assert sorted(tuple(shown(r[n]) for n in names) for r in got.collect()) == expected
    return expected


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query(spark, sf, duck, name):
    compare(spark, sf, duck, name)


@pytest.mark.parametrize("name", WINDOWED)
def test_query_with_cut_keys(spark, sf, duck, name):
    spark.conf.set(HOT_KEY_ROWS, "67")
    try:
        assert compare(spark, sf, duck, name)
    finally:
        spark.conf.unset(HOT_KEY_ROWS)


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["site", "igbp", "num_samples", "rmse_value", "nse_value"] and df.count() > 1


def test_catalogue():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(QUERIES) - set(ORACLE) == {"score_network"}
    assert {**QUERIES}.items() <= driver.queries().items()


@pytest.mark.parametrize("name", ["grid_samples_full", "grid_samples_images"])
@pytest.mark.parametrize("limit", [None, "67"])
def test_fractions_of_a_second(spark, sf, tmp_path, name, limit):
    """Rows of one second in an order that their ids do not have, and rows in the last second of the bound."""
    connection = duckdb.connect()
    for t in ("events", "customer"):
        value = "select *" if t == "customer" else """select event_id, event_type, value, user_id % 7 as user_id, case when event_id % 9 = 0
          then timestamp '2024-01-26 23:59:59' else date_trunc('day', ts) end + to_microseconds(900000 - event_id * 7919 % 800000) as ts"""
        connection.execute(f"copy ({value} from '{sf}/{t}.parquet') to '{tmp_path}/{t}.parquet'")
        connection.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    if limit:
        spark.conf.set(HOT_KEY_ROWS, limit)
    try:
        assert compare(spark, str(tmp_path), connection, name)
    finally:
        spark.conf.unset(HOT_KEY_ROWS)
