"""Exact slices and numbers against plain sorting."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from fluxframe import session
from fluxframe.operators import numbering

ODD = [None, float("nan"), float("inf"), float("-inf"), 0.0, 1e308, -1e308, 5e-324, 1.5]
TEXTS = [None, "", "a", "aa", "ab", "é", "zz", "漢字", "a" * 30, "a" * 30 + "b", "a" * 24 + "é"]


def table(spark, n=120, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        day = dt.date(1969, 12, 28) + dt.timedelta(days=rng.randrange(9))
        moment = None if rng.random() < 0.1 else dt.datetime(1969, 12, 31, 23, 59, 59, 999_999) + dt.timedelta(
            microseconds=rng.randrange(5_000_000))
        rows.append((i, rng.choice([3] * 5 + [None, 1, 2**60, -2**60]), rng.choice(ODD), rng.choice(TEXTS), day, moment,
                     rng.random() < 0.5, "x" * 50))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id long, k long, v double, s string, d date, t timestamp_ntz, b boolean, wide string").repartition(5)


@pytest.mark.parametrize("order,descending", [
    (["k", "v", "id"], ("k", "v")), (["d", "t", "id"], ()), (["b", "s", "id"], ("s",))])
def test_numbers_follow_spark_s_order(spark, order, descending, most=20):
    df = table(spark)
    got = numbering.number_rows(df, order, "n", 5, descending, most)
    assert got.columns == [*df.columns, "n"]
    expected = df.orderBy(*[F.desc(c) if c in descending else F.asc(c) for c in order]).collect()
    assert [r.id for r in sorted(got.collect(), key=lambda r: r.n)] == [r.id for r in expected]
    assert sorted(r.n for r in got.collect()) == list(range(5, 5 + len(expected)))


def test_slices_are_bounded_and_ordered(spark):
    rng = random.Random(7)
    values = [math.exp(rng.gauss(0, 9)) for _ in range(600)] + [7.0] * 100
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v double, i long").repartition(6)
    digits = {"a": numbering.digits(df.schema["v"])[-1], "b": F.col("i").cast("double")}
    df = df.withColumns(digits)
    placed, counted = numbering.slices(df, {"v": ["a"], "i": ["b"]}, 40)
    found = {tuple(r["__path"]): r["rows"] for r in counted.collect()}
    assert max(found.values()) <= 40 and sum(found.values()) == 700
    ends = {}
    for r in placed(df).collect():
        ends.setdefault(tuple(r["__path"]), []).append((r.v, r.i))
    ordered = [ends[p] for p in sorted(ends)]
    assert all(max(a) < min(b) for a, b in zip(ordered, ordered[1:]))


def test_equal_rows_get_numbers_of_their_own(spark):
    rows = [(1, "a", 1)] * 4 + [(1, "b", 2), (0, None, 3), (0, None, 4), (None, "z", 5)]
    df = spark.createDataFrame(rows, "k long, s string, i long")
    got = numbering.number_rows(df, ["k", "s"], "n", most=2)
    assert sorted(r.n for r in got.collect()) == list(range(8))
    assert {r.i: r.n for r in got.collect() if r.i in (5, 2)} == {5: 0, 2: 7}
    assert numbering.number_rows(df.limit(0), ["k", "s"], "n").count() == 0


def test_wide_columns_are_never_written(spark, tmp_path):
    table(spark, 50).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    before = len(session.SETTLED)
    plan = numbering.number_rows(df, ["k", "id"], "n", most=5)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    written = [spark.read.parquet(p).columns for p in session.SETTLED[before:]]
    assert len(written) > 1 and not any("wide" in c for columns in written for c in columns)
