"""Order operators against brute force, with and without hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from fluxframe.operators import ordering as o


def data(seed=1, n=300):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", None])
        out.append((key, rng.randrange(50), i, None if rng.random() < 0.3 else rng.randrange(100)))
    return out


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(data(), "k string, t long, i long, v long").repartition(5)


def by_key():
    groups = {}
    for r in sorted(data(), key=lambda r: (r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    return groups


LIMITS = [None, 7, 40]


def test_dense_order(df):
    got = [r.n for r in o.dense_order(df, ["k", "t", "i"], "n").orderBy("k", "t", "i").collect()]
    assert got == list(range(300))
    down = o.dense_order(df, [F.desc("i")], "n", start=1).orderBy("n").collect()
    assert [r.i for r in down] == list(range(299, -1, -1)) and down[0].n == 1


@pytest.mark.parametrize("limit", LIMITS)
def test_over_last_rows(df, limit):
    got = o.over_last_rows(df, ["k"], ["t", "i"], 5, {
        "frame": F.collect_list("i"), "total": F.sum("v")}, limit=limit)
    assert got.columns == ["k", "t", "i", "v", "frame", "total"]
    expected = {}
    for group in by_key().values():
        for n, r in enumerate(group):
            frame = group[max(0, n - 4):n + 1]
            values = [x[3] for x in frame if x[3] is not None]
            expected[r[2]] = ([x[2] for x in frame], sum(values) if values else None)
    assert {r.i: (r.frame, r.total) for r in got.collect()} == expected
    assert got.count() == 300


@pytest.mark.parametrize("limit", LIMITS)
def test_running(df, limit):
    last = {r.i: r.x for r in o.running_last(df, ["k"], ["t", "i"], "v", "x", limit=limit).collect()}
    total = {r.i: r.x for r in o.running_sum(df, ["k"], ["t", "i"], "v", "x", limit=limit).collect()}
    count = {r.i: r.x for r in o.running_count(df, ["k"], ["t", "i"], "x", limit=limit).collect()}
    before = {r.i: r.x for r in o.previous(df, ["k"], ["t", "i"], {"x": "i"}, limit=limit).collect()}
    for group in by_key().values():
        newest, summed = None, None
        for n, r in enumerate(group):
            if r[3] is not None:
                newest, summed = r[3], (summed or 0) + r[3]
            assert last[r[2]] == newest
            assert total[r[2]] == summed
            assert count[r[2]] == n + 1
            assert before[r[2]] == (group[n - 1][2] if n else None)


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("n", [1, 4, 60, 1001])
def test_from_nth_row(df, n, limit):
    got = {r.i for r in o.from_nth_row(df, ["k"], ["t", "i"], n, limit=limit).collect()}
    assert got == {r[2] for g in by_key().values() for r in g[n - 1:]}


def test_nth_row_is_limited_before_the_shuffle(df):
    plan = o.nth_row(df, ["k"], ["t", "i"], 8)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("shards", [1, 7, 299, 301])
def test_balanced_shards(df, shards):
    sizes = {r.shard: r["count"] for r in o.balanced_shards(df, ["i"], shards).groupBy("shard").count().collect()}
    base, extra = divmod(300, shards)
    assert sizes == {s: base + (s < extra) for s in range(shards) if base + (s < extra)}
    order = [r.shard for r in o.balanced_shards(df, ["i"], shards).orderBy("i").collect()]
    assert order == sorted(order)


def test_no_task_gets_more_than_a_chunk(spark):
    """A key with a third of the rows, most of them tied in the order."""
    rows = [("hot" if n % 3 == 0 else f"k{n}", 0 if n % 9 else n, n) for n in range(3000)]
    df = spark.createDataFrame(rows, "k string, t long, i long")
    s = o.spread(df, ["k"], ["t"], reach=4, limit=100)
    sizes = [r["count"] for r in s.rows.groupBy("k", o.CHUNK).count().collect()]
    assert s.cut and max(sizes) <= 104
    assert s.own(s.rows).count() == 3000
    # the ranges the chunks were made from are balanced too
    assert o.find_hot(df, ["k"], 100).table.count() == 1 and o.find_hot(df, ["k"], 1000).table is None


@pytest.mark.parametrize("limit", [4, 7])
def test_ties_do_not_depend_on_cutting(spark, limit):
    """Equal times and no id: a key's result is the same before and after it becomes hot."""
    rows = [("k", n // 6, n * 7 % 12) for n in range(24)] + [("m", 0, n % 3) for n in range(9)]
    df = spark.createDataFrame(rows, "k string, t long, v long").repartition(3)
    mapped = df.withColumn("m", F.create_map(F.lit("a"), "v")).withColumn("n", F.array(F.create_map(F.lit("b"), "v")))
    for table in (df, mapped):
        def shown(at):
            out = o.over_last_rows(table, ["k"], ["t"], 3, {"f": F.first("v"), "s": F.sum("v")}, limit=at)
            before = o.previous(table, ["k"], ["t"], {"p": "v"}, limit=at)
            last = o.running_last(table, ["k"], ["t"], "v", "x", limit=at)
            return [sorted(map(str, frame.select([c for c in frame.columns if c not in "mn"]).collect()))
                    for frame in (out, before, last)]
        assert shown(limit) == shown(1_000_000)
