"""Sample indexes, windows, images: hand-made cases and brute force."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fluxframe.operators import asof, samples
from tests.conftest import rows


@pytest.fixture(scope="module")
def grid(spark):
    """Two interleaved locations of six rows, one of two, one equal timestamp."""
    facts = []
    for n in range(6):
        facts += [(10 * n, 1, 20170601000000 + n, float(n)), (10 * n + 1, 2, 20170601000000 + n // 2, float(-n))]
    facts += [(100, 3, 20170601000000, 0.0), (101, 3, 20170601000001, 0.0), (102, 9, 20170601000001, 0.0)]
    return spark.createDataFrame(facts, "id long, coord_id long, timestamp long, TA double")


def test_index_counts_rows_before_start(grid):
    got = rows(samples.grid_sample_index(grid, 3, start=20170601000003).select("id"))
    assert got == [(30,), (40,), (50,)]
    got = rows(samples.grid_sample_index(grid, 3, start=20170601000001, end=20170601000003)
               .where("coord_id = 1").select("id"))
    assert got == [(20,), (30,)]


def test_equal_times_follow_the_id(grid):
    framed = samples.trailing_frames(grid.where("coord_id = 2"), "coord_id", ["timestamp", "id"], 3, ["TA"])
    frames = {r.id: [x.id for x in r.frame] for r in framed.collect()}
    assert frames == {21: [1, 11, 21], 31: [11, 21, 31], 41: [21, 31, 41], 51: [31, 41, 51]}


@pytest.mark.parametrize("limit", [None, 2, 4])
def test_frames_do_not_depend_on_cutting(grid, limit):
    framed = samples.trailing_frames(grid, "coord_id", ["timestamp", "id"], 3, ["TA"], limit=limit)
    assert sorted(r.id for r in framed.collect()) == [20, 21, 30, 31, 40, 41, 50, 51]


def test_exclusion_keeps_unknown_classes(spark, grid):
    dim = spark.createDataFrame([(1, "WAT"), (2, None), (3, "ENF")], "coord_id long, igbp string")
    kept = samples.without_classes(grid, dim, [" wat "])
    assert sorted({r.coord_id for r in kept.collect()}) == [2, 3, 9]
    assert samples.without_classes(grid, dim, []).count() == grid.count()


def test_strict_lookup(spark, grid):
    dim = spark.createDataFrame([(1, "WAT"), (2, None), (3, "ENF")], "coord_id long, igbp string")
    with pytest.raises(PySparkException, match="no dimension row for coord_id 9"):
        samples.dim_lookup(grid, dim, "coord_id").collect()
    assert samples.dim_lookup(grid, dim, "coord_id", strict=False).count() == grid.count()


def test_site_index_drops_the_first_with_targets(spark):
    facts = spark.createDataFrame(
        [(n, "a" if n < 8 else "b", None if n in (1, 2) else 1.0) for n in range(11)], "id long, site string, NEE double")
    index = samples.site_sample_index(facts, ["NEE"], 3)
    assert rows(index.select("id")) == [(10,), (4,), (5,), (6,), (7,)]


@pytest.mark.parametrize("block", [3, 50, 10 ** 6])
def test_id_range(spark, block):
    rng = random.Random(3)
    ids = sorted(rng.sample(range(200), 80))
    data = [(i, rng.choice("aab"), i % 7) for i in ids]
    df = spark.createDataFrame(data, "id long, site string, v long")
    got = samples.over_id_range(df, "site", "id", 20, {"s": F.collect_list("id")}, block=block)
    expected = {i: [j for j, t, _ in data if t == s and i - 19 <= j <= i] for i, s, _ in data}
    assert {r.id: r.s for r in got.collect()} == expected
    assert got.count() == 80


def test_first_image(spark):
    facts = spark.createDataFrame([(i, "a") for i in (1, 2, 3, 7, 8)], "id long, site string")
    images = spark.createDataFrame([(2, "x"), (3, "y"), (9, "z")], "row_id long, data string")
    got = samples.first_image_in_window(facts, images, "site", "id", "row_id", "data", 3)
    assert {r.id: r.image for r in got.collect()} == {1: None, 2: "x", 3: "x", 7: None, 8: None}
    twice = images.union(spark.createDataFrame([(2, "w"), (3, "z")], images.schema))
    got = samples.first_image_in_window(facts, twice, "site", "id", "row_id", "data", 3).collect()
    assert len(got) == 5 and {r.id: r.image for r in got} == {1: None, 2: "w", 3: "w", 7: None, 8: None}


@pytest.mark.parametrize("limit", [None, 5])
def test_asof_against_brute_force(spark, limit):
    rng = random.Random(5)
    left = [(n, rng.choice(["h", "h", "h", "c", None]), rng.randrange(40)) for n in range(120)]
    right = sorted({(rng.choice(["h", "h", "d"]), rng.randrange(-5, 40)) for _ in range(40)})
    a = spark.createDataFrame(left, "id long, k string, t long")
    b = spark.createDataFrame([(k, t, n) for n, (k, t) in enumerate(right)], "k string, d long, img long")
    got = asof.asof_backward(a, b, ["k"], "t", "d", {"img": "img", "found": "d"}, limit=limit)
    assert got.columns == ["id", "k", "t", "img", "found"]
    for r in got.collect():
        earlier = [(d, n) for n, (k, d) in enumerate(right) if k == r.k and d <= r.t]
        assert (r.found, r.img) == (max(earlier) if earlier else (None, None))
    assert got.count() == 120


def test_latest_image_cases(spark):
    rows_ = spark.createDataFrame([(1, 1, 20170602120000), (2, 1, 20170601000000), (3, 1, 20170531000000), (4, 2, 20170603000000)],
                                  "id long, coord_id long, timestamp long")
    images = spark.createDataFrame([(1, 20170601, [1.0]), (1, 20170602, [2.0]), (2, 20170604, [3.0])],
                                   "coord_id long, modis_date int, data array<float>")
    got = {r.id: (r.image_date, r.data) for r in asof.latest_image(rows_, images).collect()}
    assert got == {1: (20170602, [2.0]), 2: (20170601, [1.0]), 3: (None, None), 4: (None, None)}
    late = {r.id: r.image_date for r in asof.latest_image(rows_, images, since=20170602000000).collect()}
    assert late == {1: 20170602, 2: None, 3: None, 4: None}


@pytest.mark.parametrize("limit", [None, 3])
def test_distinct_images_cutting(spark, limit):
    rng = random.Random(9)
    facts = [(n, rng.choice(["h", "h", "c"]), n // 3) for n in range(60)]
    images = [("h", 2), ("h", 5), ("h", 11), ("c", 4)]
    got = asof.distinct_images(
        spark.createDataFrame(facts, "id long, k string, day long"),
        spark.createDataFrame(images, "k string, img long"), "k", "day", "img", ["day", "id"], 6, limit=limit)
    for r in got.collect():
        trail = [f for f in facts if f[1] == r.k and f[0] <= r.id][-6:]
        found = {max((d for k, d in images if k == f[1] and d <= f[2]), default=None) for f in trail}
        assert r.image_dates == sorted(found - {None})


def test_site_samples(spark):
    facts = spark.createDataFrame(
        [(1, "a", 10, 0.5, 1.0, None), (2, "a", 11, None, None, None), (3, "a", 12, 0.7, 250.0, None), (4, "a", 13, 0.1, -100.0, 2.0)],
        "id long, site string, timestamp long, TA double, NEE double, LE double")
    dim = spark.createDataFrame([("a", 45.0, None, 800.0, "ENF")], "site string, lat double, lon double, elev double, igbp string")
    images = spark.createDataFrame([(2, [1.0]), (3, [2.0])], "row_id long, data array<float>")
    photos = spark.createDataFrame([(3, "a_IR_1.jpg,a_2.jpg"), (4, "b.jpg")], "row_id long, files string")
    built = samples.site_samples(facts, dim, 2, ["TA"], ["NEE", "LE"], images, photos)
    got = {r.id: r for r in built.collect()}
    # row 2 has no target; the first of the three rows with one is dropped
    assert sorted(got) == [3, 4]
    assert [(x.id, x.TA, x.NEE) for x in got[3].frame] == [(2, None, None), (3, 0.7, None)]
    assert [(x.id, x.NEE, x.LE) for x in got[4].frame] == [(3, None, None), (4, -100.0, 2.0)]
    assert got[3].images == [[1.0]] and got[4].images == [[2.0]]
    assert got[3].photos_ir == ["a_IR_1.jpg"] and got[3].photos_rgb == ["a_2.jpg"]
    assert got[4].photos_rgb == ["a_2.jpg"]
    assert (got[3].lat, got[3].lon, round(got[3].elev, 6)) == (0.25, None, 0.1)
    many = {r.id: r for r in samples.site_samples(facts, dim, 2, ["TA"], ["NEE", "LE"], images, photos, single_image=False).collect()}
    assert many[3].images == [[1.0], [2.0]] and many[4].photos_rgb == ["a_2.jpg", "b.jpg"]


@pytest.mark.parametrize("limit", [None, 2])
def test_grid_samples(spark, grid, limit):
    dim = spark.createDataFrame([(1, 90.0, 18.0, None, "ENF"), (2, 0.0, 0.0, 0.0, "WAT"), (3, 0.0, 0.0, 0.0, None), (9, 0.0, 0.0, 0.0, None)],
                                "coord_id long, lat double, lon double, elev double, igbp string")
    images = spark.createDataFrame([(1, 20170601, [7.0])], "coord_id long, modis_date int, data array<float>")
    got = samples.grid_samples(grid, dim, 3, ["TA"], images, start=20170601000004, exclude=["WAT"], limit=limit)
    assert [(r.id, r.data, [x.TA for x in r.frame], r.lat) for r in got.orderBy("id").collect()] == [
        (40, [7.0], [2.0, 3.0, 4.0], 0.5), (50, [7.0], [3.0, 4.0, 5.0], 0.5)]


def test_tensors_are_joined_last(spark, grid):
    """One shuffle of the facts by location; nothing is moved or sorted above the tensor join."""
    dim = spark.createDataFrame([(n, 0.0, 0.0, 0.0, None) for n in (1, 2, 3, 9)],
                                "coord_id long, lat double, lon double, elev double, igbp string")
    images = spark.createDataFrame([(1, 20170601, [7.0]), (2, 20170501, [8.0]), (2, 20170601, [9.0])],
                                   "coord_id long, modis_date int, data array<float>")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = samples.grid_samples(grid, dim, 3, ["TA"], images)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = plan.splitlines()
    top = next(n for n, line in enumerate(lines) if "SortMergeJoin" in line)
    assert not any("Exchange" in line or "Sort " in line for line in lines[:top])
    many = samples.grid_samples(grid.where("coord_id = 2"), dim, 3, ["TA"], images, single_image=False)
    assert {r.id: (r.image_dates, r.images) for r in many.collect()}[51] == ([20170601], [[9.0]])


def test_splits(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "site string")
    assert rows(samples.with_split(df, {"train": ["a"], "test": ["b"]}, "site")) == [("a", "train"), ("b", "test")]
    with pytest.raises(ValueError):
        samples.with_split(df, {"train": ["a"], "test": ["a"]}, "site")


def test_shuffles_and_reservoirs(spark):
    df = spark.range(50).withColumnRenamed("id", "row")
    first = {r.row: r.position for r in samples.epoch_order(df, "row", 1, 0).collect()}
    second = {r.row: r.position for r in samples.epoch_order(df, "row", 1, 1).collect()}
    assert sorted(first.values()) == list(range(50)) and first != second
    assert first == {r.row: r.position for r in samples.epoch_order(df, "row", 1, 0).collect()}
    assert samples.reservoir(df, "row", 7).count() == 7
    assert samples.reservoir(df, "row", 70).count() == 50
