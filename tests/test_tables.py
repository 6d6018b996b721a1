"""Metrics, keys, duplicates, merges, grids, on hand-made tables."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from fluxframe import vocab
from fluxframe.functions import geo
from fluxframe.operators import dims, layout, merge, meters, metrics, spatial
from fluxframe.plans import evaluation
from fluxframe.queries import ORACLE, QUERIES
from fluxframe.sources.writers import latex_table
from tests.conftest import rows

NAN, INF = float("nan"), float("inf")


def scored(spark, data):
    return spark.createDataFrame(data, "site string, igbp string, gt_y double, pred_y double")


def test_rmse_and_nse(spark):
    df = scored(spark, [("a", "ENF", 1.0, 1.0), ("a", "ENF", 2.0, 2.0), ("a", "ENF", 3.0, 4.0), ("a", "ENF", 9.0, INF),
                        ("a", "ENF", None, 1.0), ("b", "WAT", 5.0, 4.0), ("c", None, 2.0, 2.0), ("c", None, 2.0, 1.0),
                        ("d", "MF", NAN, 1.0)])
    got = {r.site: r for r in metrics.evaluate_sites(df, ["y"], batch=2).collect()}
    assert (got["a"].rmse_y, got["a"].nse_y, got["a"].num_samples, got["a"].num_batches) == (0.5774, 0.5, 5, 3)
    assert (got["b"].rmse_y, got["b"].nse_y) == (1.0, None)
    assert (got["c"].rmse_y, got["c"].nse_y, got["c"].igbp) == (0.7071, None, "unknown")
    assert (got["d"].rmse_y, got["d"].nse_y) == (None, None)
    total = got["TOTAL"]
    assert (total.igbp, total.num_samples, total.num_batches) == (None, 9, 6)
    assert total.rmse_y == round((3 / 6) ** 0.5, 4)
    assert total.nse_y == round(1 - 3 / (1 + 4 + 9 + 25 + 4 + 4 - 15 ** 2 / 6), 4)


def test_sums_are_hashed(spark):
    df = scored(spark, [("a", "ENF", 1.0, 1.0)])
    plan = metrics.partial_sums(df, ["site", "igbp"], ["y"])._jdf.queryExecution().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_class_tables(spark):
    df = spark.createDataFrame(
        [("a", "ENF", 1.0, 0.5), ("b", "ENF", 2.0, NAN), ("c", "CRO", 4.0, 0.1), ("TOTAL", None, 9.0, 0.9)],
        "site string, igbp string, rmse_NEE double, nse_NEE double")
    assert rows(metrics.class_means(df, ["rmse_NEE", "nse_NEE"])) == [("CRO", 4.0, 0.1), ("ENF", 1.5, 0.5)]
    assert metrics.class_table(df, "rmse").columns == ["IGBP", "NEE"]
    assert [tuple(r) for r in metrics.overall_table(df).collect()] == [("NEE", 9.0, 0.9)]
    assert [tuple(r) for r in metrics.overall_table(df.select("rmse_NEE").where("rmse_NEE > 3").limit(1)).collect()][0][2] is None
    report = evaluation.report(df, metrics.earlier_scores(spark))
    assert "CRO & 3.2381 & 0.8066 & \\textbf{2.8677} & \\textbf{0.8482} & 4.0000 & 0.1000" in report["comparison"]
    assert report["comparison"].count("\\multicolumn{2}{c}") == 3
    assert "NEE & 9.0000 & 0.9000" in report["overall"]


def test_winners(spark):
    current = spark.createDataFrame([("CRO", 2.8677, None), ("NEW", 1.0, 0.5)], "igbp string, rmse_c double, nse_c double")
    earlier = metrics.earlier_scores(spark).where("igbp in ('CRO', 'WAT')")
    got = {r.igbp: r for r in metrics.mark_winners(metrics.compare_models(current, earlier)).collect()}
    assert got["CRO"].rmse_c == got["CRO"].rmse_b == "\\textbf{2.8677}" and got["CRO"].rmse_a == "3.2381"
    assert got["CRO"].nse_c == "--" and got["CRO"].nse_b == "\\textbf{0.8482}"
    assert got["NEW"].rmse_a == "--" and got["NEW"].nse_c == "\\textbf{0.5000}"
    assert got["WAT"].nse_a == "\\textbf{-11.0524}"


def test_losses(spark):
    df = spark.createDataFrame([(1, 1.0, 3.0, None), (2, 2.0, 2.0, None), (3, 5.0, None, None)],
                               "id long, pred_a double, gt_a double, gt_b double").withColumn("pred_b", F.lit(1.0))
    assert metrics.masked_mse(df, ["a", "b"]).first().asDict() == {"mse_a": 2.0, "mse_b": 0.0, "loss": 2.0}
    batches = evaluation.batch_losses(df.withColumn("site", F.lit("s")), ["a"], 2)
    assert tuple(batches.first()) == ("s", 2, 3, 4.0)


@pytest.mark.parametrize("limit", [None, 5])
def test_meters(spark, limit):
    df = spark.createDataFrame([("m", n, float(n)) for n in (1, 2, 3, 4)] + [("o", n, 1.0) for n in range(9)],
                               "name string, step long, value double")
    got = meters.smoothed(df, "name", "step", "value", 4, limit=limit)
    last = got.where("name = 'm' and step = 4").first()
    assert (last.median, last.avg, round(last["std"], 4), last["max"], last.value, last.global_avg) == (2.0, 2.5, 1.291, 4.0, 4.0, 2.5)
    first = got.where("name = 'm' and step = 1").first()
    assert (first.median, first["std"]) == (1.0, None)
    assert got.count() == 13


def test_surrogate_keys(spark):
    df = spark.createDataFrame([(5, 1.0, None), (2, 2.0, "x"), (3, 1.0, None), (4, 1.0, "x")], "pos long, lat double, igbp string")
    dim = dims.surrogate_keys(df, ["lat", "igbp"], "pos")
    assert rows(dim) == [(1, 2.0, "x"), (2, 1.0, None), (3, 1.0, "x")]
    assert {r.pos: r.coord_id for r in dims.attach_keys(df, dim, ["lat", "igbp"]).collect()} == {5: 2, 2: 1, 3: 2, 4: 3}


def test_relabel(spark):
    raster = spark.createDataFrame([(r, c, 4 * r + c) for r in range(4) for c in range(4)], "row int, col int, code int")
    dim = spark.createDataFrame([(1, 9.0, 1.0, "WAT"), (2, 9.0, 1.0, None), (3, None, 1.0, "ENF"), (4, -50.0, 99.0, "ENF")],
                                "coord_id long, lat double, lon double, igbp string")
    plan = dims.relabel(dim, raster, 0.0, 10.0, 5.0, 4, 4)
    got = {r.coord_id: (r.new_label, r.changed) for r in plan.collect()}
    assert got == {1: ("WAT", False), 2: ("WAT", True), 3: ("ENF", False), 4: ("SNO", True)}
    assert rows(dims.top_transitions(plan.where("sampled"), "igbp", "new_label")) == [("ENF", "SNO", 1), ("NULL", "WAT", 1)]
    assert rows(dims.label_counts(plan)) == [("new", "ENF", 1), ("new", "SNO", 1), ("new", "WAT", 2),
                                             ("old", "ENF", 2), ("old", "NULL", 1), ("old", "WAT", 1)]
    applied = dims.apply_labels(dims.relabel(dim, raster, 0.0, 10.0, 5.0, 4, 4, only_missing=True))
    assert {r.coord_id: r.igbp for r in applied.collect()} == {1: "WAT", 2: "WAT", 3: "ENF", 4: "ENF"}
    assert applied.columns == dim.columns


def test_transitions_are_cut_before_identities_go(spark):
    data = [("a", "a")] * 5 + [("a", "b")] * 3 + [(None, "b")] * 2
    df = spark.createDataFrame(data, "old string, new string")
    assert rows(dims.top_transitions(df, "old", "new", 2)) == [("a", "b", 3)]


def test_upsert(spark):
    old = spark.createDataFrame([(1, 1, "o"), (1, 2, "o")], "coord_id long, modis_date int, data string")
    new = spark.createDataFrame([(1, 2, "n"), (2, 2, "n")], "coord_id long, modis_date int, data string")
    keys = ["coord_id", "modis_date"]
    assert rows(dims.upsert(old, new, keys, False)) == [(1, 1, "o"), (1, 2, "o"), (2, 2, "n")]
    assert rows(dims.upsert(old, new, keys, True)) == [(1, 1, "o"), (1, 2, "n"), (2, 2, "n")]
    assert rows(dims.write_counts(new, new, old, False)) == [(2, 2, 1)]
    assert rows(dims.update_by_key(old, new.groupBy("modis_date").agg(F.max("data").alias("data")), "modis_date", "data")) == [
        (1, 1, "o"), (1, 2, "n")]


def test_cells_to_images(spark):
    dim = spark.createDataFrame([(1, 89.75, -180.0), (2, 89.75, -180.0), (3, 90.0, 0.0), (4, 0.0, 180.0)],
                                "coord_id long, lat double, lon double")
    cells = spark.createDataFrame([(0, 0, 20170101, "a"), (0, 720, 20170101, "b"), (359, 0, 20170101, "c")],
                                  "grid_row int, grid_col int, modis_date int, data string")
    # two locations share a cell, the pole and the date line belong to none
    assert rows(dims.cells_to_images(cells, dim)) == [(2, 20170101, "a")]


def test_key_checks(spark):
    good = spark.createDataFrame([(1,), (2,)], "k long")
    assert dims.require_key(good, "k") is good
    for bad in ([(1,), (1,)], [(1,), (None,)]):
        with pytest.raises(ValueError):
            dims.require_key(spark.createDataFrame(bad, "k long"), "k")


SHARD = "__sample_order long, lat double, lon double, igbp string, timestamp long, pred_NEE double, pred_LE double"


@pytest.fixture(scope="module")
def shards(spark):
    a = [(0, 1.0, 1.0, "ENF", 20170101, 1.0, 5.0), (3, 1.0, 2.0, None, 20170101, 2.0, 6.0)]
    b = [(1, 1.0, 1.0, None, 20170101, 3.0, 7.0), (2, 2.0, 1.0, "MF", 20170102, 4.0, 8.0)]
    return [spark.createDataFrame(x, SHARD) for x in (a, b)]


def test_merge(spark, shards):
    merged = merge.merge_shards(shards, ["NEE"])
    assert merged.columns == ["lat", "lon", "igbp", "timestamp", "pred_NEE"]
    assert [r.pred_NEE for r in merged.collect()] == [1.0, 3.0, 4.0, 2.0]
    assert merge.merge_shards(shards).columns == SHARD.replace(" long", "").replace(" double", "").replace(" string", "").split(", ")[1:]
    for policy, value, label in (("first", 1.0, "ENF"), ("last", 3.0, None), ("mean", 2.0, "ENF")):
        got = merge.merge_shards(shards, policy=policy, sort=False).where("lat = 1 and lon = 1").collect()
        assert [(r.pred_NEE, r.igbp) for r in got] == [(value, label)]
    with pytest.raises(ValueError, match="duplicate rows"):
        merge.merge_shards(shards, policy="error")
    with pytest.raises(ValueError, match="unknown targets"):
        merge.merge_shards(shards, ["XX"])
    union = merge.union_shards(shards)
    assert tuple(merge.duplicate_report(union, merge.COORDINATES).first()) == (2, 1)
    assert merge.duplicate_rows(union, merge.COORDINATES).count() == 2
    with pytest.raises(ValueError, match="columns"):
        merge.union_shards([shards[0], shards[1].drop("pred_LE")])
    loose = merge.union_shards([shards[0], shards[1].drop("pred_LE")], strict=False)
    assert loose.columns == shards[0].columns and loose.where("pred_LE is null").count() == 2
    with pytest.raises(ValueError, match="missing values"):
        merge.require_coordinates(spark.createDataFrame([(None, 1.0, 1.0)], "timestamp long, lat double, lon double"))


def test_order_without_sample_order(spark):
    df = spark.createDataFrame([("10", "1", "5"), ("9", "1", "6"), ("9", "x", "1")], "lat string, lon string, timestamp string")
    assert [r.timestamp for r in merge.in_output_order(df).collect()] == ["1", "6", "5"]


def test_static(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, igbp string")
    assert tuple(merge.is_static(df, ["k"], "igbp").first()) == (True, 2)
    more = df.union(spark.createDataFrame([(1, None)], "k int, igbp string"))
    assert tuple(merge.is_static(more, ["k"], "igbp").first()) == (False, 2)


def test_cube(spark):
    long = spark.createDataFrame([(20170101, 10.0, 5.0, 1.5, None), (20170101, 10.0, 7.0, 2.5, 1.0), (20170102, 20.0, 6.0, 3.5, 2.0)],
                                 "timestamp long, lat double, lon double, a double, b double")
    axes = merge.cube_axes(long)
    cube = merge.dense_cube(long, ["a", "b"], axes)
    got = {(r.time_index, r.lat_index): (repr(r.a), repr(r.b)) for r in cube.collect()}
    hole = "[nan, nan, nan]"
    assert got == {(0, 1): ("[1.5, nan, 2.5]", "[nan, nan, 1.0]"), (1, 0): ("[nan, 3.5, nan]", "[nan, 2.0, nan]"),
                   (0, 0): (hole, hole), (1, 1): (hole, hole)}
    named = merge.dense_cube(long.withColumn("igbp", F.lit("ENF")), ["a"], axes, labels=["igbp"])
    assert {(r.time_index, r.lat_index): r.igbp for r in named.collect()} == {
        (0, 1): ["ENF", None, "ENF"], (1, 0): [None, "ENF", None], (0, 0): [None] * 3, (1, 1): [None] * 3}
    back = merge.long_from_cube(cube, ["a", "b"], axes["lon"]).select("timestamp", "lat", "lon", "a")
    assert rows(back) == rows(long.select("timestamp", "lat", "lon", "a"))


@pytest.mark.parametrize("width", [1, 2, 3, 128])
def test_cube_tiles(spark, width):
    """Tiles are the lines of the dense cube, cut; tiles of holes alone are not stored."""
    long = spark.createDataFrame(
        [(t, float(t * 7 % 5), float((t * t * 3 + k * k) % 23), float(t + k) if k % 3 else None, float(k), f"c{k}")
         for t in range(6) for k in range(4)], "timestamp long, lat double, lon double, a double, b double, igbp string")
    long = long.dropDuplicates(["timestamp", "lat", "lon"]).cache()
    axes = merge.cube_axes(long)
    tiles = {(r.time_index, r.timestamp, r.lat_index, r.lat, r.lon_start): (repr(r.a), repr(r.b), r.igbp)
             for r in merge.cube_tiles(long, ["a", "b"], axes, ["igbp"], width).collect()}
    cut = {(r.time_index, r.timestamp, r.lat_index, r.lat, k): (repr(r.a[k:k + width]), repr(r.b[k:k + width]), r.igbp[k:k + width])
           for r in merge.dense_cube(long, ["a", "b"], axes, ["igbp"]).collect() for k in range(0, len(r.a), width)
           if any(x is not None for x in r.igbp[k:k + width])}
    assert tiles == cut
    back = merge.long_from_cube(merge.cube_tiles(long, ["a", "b"], axes, width=width), ["a", "b"], axes["lon"])
    back = back.select("timestamp", "lat", "lon", F.when(~F.isnan("a"), F.col("a")).alias("a"), "b")
    assert rows(back) == rows(long.select("timestamp", "lat", "lon", "a", "b"))


def test_decimal_axes_take_a_bounded_number_of_cells(spark, sf, monkeypatch):
    """Every part is a longitude; lines of all longitudes would take the product of the axes."""
    cubes, back = [], merge.long_from_cube
    monkeypatch.setattr(merge, "long_from_cube", lambda cube, *rest: cubes.append(cube) or back(cube, *rest))
    found = QUERIES["cube_decimal_axes"](spark, sf).count()
    cells = cubes[0].agg(F.sum(F.size("size"))).first()[0]
    assert found <= cells <= 128 * found


def test_decimal_axes_keep_every_part(spark, tmp_path):
    """Prices on both sides of 960, and parts without a key, a price or a size."""
    parts = [(n, 1 + n % 7, 900.0 + n * 0.37) for n in range(400)] + [(None, 3, 901.5), (500, None, 970.0), (501, 4, None), (None, None, None)]
    spark.createDataFrame(parts, "p_partkey long, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    found = QUERIES["cube_decimal_axes"](spark, str(tmp_path)).select("timestamp", "lat", "lon", "size")
    expected = duck.execute(ORACLE["cube_decimal_axes"]).fetchall()
    assert rows(found) == sorted(expected, key=lambda r: tuple((v is None, str(v)) for v in r))
    assert len(expected) == len(parts)


def test_rebuild_ids(spark):
    df = spark.createDataFrame([(7, 2, 5), (9, 1, 6), (3, 1, 6), (4, 2, 4)], "id long, coord_id long, timestamp long")
    assert rows(layout.rebuild_ids(df)) == [(1, 1, 6), (2, 1, 6), (3, 2, 4), (4, 2, 5)]
    assert layout.rebuild_ids(df).columns == ["id", "coord_id", "timestamp"]
    fresh = layout.rebuild_ids(df.select("timestamp", "coord_id"))
    assert fresh.columns == ["id", "timestamp", "coord_id"]
    assert rows(fresh) == [(1, 6, 1), (2, 6, 1), (3, 4, 2), (4, 5, 2)]
    assert tuple(layout.row_estimate(df).first()) == (4, 9)


def test_stencil_against_brute_force(spark):
    rng = random.Random(4)
    land = {(i, j): rng.random() < 0.2 for i in range(12) for j in range(15)}
    df = spark.createDataFrame([(i, j, v) for (i, j), v in land.items()], "i long, j long, land boolean")
    for r in spatial.neighbour_count(df, "land").collect():
        assert r.neighbours == sum(land.get((r.i + a, r.j + b), False) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0))


def test_land_or_coast(spark):
    def kept(values):
        df = spark.createDataFrame([(10.0 * i, 2.0 * j, values.get((i, j), 0.0)) for i in range(4) for j in range(4)],
                                   "lat double, lon double, lsm double")
        return {(int(r.lat / 10), int(r.lon / 2)) for r in spatial.land_or_coast(df).collect()}
    assert kept({(1, 1): 0.9}) == {(i, j) for i in range(3) for j in range(3)}
    assert kept({(0, 0): 0.9}) == {(0, 0), (0, 1), (1, 0), (1, 1)}  # no wrap
    assert kept({(1, 1): NAN}) == kept({(1, 1): 0.5}) == kept({(1, 1): None}) == set()


def test_bilinear(spark):
    grid = spark.createDataFrame([(x, y, float(x + 10 * y)) for x in range(4) for y in range(3) if (x, y) != (3, 2)],
                                 "gx long, gy long, v double")
    points = spark.createDataFrame([(1, 100.5, 50.25), (2, 103.0, 51.0), (3, 103.5, 50.0), (4, 102.5, 51.5), (5, 100.0, 50.0), (6, 100.0, 52.0)],
                                   "id long, x double, y double")
    got = {r.id: r.o for r in spatial.bilinear(points, grid, "x", "y", "v", (100.0, 50.0), (1.0, 1.0), (4, 3), ["id"], "o").collect()}
    assert got == {1: pytest.approx(3.0), 2: None, 3: None, 4: None, 5: 0.0, 6: 20.0}


def test_raster_lookup_is_nearest(spark):
    rng = random.Random(8)
    raster = [(r, c, 10 * r + c) for r in range(6) for c in range(8)]
    points = [(n, rng.uniform(-40, 40), rng.uniform(-50, 50)) for n in range(100)]
    got = spatial.sample_raster(spark.createDataFrame(points, "n long, lat double, lon double"),
                                spark.createDataFrame(raster, "row int, col int, code int"),
                                "lat", "lon", -40.0, 30.0, 10.0, 6, 8, nearest_centre=True)
    for r in got.collect():
        best = min(raster, key=lambda p: (30 - 10 * p[0] - 5 - r.lat) ** 2 + (-40 + 10 * p[1] + 5 - r.lon) ** 2)
        assert r.code == best[2]


@pytest.mark.parametrize("limit", [None, 4])
def test_dateline(spark, limit):
    lons = [170, 179, -179, -170, 175, -175, -174]
    df = spark.createDataFrame([("r", n, float(v), 0.0) for n, v in enumerate(lons)] + [("s", 0, 1.0, 0.0), ("s", 1, 2.0, 0.0)],
                               "ring string, position long, lon double, lat double")
    got = spatial.split_at_dateline(df, ["ring"], ["position"], limit=limit)
    assert rows(got.select("ring", "position", "segment")) == [
        ("r", 0, 0), ("r", 1, 0), ("r", 2, 1), ("r", 3, 1), ("r", 5, 3), ("r", 6, 3), ("s", 0, 0), ("s", 1, 0)]


def test_maps(spark):
    df = spark.createDataFrame([(0.0, 0.0, "ENF"), (0.0, 0.0, "ENF"), (0.0, 0.0, None), (None, 0.0, "ENF")], "lat double, lon double, igbp string")
    frame = geo.MapFrame.fit("plate", 0.0, 0.0, 360.0, 180.0)
    assert rows(spatial.pixel_bins(df, frame)) == [(180, 90, "ENF", 2), (180, 90, "NULL", 1)]
    assert [tuple(r) for r in spatial.legend(df).collect()] == [
        ("NULL", 1, "#8F9693", "Changed region"), ("ENF", 3, "#006837", "Evergreen needleleaf forest")]
    tiles = spatial.tile_grid(spark, 30)
    assert tiles.count() == 72 and tuple(tiles.first()) == (-180, -90, -150, -60)
    mosaic = spatial.mosaic(spark.createDataFrame([(0, 0, 2, 5), (0, 0, 1, 6), (0, 1, 2, 7)], "row int, col int, tile int, v int"))
    assert rows(mosaic) == [(0, 0, 6), (0, 1, 7)]


def test_latex(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", NAN)], "name string, x double")
    table = latex_table(df, "Cap", "tab:x", 2)
    assert "a & 1.00 \\\\\nb & -- \\\\\nc & -- \\\\" in table and "\\caption{Cap}" in table


def test_constant_tables_are_complete():
    assert len(vocab.LEGEND) == 18 and len(vocab.FALLBACK_COLOURS) == 8
