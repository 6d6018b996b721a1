"""Raw grid to facts and dimension, on a small world."""

import pytest

from fluxframe import schema
from fluxframe.operators import metrics, samples, spatial
from fluxframe.plans import enrichment, image_store, ingest
from fluxframe.sources import rasters, writers
from tests.conftest import rows


def world(spark):
    raw = [(float(la), float(lo), 100.0 + la, h, 0.0 if h else 80.1, 50.0, 180.0)
           for la in range(4) for lo in range(-2, 2) for h in (0, 5)]
    raw = spark.createDataFrame(raw, "lat double, lon double, elev double, hour int, TA double, SWC_1 double, WD double")
    raw = raw.selectExpr("lat", "lon", "elev", "timestamp_ntz '2017-02-01 00:00:00' + make_interval(0,0,0,0,hour,0,0) as timestamp",
                         "TA", "SWC_1", "WD")
    # one land cell at (1, -1); the mask counts longitudes 0..359
    mask = spark.createDataFrame([(x, y, 1.0 if (x, y) == (359, 1) else 0.0) for x in range(360) for y in range(4)],
                                 "gx long, gy long, lsm double")
    cover = spark.createDataFrame([(r, c, 13 if c == 0 else r) for r in range(4) for c in range(4)], "row int, col int, code int")
    frame = ingest.RasterFrame(west=-2.5, north=3.5, step=1.0, rows=4, cols=4)
    return raw, mask, cover, frame


def test_build_dataset(spark):
    raw, mask, cover, frame = world(spark)
    facts, dim = ingest.build_dataset(raw, mask, cover, frame, (0.0, 0.0), (1.0, 1.0), (360, 4))
    places = {r.coord_id: r for r in dim.collect()}
    assert sorted((r.lat, r.lon) for r in places.values()) == [(float(a), float(b)) for a in range(3) for b in (-2, -1, 0)]
    assert sorted(places) == list(range(1, 10))
    assert {r.igbp for r in places.values() if r.lon == -2.0} == {None}
    assert {(r.lat, r.igbp) for r in places.values() if r.lon != -2.0} == {(2.0, "ENF"), (1.0, "EBF"), (0.0, "DNF")}
    assert facts.columns == ["id", "coord_id", "timestamp", "DOY", "TOD", "TA", "WD", "SWC_1"]
    assert sorted(r.id for r in facts.collect()) == list(range(1, 19))
    built = samples.grid_samples(facts, dim, 2, ["TA", "DOY"])
    assert built.count() == 9 and {len(r.frame) for r in built.collect()} == {2}
    got = rows(facts.where("coord_id = 1").drop("id"))
    assert got == [(1, 20170201000000, (32 - 183) / 183, (1 - 12) / 12, None, 0.0, None),
                   (1, 20170201050000, (32 - 183) / 183, (6 - 12) / 12, 0.0, 0.0, None)]
    assert facts.count() == 18
    loose, _ = ingest.build_dataset(raw, mask, cover, frame, (0.0, 0.0), (1.0, 1.0), (360, 4), strict_bounds=False)
    assert {r.SWC_1 for r in loose.collect()} == {0.0}


def test_image_cells(spark):
    dim = spark.createDataFrame([(1, 89.75, -180.0), (2, 89.5, -180.0)], "coord_id long, lat double, lon double")
    cells = spark.createDataFrame([(0, 0, 20170101, [1.0]), (1, 0, 20170101, [2.0])],
                                  "grid_row int, grid_col int, modis_date int, data array<float>")
    facts = spark.createDataFrame([(2,), (2,)], "coord_id long")
    assert rows(ingest.image_cells(cells, dim).select("coord_id")) == [(1,), (2,)]
    assert rows(ingest.image_cells(cells, dim, facts).select("coord_id")) == [(2,)]


def test_enrich(spark, tmp_path):
    dim = spark.createDataFrame([(1, 89.75, -180.0, "WAT"), (2, 89.5, -180.0, None)], "coord_id long, lat double, lon double, igbp string")
    facts = spark.createDataFrame([(1, 2, 5), (2, 2, 4)], "id long, coord_id long, timestamp long")
    cover = spark.createDataFrame([(0, 0, 4)], "row int, col int, code int")
    cells = spark.createDataFrame([(0, 0, 20170101, [1.0]), (1, 0, 20170101, [2.0])],
                                  "grid_row int, grid_col int, modis_date int, data array<float>")
    frame, folder = ingest.RasterFrame(-180.0, 90.0, 360.0, 1, 1), str(tmp_path)
    args = (facts, dim, cover, frame, cells, folder)
    assert enrichment.enrich(*args, steps=["images", "relabel"], dry_run=True) == ["relabel", "images"]
    assert not list(tmp_path.iterdir())
    with pytest.raises(ValueError):
        enrichment.enrich(*args, steps=["download"])
    assert enrichment.enrich(*args, active_only=True) == ["relabel", "cluster", "images"]
    assert rows(spark.read.parquet(folder + "/coord_data.parquet").select("coord_id", "igbp")) == [(1, "DBF"), (2, "DBF")]
    assert spark.read.parquet(folder + "/ec_data.parquet").count() == 2
    stored = image_store.existing_images(spark, folder + "/modis_data.parquet")
    assert rows(stored.select("coord_id", "modis_date")) == [(2, 20170101)]
    _, moved = enrichment.relabel_dimension(dim, cover, frame)
    assert rows(moved) == [("NULL", "DBF", 1), ("WAT", "DBF", 1)]


def test_enrich_in_place(spark, tmp_path):
    folder, frame = str(tmp_path), ingest.RasterFrame(-180.0, 90.0, 360.0, 1, 1)
    spark.createDataFrame([(1, 89.75, -180.0, "WAT")], "coord_id long, lat double, lon double, igbp string") \
        .write.parquet(folder + "/coord_data.parquet")
    spark.createDataFrame([(n, 1, n) for n in range(50)], "id long, coord_id long, timestamp long") \
        .repartition(4).write.parquet(folder + "/ec_data.parquet")
    cover = spark.createDataFrame([(0, 0, 4)], "row int, col int, code int")
    cells = spark.createDataFrame([(0, 0, 20170101 + n, [1.0]) for n in range(20)],
                                  "grid_row int, grid_col int, modis_date int, data array<float>").repartition(4)
    for overwrite in (False, True):
        enrichment.enrich(spark.read.parquet(folder + "/ec_data.parquet"), spark.read.parquet(folder + "/coord_data.parquet"),
                          cover, frame, cells, folder, overwrite=overwrite)
        assert rows(spark.read.parquet(folder + "/coord_data.parquet").select("igbp")) == [("DBF",)]
        assert spark.read.parquet(folder + "/ec_data.parquet").count() == 50
        assert image_store.existing_images(spark, folder + "/modis_data.parquet").count() == 20
    assert sorted(p.name for p in tmp_path.iterdir()) == ["coord_data.parquet", "ec_data.parquet", "modis_data.parquet"]
    assert len(list(tmp_path.glob("modis_data.parquet/modis_date=*/*.parquet"))) == 20


def test_tables_and_cubes(spark, tmp_path):
    names = schema.create_tables(spark, ["TA"], "fresh_")
    try:
        assert names == ["fresh_ec_data", "fresh_coord_data", "fresh_modis_data"]
        assert spark.table("fresh_ec_data").columns == ["id", "coord_id", "timestamp", "TA"]
    finally:
        for n in names:
            spark.sql(f"drop table {n}")
    df = spark.createDataFrame([(1, None, 2.0), (2, None, None)], "k int, a double, b double")
    assert schema.drop_empty(df, ["a", "b"]).columns == ["k", "b"]
    cube = spark.createDataFrame([(0, 0, [1.0]), (1, 0, [2.0])], "time_index int, lat_index int, v array<double>")
    writers.write_cube(cube, {"num_shards": 3}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "cells")).count() == 2
    assert rows(spark.read.json(str(tmp_path / "attributes"))) == [("num_shards", "3")]


def test_matrix(spark):
    df = spark.createDataFrame([(1, 10, 1.0), (1, 20, 2.0), (2, 20, 3.0), (2, 20, 3.0)], "lat int, lon int, v double")
    matrix = spatial.to_matrix(df, "lat", "lon", "v", [10, 20])
    assert rows(matrix) == [(1, 1.0, 2.0), (2, None, 3.0)]
    assert rows(spatial.from_matrix(matrix, "lat", "lon", "v")) == [(1, "10", 1.0), (1, "20", 2.0), (2, "20", 3.0)]
    with pytest.raises(Exception, match="several values"):
        spatial.to_matrix(df.union(spark.createDataFrame([(1, 10, 9.0)], df.schema)), "lat", "lon", "v", [10, 20]).collect()


def test_site_classes(spark):
    df = spark.createDataFrame([("a", "X"), ("a", "X"), ("b", "Y"), ("b", "X")], "site string, igbp string")
    assert rows(metrics.site_classes(df)) == [("a", "X", 1), ("b", "X", 2)]
    none = spark.createDataFrame([("a", None), ("b", None), ("b", "Y")], df.schema)
    assert rows(metrics.site_classes(none)) == [("a", "unknown", 1), ("b", "Y", 1)]


def test_raster_shape(spark):
    strips = spark.createDataFrame([("p", 8, 16, [[1.0]]), ("p", 8, 16, [[1.0]])],
                                   "path string, height int, width int, bands array<array<double>>")
    assert rasters.require_raster(strips, [1], 16, 16) is strips
    with pytest.raises(ValueError, match="unexpected raster"):
        rasters.require_raster(strips, [7], 16, 16)


@pytest.mark.parametrize(("crs", "codes", "message"), [
    ("EPSG:3857", [1.0, 2.0], "unexpected raster"), (None, [1.0, 2.0], "unexpected raster"),
    ("EPSG:4326", [1.0, 99.0], "without a class"), ("EPSG:4326", [1.0, 2.0], None)])
def test_land_cover_checks(spark, crs, codes, message):
    strips = spark.createDataFrame(
        [("p", 0, r, 1, 2, -180.0, 90.0, 0.5, [codes], crs) for r in (0, 1)], rasters.StripSource({}).schema())
    if message:
        with pytest.raises(ValueError, match=message):
            rasters.land_cover(strips, 2, 2)
    else:
        assert rows(rasters.land_cover(strips, 2, 2).select("row", "col", "code")) == [
            (0, 0, 1), (0, 1, 2), (1, 0, 1), (1, 1, 2)]
