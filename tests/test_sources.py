"""Files in, files out."""

import random
import sqlite3
import struct
import sys
import types

import pytest
from pyspark.sql import functions as F

from fluxframe import schema, session
from fluxframe.operators import layout, merge, spatial
from fluxframe.plans import image_store
from fluxframe.sources import netcdf, rasters, shards, sqlite, tables, writers
from fluxframe.streaming import ingest
from tests.conftest import rows


@pytest.fixture(scope="module")
def database(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "facts.sql")
    with sqlite3.connect(path) as c:
        c.execute("create table ec_data (id integer primary key, coord_id integer, timestamp integer, TA real, note text, data blob)")
        c.executemany("insert into ec_data values (?,?,?,?,?,?)", [
            (n * 3, n % 4, 20170101000000 + n, None if n == 5 else n / 2, f"n{n}", struct.pack("<3f", n, n + .5, -n)) for n in range(100)])
        c.execute("create table coord_data (coord_id integer, lat real)")
    return path


def test_sqlite(spark, database):
    df = sqlite.read_sqlite(spark, database, "ec_data", rows_per_partition=40)
    assert df.rdd.getNumPartitions() == 8
    assert dict(df.dtypes) == {"id": "bigint", "coord_id": "bigint", "timestamp": "bigint", "TA": "double", "note": "string", "data": "binary"}
    got = {r.id: r for r in df.withColumn("data", sqlite.decode_floats(F.col("data"))).collect()}
    assert len(got) == 100 and got[15].TA is None and got[30].note == "n10" and got[30].data == [10.0, 10.5, -10.0]
    assert sqlite.read_sqlite(spark, database, "coord_data").count() == 0
    assert sqlite.require_tables(database) == {"modis_data": False}
    with pytest.raises(ValueError, match="nothing"):
        sqlite.require_tables(database, needed=("nothing",))
    with pytest.raises(Exception, match="no table"):
        sqlite.read_sqlite(spark, database, "nothing").count()


def shard_folder(tmp_path, texts):
    for n, text in enumerate(texts):
        (tmp_path / f"rank_{n:05d}.csv").write_text(text)
    return str(tmp_path)


def test_shards(spark, tmp_path):
    folder = shard_folder(tmp_path, ["__sample_order,lat,lon,igbp,timestamp,pred_NEE\n3,1.00,2.00,,20170101000000,nan\n1,1.00,2.00,ENF,20170101000000,0.5\n",
                                     "", "__sample_order,lat,lon,igbp,timestamp,pred_NEE\n0,5.00,2.00,MF,20170102000000,1.5\n"])
    paths = shards.shard_paths(spark, folder)
    assert len(paths) == 3 and shards.shard_paths(spark, folder, 2) == paths[:2]
    with pytest.raises(FileNotFoundError, match="rank_00003"):
        shards.shard_paths(spark, folder, 4)
    with pytest.raises(ValueError):
        shards.shard_paths(spark, folder, 0)
    df = shards.read_shards(spark, paths)
    merged = merge.merge_shards([df.drop(*shards.POSITION)], ["NEE"])
    assert [tuple(r) for r in merged.collect()] == [
        ("5.00", "2.00", "MF", "20170102000000", "1.5"), ("1.00", "2.00", "ENF", "20170101000000", "0.5"),
        ("1.00", "2.00", None, "20170101000000", "nan")]
    numbers = merge.numeric_output(df)
    assert [r.pred_NEE for r in numbers.orderBy(*shards.POSITION).collect()] == [None, 0.5, 1.5]
    first = merge.resolve_duplicates(numbers, merge.COORDINATES, "first", shards.POSITION)
    assert {r["__sample_order"] for r in first.collect()} == {"3", "0"}


def test_shard_headers(spark, tmp_path):
    folder = shard_folder(tmp_path, ["a,b\n1,2\n", "b,a\n4,3\n", "a\n5\n"])
    paths = shards.shard_paths(spark, folder)
    with pytest.raises(Exception, match="header"):
        shards.read_shards(spark, paths).collect()
    loose = shards.read_shards(spark, paths, strict=False).drop(*shards.POSITION)
    assert rows(loose) == [("1", "2"), ("3", "4"), ("5", None)]


def test_prediction_files(spark, tmp_path):
    df = spark.createDataFrame([(0.25, -0.5, "ENF", 20170101000000, 1.23456, None), (0.1, 0.0, None, 20170101010000, -0.00004, 2.0)],
                               "lat float, lon float, igbp string, timestamp long, pred_NEE double, gt_NEE double")
    text = writers.formatted_predictions(df, ["NEE"])
    assert [tuple(r) for r in text.collect()] == [("45.00", "-90.00", "ENF", 20170101000000, "1.2346", "nan"),
                                                 ("18.00", "0.00", None, 20170101010000, "-0.0000", "2.0000")]
    writers.write_csv(text, str(tmp_path / "out"), single_file=True)
    files = list((tmp_path / "out").glob("*.csv"))
    assert len(files) == 1 and files[0].read_text().splitlines()[0] == "lat,lon,igbp,timestamp,pred_NEE,gt_NEE"
    writers.write_shards(spark.range(100).withColumn("v", F.col("id") * 2), str(tmp_path / "parts"), ["id"])
    parts = sorted((tmp_path / "parts").glob("*.csv"))
    seen = [int(line.split(",")[0]) for p in parts for line in p.read_text().splitlines()[1:]]
    assert seen == list(range(100))


def test_metric_files(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("site,igbp,rmse_NEE,nse_NEE\na,ENF,1.5,nan\nTOTAL,,2.5,0.5\n")
    got = shards.read_metrics(spark, str(path))
    assert rows(got) == [("TOTAL", None, 2.5, 0.5), ("a", "ENF", 1.5, None)]


def test_raster_pairs(spark, tmp_path):
    for name in ("201701021200A4.tiff", "201701021200A2.tiff", "201701011200A4.tiff", "201701011200A2.tiff", "201701031200A4.tiff", "x.tiff"):
        (tmp_path / name).write_bytes(b"x")
    files = rasters.list_files(spark, str(tmp_path), "*.tiff")
    assert "content" not in files.columns and files.count() == 6
    assert [r.timestamp for r in rasters.pair_files(files).collect()] == ["201701011200", "201701021200"]
    assert [r.timestamp for r in rasters.pair_files(files, limit=1).collect()] == ["201701011200"]
    only = rasters.pair_files(files, dates=["20170102"]).collect()
    assert only[0].a4_path.endswith("201701021200A4.tiff") and only[0].a2_path.endswith("201701021200A2.tiff")


def test_strips(spark):
    # one strip, two cells of 8x8, seven + two bands
    line = [float(v) for v in range(8 * 16)]
    a4 = spark.createDataFrame([(20170101, 3, [[v * 10 for v in line]] * 7)], "modis_date int, strip int, bands array<array<double>>")
    a2 = spark.createDataFrame([(20170101, 3, [[0.0] * 128, [1.0] * 128])], "modis_date int, strip int, bands array<array<double>>")
    cells = {r.grid_col: r for r in rasters.strips_to_cells(a4, a2, columns=2).collect()}
    assert sorted(cells) == [0, 1] and cells[0].grid_row == 3 and len(cells[1].data) == 576
    first_band = [round(v * 1000) for v in cells[1].data[:64]]
    assert first_band == [16 * r + 8 + c for r in range(8) for c in range(8)]
    assert cells[0].data[-64:] == [0.0] * 64
    strip = spark.createDataFrame([(8, 3, -10.0, 5.0, 1.0, [[1.0, 2.0, 3.0, 4.0, 5.0, 6.0]])],
                                  "row int, width int, west double, north double, step double, bands array<array<double>>")
    assert rows(rasters.strip_pixels(strip)) == [(8, 0, 1), (8, 1, 2), (8, 2, 3), (9, 0, 4), (9, 1, 5), (9, 2, 6)]


def test_strip_reader(monkeypatch):
    """The task side of the raster source, with a stand-in for the package."""
    import numpy as np

    class Raster:
        height, width = 20, 4
        transform = types.SimpleNamespace(a=0.25, e=-0.25, c=-180.0, f=90.0)
        crs = None
        pixels = np.arange(160).reshape(2, 20, 4)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def read(self, window):
            return self.pixels[:, window.row:window.row + window.height]

    window = types.ModuleType("rasterio.windows")
    window.Window = lambda col, row, width, height: types.SimpleNamespace(row=row, height=height)
    package = types.ModuleType("rasterio")
    package.open, package.windows = lambda path: Raster(), window
    monkeypatch.setitem(sys.modules, "rasterio", package)
    monkeypatch.setitem(sys.modules, "rasterio.windows", window)
    reader = rasters.StripReader({"path": "a.tiff"})
    parts = reader.partitions()
    assert [(p.row, p.height) for p in parts] == [(0, 8), (8, 8), (16, 4)]
    (row,) = reader.read(parts[2])
    assert row[:8] == ("a.tiff", 2, 16, 4, 4, -180.0, 90.0, 0.25) and row[8][0] == [float(v) for v in range(64, 80)]
    Raster.transform = types.SimpleNamespace(a=0.25, e=0.25, c=0.0, f=0.0)
    with pytest.raises(ValueError, match="north-up"):
        next(reader.read(parts[0]))


def test_netcdf_names(spark):
    raw = spark.createDataFrame([(1.0, 2.0, 3.0, float("nan"), 9)], "latitude double, longitude double, ELEVATION double, TA double, region_id int")
    df = netcdf.tidy_names(raw)
    assert df.columns == ["lat", "lon", "elev", "TA"] and tuple(df.first()) == (1.0, 2.0, 3.0, None)


def test_netcdf_reader(monkeypatch):
    """The task side of the NetCDF source, with a stand-in for the package."""
    import pandas as pd
    from pyspark.sql import types as T

    class Data:
        def __init__(self, steps):
            self.steps, self.sizes = steps, {"valid_time": len(steps), "latitude": 2}
            self.dims, self.data_vars = ["valid_time", "latitude"], ["TA"]

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def isel(self, where):
            return Data(self.steps[where["valid_time"]])

        def to_dataframe(self):
            index = pd.MultiIndex.from_product([pd.to_datetime(self.steps), [1.0, 2.0]], names=self.dims)
            return pd.DataFrame({"TA": range(len(index))}, index=index).astype(float)

    package = types.ModuleType("xarray")
    package.open_dataset = lambda path: Data(["2017-06-01 00:00", "2017-06-01 01:00", "2017-06-01 02:00"])
    monkeypatch.setitem(sys.modules, "xarray", package)
    source = netcdf.NetcdfSource({"path": "a.nc,b.nc", "steps": "2"})
    layout_ = source.schema()
    assert layout_.simpleString() == "struct<valid_time:timestamp_ntz,latitude:double,TA:double>"
    reader = source.reader(layout_)
    parts = reader.partitions()
    assert [(p.path, p.first, p.stop) for p in parts] == [("a.nc", 0, 2), ("a.nc", 2, 3), ("b.nc", 0, 2), ("b.nc", 2, 3)]
    read = [r for batch in reader.read(parts[1]) for r in batch.to_pylist()]
    assert [(r["valid_time"].hour, r["latitude"], r["TA"]) for r in read] == [(2, 1.0, 0.0), (2, 2.0, 1.0)]


def test_outlines(spark, tmp_path):
    path = tmp_path / "land.json"
    path.write_text("""{"type": "FeatureCollection", "features": [
      {"properties": {"ADMIN": "A"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 1], [2, 3.5]], [[4, 5], [6, 7]]]}},
      {"properties": {"ADMIN": "Antarctica"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 1], [2, 3]]]}},
      {"properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[8, 9], [1, 1]]]]}},
      {"properties": {"ADMIN": "none"}, "geometry": null}]}""")
    points = spatial.outline_rings(rasters.read_outlines(spark, str(path)))
    assert rows(points) == [(0, 0, 0, 0.0, 1.0), (0, 0, 1, 2.0, 3.5), (0, 1, 0, 4.0, 5.0), (0, 1, 1, 6.0, 7.0),
                            (2, 0, 0, 8.0, 9.0), (2, 0, 1, 1.0, 1.0)]


def test_configuration(spark, tmp_path):
    path = tmp_path / "c.yml"
    path.write_text("a: 1\nb: [x, y]\n")
    assert tables.load_config(path, {"a": 0, "z": 9}, {"a": None, "b": "q"}) == {"a": 1, "b": "q", "z": 9}
    path.write_text("- 1\n")
    with pytest.raises(ValueError):
        tables.load_config(path)
    run = tmp_path / "run"
    run.mkdir()
    with pytest.raises(FileNotFoundError):
        tables.find_config(run)
    (tmp_path / "config.yml").write_text("")
    assert tables.find_config(run) == tmp_path / "config.yml"
    (run / "config.yml").write_text("")
    assert tables.find_config(run) == run / "config.yml" and tables.find_config(run, path) == path
    with pytest.raises(FileNotFoundError):
        tables.find_config(run, tmp_path / "absent.yml")


def test_scratch_folder(spark):
    assert session.scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
    cluster = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None),
                                    sparkContext=types.SimpleNamespace(master="yarn"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_root(cluster)
    cluster.conf.get = lambda *_: "hdfs:///shared"
    assert session.scratch_root(cluster) == "hdfs:///shared"


def test_checkpoints(spark):
    def best(*names):
        df = spark.createDataFrame([(f"run/{n}",) for n in names], "path string")
        return [r.path for r in tables.latest_checkpoint(df).collect()]
    assert best("checkpoint-9.pth", "checkpoint-10.pth", "checkpoint-x.pth") == ["run/checkpoint-10.pth"]
    assert best("checkpoint-9.pth", "last.pth") == ["run/last.pth"]
    assert best("other.pth") == []


def test_schema_checks(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert schema.require_columns(df, ["a"]) is df and schema.present(df, ["b", "c", "a"]) == ["b", "a"]
    with pytest.raises(ValueError, match="c, d"):
        schema.require_columns(df, ["d", "a", "c"])
    df.createOrReplaceTempView("t_known")
    assert "t_known" in schema.require_tables(spark, ["t_known"])
    with pytest.raises(ValueError):
        schema.require_tables(spark, ["t_unknown"])
    assert len(schema.grid_facts().fields) == 35 and len(schema.site_facts().fields) == 42
    assert schema.predictions(["NEE"]).names[-1] == "pred_NEE" and schema.coord_dim().names[0] == "coord_id"
    assert tables.dataset_layout(spark.createDataFrame([(1, 2, 3, 4)], "time int, latitude int, longitude int, x int")) == {
        "kind": "cube", "dims": ["time", "latitude", "longitude"], "variables": ["x"]}


def test_clustered_files(spark, tmp_path):
    rng = random.Random(2)
    data = [(n, 1 if rng.random() < .6 else rng.randrange(9), rng.randrange(1000)) for n in range(2000)]
    df = spark.createDataFrame(data, "id long, coord_id long, timestamp long")
    layout.clustered(df, partitions=4).write.parquet(str(tmp_path / "t"))
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "t")).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 900  # the hot location fills no file alone
    layout.save_clustered(df, "clustered_facts", ["coord_id", "timestamp", "id"])
    try:
        stats = spark.sql("describe extended clustered_facts coord_id").collect()
        assert {r.info_name: r.info_value for r in stats}["distinct_count"] != "NULL"
    finally:
        spark.sql("drop table clustered_facts")


def images(spark, data):
    return spark.createDataFrame(data, schema.grid_images())


def test_image_store(spark, tmp_path):
    path = str(tmp_path / "store")
    image_store.create_store(spark, path)

    def stored():
        return rows(image_store.existing_images(spark, path).select("coord_id", "modis_date", F.col("data")[0]))
    image_store.store_images(spark, path, images(spark, [(1, 20170101, [1.0]), (2, 20170101, [2.0]), (1, 20170102, [3.0])]), False)
    image_store.store_images(spark, path, images(spark, [(1, 20170101, [9.0]), (3, 20170101, [4.0])]), False)
    assert stored() == [(1, 20170101, 1.0), (1, 20170102, 3.0), (2, 20170101, 2.0), (3, 20170101, 4.0)]
    image_store.store_images(spark, path, images(spark, [(1, 20170101, [8.0]), (4, 20170101, [5.0])]), True)
    assert stored() == [(1, 20170101, 8.0), (1, 20170102, 3.0), (2, 20170101, 2.0), (3, 20170101, 4.0), (4, 20170101, 5.0)]
    numbered = writers.number_images(image_store.existing_images(spark, path))
    assert sorted(r.modis_id for r in numbered.collect()) == [1, 2, 3, 4, 5]


def test_streams(spark, tmp_path):
    incoming, store, progress = (str(tmp_path / n) for n in ("in", "store", "progress"))
    images(spark, [(1, 20170101, [1.0])]).write.parquet(incoming)
    ingest.upsert_images(spark, incoming, store, progress, overwrite=True).awaitTermination(120)
    images(spark, [(1, 20170101, [2.0]), (2, 20170103, [3.0])]).write.mode("append").parquet(incoming)
    ingest.upsert_images(spark, incoming, store, progress, overwrite=True).awaitTermination(120)
    got = rows(image_store.existing_images(spark, store).select("coord_id", "modis_date", F.col("data")[0]))
    assert got == [(1, 20170101, 2.0), (2, 20170103, 3.0)]

    facts, table, seen = (str(tmp_path / n) for n in ("facts", "table", "seen"))
    layout_ = schema.grid_facts(["TA"])
    spark.createDataFrame([(1, 1, 1, float("nan"))], layout_).write.parquet(facts)
    ingest.append_facts(spark, facts, table, seen, ["TA"]).awaitTermination(120)
    spark.createDataFrame([(2, 1, 2, 0.5)], layout_).write.mode("append").parquet(facts)
    ingest.append_facts(spark, facts, table, seen, ["TA"]).awaitTermination(120)
    assert rows(spark.read.parquet(table)) == [(1, 1, 1, None), (2, 1, 2, 0.5)]
