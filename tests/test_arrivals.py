import sys
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxframe import schema
from fluxframe.operators import meters
from fluxframe.plans import image_store
from fluxframe.sources import rasters
from fluxframe.sources.planned import read_planned
from fluxframe.streaming.meters import running_meters
from tests.conftest import rows


def feed(spark, incoming, out, progress):
    stream = spark.readStream.schema("name string, step long, value double").parquet(incoming)
    (running_meters(stream, "name", "step", "value", 4).writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination(180))


def test_running_meters_in_three_batches_with_restarts(spark, tmp_path):
    """Every call is a new query that goes on from the state of the last one."""
    incoming, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    rng = np.random.default_rng(1)
    data = [(n, s, None if s % 7 == 3 else float(rng.integers(0, 50))) for n in ("a", "b", None) for s in range(30)]
    data += [("late", s, float(s)) for s in range(22, 30)] + [("once", 25, 1.0), ("empty", 26, None)]
    for first in (0, 10, 20):
        part = [r for r in data if first <= r[1] < first + 10]
        spark.createDataFrame(part, "name string, step long, value double").repartition(3).write.mode("append").parquet(incoming)
        feed(spark, incoming, out, progress)
    feed(spark, incoming, out, progress)  # nothing new
    series = spark.createDataFrame(data, "name string, step long, value double")
    columns = ["name", "step", "value", *[F.round(c, 9) for c in ("median", "avg", "std", "max")]]
    got = spark.read.parquet(out)
    expected = meters.smoothed(series, "name", "step", "value", 4)
    assert rows(got.select(*columns)) == rows(expected.select(*columns))
    at_end = {r["name"]: r["g"] for r in got.groupBy("name").agg(F.max_by("global_avg", "step").alias("g")).collect()}
    means = {r["name"]: r["g"] for r in expected.groupBy("name").agg(F.max("global_avg").alias("g")).collect()}
    assert at_end.keys() == means.keys()
    assert all(at_end[k] is means[k] is None or at_end[k] == pytest.approx(means[k]) for k in means)


def test_migration_of_old_folders(spark, tmp_path):
    path = str(tmp_path / "store")
    image_store.create_store(spark, path)
    assert image_store.migrate_store(spark, path) == []
    now = spark.createDataFrame([(1, 20170101, [1.0]), (2, 20170101, [2.0])], schema.grid_images())
    image_store.store_images(spark, path, now, False)
    names = {p.name for p in (tmp_path / "store" / "modis_date=20170101").iterdir()}
    # without location numbers; with doubles, a column too many and a repeated image; with files of two layouts
    spark.createDataFrame([("5", [5.0])], "cell string, data array<float>").write.parquet(f"{path}/modis_date=20170102")
    spark.createDataFrame([(6, [6.0], "x"), (6, [7.0], "y")], "coord_id int, data array<double>, note string").write.parquet(
        f"{path}/modis_date=20170103")
    spark.createDataFrame([(8, [8.0])], "coord_id long, data array<float>").write.parquet(f"{path}/modis_date=20170104")
    spark.createDataFrame([("9", [9.0])], "cell string, data array<float>").write.mode("append").parquet(
        f"{path}/modis_date=20170104")
    with pytest.raises(Exception, match="no coord_id"):
        image_store.migrate_store(spark, path)
    assert image_store.migrate_store(spark, path, {"coord_id": F.col("cell").cast("long")}) == [20170102, 20170103, 20170104]
    got = rows(image_store.existing_images(spark, path).select("coord_id", "modis_date", F.col("data")[0]))
    assert got == [(1, 20170101, 1.0), (2, 20170101, 2.0), (5, 20170102, 5.0), (6, 20170103, 7.0), (8, 20170104, 8.0),
                   (9, 20170104, 9.0)]
    assert {p.name for p in (tmp_path / "store" / "modis_date=20170101").iterdir()} == names
    assert image_store.migrate_store(spark, path) == []


def test_strips_are_planned_by_tasks(spark, tmp_path, monkeypatch):
    """The raster source itself, opened in the tasks only, with a stand-in for the package."""
    monkeypatch.setitem(sys.modules, "rasterio", None)  # the driver cannot open a file
    for k, shape in enumerate([(5, 3), (2, 2), (0, 4)]):
        np.save(tmp_path / f"{k}.npy", np.arange(shape[0] * shape[1], dtype=float).reshape(shape))

    class Stand(rasters.StripSource):
        def reader(self, schema):
            class Opened:
                def __init__(self, path):
                    self.pixels = np.load(path)
                    self.height, self.width = self.pixels.shape
                    self.transform = types.SimpleNamespace(a=0.5, e=-0.5, c=10.0, f=20.0)
                    self.crs = types.SimpleNamespace(to_string=lambda: "EPSG:4326")

                def __enter__(self):
                    return self

                def __exit__(self, *_):
                    pass

                def read(self, window):
                    _, row, _, height = window
                    return self.pixels[None, row:row + height]

            package, window = types.ModuleType("rasterio"), types.ModuleType("rasterio.windows")
            package.open, window.Window = Opened, lambda *a: a
            sys.modules.update({"rasterio": package, "rasterio.windows": window})
            return super().reader(schema)

    paths = [str(tmp_path / f"{k}.npy") for k in range(3)]
    got = read_planned(spark, paths, Stand, {"height": "2"}, Stand({}).schema())
    assert rows(got.selectExpr("right(path, 5)", "strip", "row", "height", "width", "bands[0][0]")) == [
        ("0.npy", 0, 0, 2, 3, 0.0), ("0.npy", 1, 2, 2, 3, 6.0), ("0.npy", 2, 4, 1, 3, 12.0), ("1.npy", 0, 0, 2, 2, 0.0)]
    assert read_planned(spark, paths, Stand, {"height": "2"}).count() == 4  # the layout comes from a task
    assert read_planned(spark, [], Stand, {}, Stand({}).schema()).count() == 0
    cover = rasters.land_cover(read_planned(spark, paths[1:2], Stand, {"height": "1"}), 2, 2)
    assert rows(cover.select("row", "col", "code")) == [(0, 0, 0), (0, 1, 1), (1, 0, 2), (1, 1, 3)]
    with pytest.raises(ValueError, match="no schema"):
        read_planned(spark, [], Stand, {})
