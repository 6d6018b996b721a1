"""Co-located tables, footers, files with commit, and counters."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from fluxframe.operators import merge, ordering, spatial
from fluxframe.plans import image_store
from fluxframe.session import HOT_KEY_ROWS
from fluxframe.sources import colocated, footers, rankfiles
from tests.conftest import rows


def facts(spark, n=60):
    return spark.createDataFrame([(i, i % 7 if i % 3 else 1, i * 10 % 37, float(i)) for i in range(n)],
                                 "id long, coord_id long, timestamp long, v double").repartition(3)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [None, 8])
def test_join_and_frame_without_exchange(spark, tmp_path, limit):
    """With and without keys that are dealt to several tasks; the tables are opened again from their folder."""
    if limit:
        spark.conf.set(HOT_KEY_ROWS, str(limit))
    try:
        dim = spark.createDataFrame([(k, f"c{k}") for k in range(6)], "coord_id long, igbp string")
        colocated.colocate(facts(spark), dim, str(tmp_path), buckets=4)
    finally:
        spark.conf.unset(HOT_KEY_ROWS)
    for name in ("ec_data", "coord_data"):
        spark.sql(f"drop table {colocated._name(f'{tmp_path}/{name}')}")
    stored, places = (colocated.open_colocated(spark, f"{tmp_path}/{n}") for n in ("ec_data", "coord_data"))
    values = {"ids": F.collect_list("id")}
    framed = ordering.over_last_rows(stored.join(places.hint("merge"), "coord_id"), ["coord_id"], ["timestamp", "id"], 3, values)
    assert "Exchange" not in plan(framed)
    expected = ordering.over_last_rows(facts(spark).join(dim, "coord_id"), ["coord_id"], ["timestamp", "id"], 3, values)
    assert rows(framed) == rows(expected.select(*framed.columns))
    files = len(glob.glob(f"{tmp_path}/ec_data/*.parquet"))
    assert files <= 4 if not limit else files > 4


def test_footers_answer_without_a_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    facts(spark).write.parquet(path)
    df = footers.footer_estimate(spark, path)
    assert tuple(df.first()) == (60, 59) and "PushedAggregation: [COUNT(*), MAX(id)]" in plan(df)
    bounds = footers.footer_bounds(spark, path, ["timestamp"])
    assert tuple(bounds.first()) == (60, 60, 0, 36)
    # tables opened elsewhere are not concerned
    assert "BatchScan" not in plan(spark.read.parquet(path))
    facts(spark).limit(0).write.parquet(str(tmp_path / "none"))
    assert tuple(footers.footer_estimate(spark, str(tmp_path / "none")).first()) == (0, None)


def content(folder):
    return {os.path.basename(p): open(p).read() for p in sorted(glob.glob(f"{folder}/rank_*.csv"))}


def test_rank_files_commit_and_abort(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(n, f"a,{n}" if n % 2 else None) for n in range(5)], "__sample_order long, name string")
    rankfiles.write_rank_files(df, path, 3)
    first = content(path)
    assert first["rank_00000.csv"] == '__sample_order,name\n0,\n1,"a,1"\n'
    assert [c.count("\n") for c in first.values()] == [3, 3, 2]
    failing = df.withColumn("name", F.when(F.col("__sample_order") == 4, F.raise_error(F.lit("lost"))).otherwise("new"))
    with pytest.raises(Exception, match="lost"):
        rankfiles.write_rank_files(failing, path, 3)
    assert content(path) == first and sorted(os.listdir(path)) == sorted(first)
    rankfiles.write_rank_files(df.where("__sample_order < 1"), path, 3)
    assert [c.count("\n") for c in content(path).values()] == [2, 0, 0] and not glob.glob(f"{path}/.pending*")


def test_only_the_attempt_that_counts_is_kept(tmp_path):
    import pyarrow as pa

    writer = rankfiles.RankWriter(str(tmp_path), 1)
    batch = pa.RecordBatch.from_pydict({"a": ["x"], "__rank": [0]})
    writer.write(iter([batch]))  # an attempt whose message never came
    kept = writer.write(iter([batch]))
    writer.commit([kept])
    assert os.listdir(tmp_path) == ["rank_00000.csv"] and kept.rows == 1


def test_image_runs_report_what_they_did(spark, tmp_path):
    path = str(tmp_path / "store")
    image_store.create_store(spark, path)

    def images(listed):
        return spark.createDataFrame([(c, d, [v]) for c, d, v in listed], "coord_id long, modis_date int, data array<float>")
    assert image_store.store_images(spark, path, images([(1, 1, 0.5), (1, 1, 0.7), (2, 1, 1.0)]), False) == {"matched": 3, "written": 2}
    assert image_store.store_images(spark, path, images([(1, 1, 9.0), (3, 2, 1.0)]), False) == {"matched": 2, "written": 1}
    assert image_store.store_images(spark, path, images([(1, 1, 9.0)]), True) == {"matched": 1, "written": 1}
    assert image_store.store_images(spark, path, images([]), False) == {"matched": 0, "written": 0}


@pytest.mark.parametrize("policy", ["first", "mean"])
def test_rows_are_counted_while_they_pass(spark, policy):
    df = spark.createDataFrame([(1, 1.0, 1.0, 5.0, 0), (1, 1.0, 1.0, 7.0, 1), (2, 1.0, 1.0, 6.0, 2)],
                               "timestamp long, lat double, lon double, pred_NEE double, n int")
    unique, counts = merge.settle_unique(df, policy, ["n"])
    assert unique.count() == 2
    assert counts == {"input": 3, "output": 2, "duplicate_rows": 2, "duplicate_groups": 1}
    assert merge.settle_unique(df.where("n > 0"), policy, ["n"])[1]["duplicate_groups"] == 0


def test_axes_keep_their_own_types(spark):
    big = 2**60
    df = spark.createDataFrame([(big, 1.5, "12.50"), (big + 1, float("nan"), "7"), (None, -1.0, None)], "t long, lat double, s string")
    axes = spatial.numbered_axes(df, {"t": "i", "lat": "j"}, descending=["lat"])
    assert rows(axes["t"]) == [(big, 0), (big + 1, 1)] and rows(axes["lat"]) == [(-1.0, 1), (1.5, 0)]
    with pytest.raises(TypeError, match="numeric"):
        spatial.numbered_axes(df, {"s": "i"})
