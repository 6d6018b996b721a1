"""The commands, end to end on small files."""

import numpy as np

from fluxframe.__main__ import main
from fluxframe.operators import network
from tests.test_ingest import world


def lines(folder):
    return [line for p in sorted(folder.glob("*.csv")) for line in p.read_text().splitlines()]


def test_score_merge_and_describe(spark, tmp_path, capsys):
    data = str(tmp_path / "data")
    spark.createDataFrame([(n, n % 2, 20170601000000 + n, n / 9) for n in range(8)],
                          "id long, coord_id long, timestamp long, TA double").write.parquet(data + "/ec_data.parquet")
    spark.createDataFrame([(0, 1.0, 2.0, 3.0, "ENF"), (1, 4.0, 5.0, None, None)],
                          "coord_id long, lat double, lon double, elev double, igbp string").write.parquet(data + "/coord_data.parquet")
    cfg = network.NetConfig(predictors=("TA",), length=2, width=8, heads=2, frequencies=2, embedding=4, layers="wcs")
    np.savez(tmp_path / "w.npz", **{k.replace("/", "__"): v for k, v in network.init_weights(cfg).items()})
    (tmp_path / "c.yml").write_text("predictors: [TA]\nlength: 2\nwidth: 8\nheads: 2\nfrequencies: 2\nembedding: 4\nlayers: wcs\nother: 1\n")
    main(["score", "--data", data, "--config", str(tmp_path / "c.yml"), "--weights", str(tmp_path / "w.npz"),
          "--output", str(tmp_path / "out"), "--end-date", "20170601000005"])
    got = [line for line in lines(tmp_path / "out") if not line.startswith("lat")]
    assert [line.split(",")[:4] for line in got] == [["1.00", "2.00", "ENF", "20170601000002"], ["1.00", "2.00", "ENF", "20170601000004"],
                                                    ["4.00", "5.00", "", "20170601000003"], ["4.00", "5.00", "", "20170601000005"]]
    main(["score", "--data", data, "--config", str(tmp_path / "c.yml"), "--weights", str(tmp_path / "w.npz"),
          "--output", str(tmp_path / "ranks"), "--end-date", "20170601000005", "--num-shards", "2"])
    assert sorted(p.name for p in (tmp_path / "ranks").glob("*.csv")) == ["rank_00000.csv", "rank_00001.csv"]
    main(["merge", "--shards", str(tmp_path / "ranks"), "--output", str(tmp_path / "merged"), "--sort", "--num-shards", "2"])
    assert lines(tmp_path / "merged") == lines(tmp_path / "out")
    main(["describe", "--path", data + "/coord_data.parquet"])
    assert "'kind': 'other'" in capsys.readouterr().out


def test_merge_and_report(spark, tmp_path, capsys):
    folder = tmp_path / "shards"
    folder.mkdir()
    head = "__sample_order,lat,lon,igbp,timestamp,pred_NEE,pred_LE\n"
    (folder / "rank_00000.csv").write_text(head + "1,1.0,2.0,ENF,20170101,0.5,1\n2,1.0,2.0,ENF,20170101,0.7,1\n")
    (folder / "rank_00001.csv").write_text(head + "0,3.0,2.0,MF,20170102,1.5,nan\n")
    main(["merge", "--shards", str(folder), "--output", str(tmp_path / "csv"), "--sort", "--prediction-targets", "NEE"])
    assert [x.split(",")[-1] for x in lines(tmp_path / "csv") if not x.startswith("lat")] == ["1.5", "0.5", "0.7"]
    main(["merge", "--shards", str(folder), "--output", str(tmp_path / "cube"), "--format", "cube", "--duplicates", "mean"])
    cells = spark.read.parquet(str(tmp_path / "cube/cells")).orderBy("time_index").collect()
    filled = [[round(v, 5) for v in c.pred_NEE] for c in cells if c.pred_NEE[0] == c.pred_NEE[0]]
    assert len(cells) == 4 and filled == [[0.6], [1.5]]
    assert [c.igbp for c in cells if c.igbp != [None]] == [["ENF"], ["MF"]]
    kept = {r.name: r.value for r in spark.read.json(str(tmp_path / "cube/attributes")).collect()}
    assert (kept["num_input_rows"], kept["num_output_rows"], kept["num_duplicate_coordinate_rows"], kept["num_shards"]) == ("3", "2", "2", "2")

    scored = str(tmp_path / "scored")
    spark.createDataFrame([(1, "a", "ENF", 1.0, 2.0), (2, "a", "ENF", 3.0, 3.0), (3, "b", "CRO", 1.0, 1.0)],
                          "id long, site string, igbp string, pred_NEE double, gt_NEE double").write.parquet(scored)
    main(["evaluate", "--scored", scored, "--output", str(tmp_path / "metrics"), "--batch-size", "2"])
    assert lines(tmp_path / "metrics") == ["site,igbp,num_batches,num_samples,avg_loss,rmse_NEE,nse_NEE", "a,ENF,1,2,0.5,0.7071,-1.0",
                                           "b,CRO,1,1,0.0,0.0,", "TOTAL,,2,3,0.3333,0.5774,0.5"]
    main(["report", "--metrics", str(tmp_path / "metrics"), "--output", "-"])
    assert "ENF & 2.8141" in capsys.readouterr().out


def test_dimension_commands(spark, tmp_path):
    dim, cover = str(tmp_path / "dim"), str(tmp_path / "cover")
    spark.createDataFrame([(1, 10.0, 10.0, None), (2, -10.0, 10.0, "WAT")],
                          "coord_id long, lat double, lon double, igbp string").write.parquet(dim)
    spark.createDataFrame([(0, 0, 4), (1, 0, 5)], "row int, col int, code int").write.parquet(cover)
    main(["relabel", "--dim", dim, "--cover", cover, "--frame", "-180", "90", "90", "2", "1", "--write", str(tmp_path / "new"), "--only-null"])
    assert {r.coord_id: r.igbp for r in spark.read.parquet(str(tmp_path / "new")).collect()} == {1: "DBF", 2: "WAT"}
    main(["bins", "--dim", dim, "--output", str(tmp_path / "bins")])
    assert spark.read.parquet(str(tmp_path / "bins")).count() == 2
    facts = str(tmp_path / "facts")
    spark.createDataFrame([(5, 2, 1), (6, 1, 1)], "id long, coord_id long, timestamp long").write.parquet(facts)
    main(["cluster", "--facts", facts, "--output", str(tmp_path / "clustered"), "--rebuild-ids"])
    assert {(r.id, r.coord_id) for r in spark.read.parquet(str(tmp_path / "clustered")).collect()} == {(1, 1), (2, 2)}


def test_from_raw_grid_to_merged_file(spark, tmp_path):
    """ingest, images, enrich in place, score in shards, merge."""
    raw, mask, cover, frame = world(spark)
    for name, table in (("raw", raw), ("mask", mask), ("cover", cover)):
        table.write.parquet(str(tmp_path / name))
    spark.createDataFrame([(352, 716, 20170131, [1.0] * 4), (352, 720, 20170131, [2.0] * 4)],
                          "grid_row int, grid_col int, modis_date int, data array<float>").write.parquet(str(tmp_path / "cells"))
    data, place = str(tmp_path / "data"), ["--frame", "-2.5", "3.5", "1", "4", "4"]
    main(["ingest", "--raw", str(tmp_path / "raw"), "--mask", str(tmp_path / "mask"), "--cover", str(tmp_path / "cover"),
          "--output", data, *place, "--mask-origin", "0", "0", "--mask-step", "1", "1", "--mask-size", "360", "4"])
    main(["images", "--data", data, "--cells", str(tmp_path / "cells")])
    main(["enrich", "--data", data, "--cover", str(tmp_path / "cover"), "--cells", str(tmp_path / "cells"), *place, "--overwrite"])
    assert not [p for p in (tmp_path / "data").iterdir() if ".new-" in p.name or ".old-" in p.name]
    assert spark.read.parquet(data + "/ec_data.parquet").select("id").distinct().count() == 18
    cfg = network.NetConfig(predictors=("TA",), length=2, width=8, heads=2, frequencies=2, embedding=4, layers="wcs")
    np.savez(tmp_path / "w.npz", **{k.replace("/", "__"): v for k, v in network.init_weights(cfg).items()})
    (tmp_path / "c.yml").write_text("predictors: [TA]\nlength: 2\nwidth: 8\nheads: 2\nfrequencies: 2\nembedding: 4\nlayers: wcs\n")
    main(["score", "--data", data, "--config", str(tmp_path / "c.yml"), "--weights", str(tmp_path / "w.npz"),
          "--output", str(tmp_path / "ranks"), "--num-shards", "4"])
    main(["merge", "--shards", str(tmp_path / "ranks"), "--output", str(tmp_path / "merged"), "--sort"])
    assert len([x for x in lines(tmp_path / "merged") if not x.startswith("lat")]) == 9
