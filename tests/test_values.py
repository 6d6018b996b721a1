"""Scalar, array, text and geographic expressions on hand-worked values."""

import math

import pytest
from pyspark.sql import functions as F

from fluxframe import schema, vocab
from fluxframe.functions import arrays, geo, scalars, text


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"n int, x {kind}")
    return [r[0] for r in df.orderBy("n").select(expression).collect()]


def test_vocabulary():
    assert len(vocab.PREDICTORS) == 32 and len(vocab.TARGETS) == 7 and len(vocab.CLASSES) == 17
    assert set(vocab.CLASS_OF_CODE.values()) == set(vocab.CLASSES)
    assert set(vocab.PREDICTORS) <= set(vocab.BOUNDS) and len(vocab.ROBINSON_X) == len(vocab.ROBINSON_Y) == 19
    assert [n for n, b in vocab.BOUNDS.items() if b[2]] == ["DOY", "TOD", "WD"]
    assert len(vocab.EARLIER_SCORES) == 15


@pytest.mark.parametrize("name, values, expected", [
    ("TA", [0.0, 80.0, 80.1, -80.0, None, float("nan")], [0.0, 0.5, None, -0.5, None, None]),
    ("TOD", [24.0, 0.0, 12.0, 24.5], [1.0, -1.0, 0.0, None]),
    ("WD", [180.0, 360.0], [0.0, 1.0]),
    ("SWC_1", [50.0, 0.0, 100.0], [None, None, None]),
])
def test_normalise(spark, name, values, expected):
    assert column(spark, values, "double", scalars.normalise(name, F.col("x"))) == expected


def test_normalise_with_ordered_bounds(spark):
    got = column(spark, [0.0, 25.0, 101.0], "double", scalars.normalise("SWC_1", F.col("x"), strict_bounds=False))
    assert got == [0.5, 0.25, None]
    assert scalars.normalise_value("TA", 160.0) == 1.0 and scalars.normalise_value("WD", 90.0) == -0.5


def test_calendar(spark):
    df = spark.sql("select timestamp_ntz '2016-12-31 23:59:58' as t")
    row = df.select(scalars.day_of_year(F.col("t")), scalars.time_of_day(F.col("t")),
                    scalars.timestamp_to_int(F.col("t")), scalars.int_to_date(scalars.timestamp_to_int(F.col("t")))).first()
    assert tuple(row) == (366, 24, 20161231235958, 20161231)


CASES = [("2017-06-30", 20170630000000, 20170630235959), (" 20170601 ", 20170601000000, 20170601235959),
         ("2017-06-01 12:30", 20170601123000, 20170601123000), ("2017-06-01T12:30:05", 20170601123005, 20170601123005),
         ("20170601123005", 20170601123005, 20170601123005), ("201706011234", 20170601123400, 20170601123400),
         ("rubbish", None, None), ("2017-13-01", None, None), ("2017-02-30", None, None), ("2017", None, None), (None, None, None)]


def test_dates(spark):
    texts = [c[0] for c in CASES]
    assert column(spark, texts, "string", scalars.parse_bound_column(F.col("x"), False)) == [c[1] for c in CASES]
    assert column(spark, texts, "string", scalars.parse_bound_column(F.col("x"), True)) == [c[2] for c in CASES]
    for written, low, high in CASES[:-1]:
        if low is None:
            with pytest.raises(ValueError):
                scalars.parse_bound(written, False)
        else:
            assert (scalars.parse_bound(written, False)[0], scalars.parse_bound(written, True)[0]) == (low, high)
    assert scalars.date_range("2017-06-01", None) == (20170601000000, None, "20170601_to_end")
    assert scalars.date_range(None, None) == (None, None, None)
    with pytest.raises(ValueError):
        scalars.date_range("2017-06-02", "2017-06-01")


@pytest.mark.parametrize("values, kind", [
    ([20170601123000, 20170602000000], "timestamp_ntz"), ([20170601, 20170602], "timestamp_ntz"),
    ([20170601, 20170601123000], "bigint"), ([20171301, 20170602], "bigint"), ([5], "bigint"), ([], "bigint")])
def test_whole_column_timestamp(spark, values, kind):
    df = spark.createDataFrame([(v,) for v in values], "t long")
    assert scalars.whole_column_timestamp(df, "t").dtypes == [("t", kind)]


def test_missing_values(spark):
    inf, nan = float("inf"), float("nan")
    values = [inf, -inf, nan, 100.0, 100.0001, -100.5, None, -100.0]
    assert column(spark, values, "double", scalars.clean_target(F.col("x"))) == [None, None, None, 100.0, None, None, None, -100.0]
    assert column(spark, values, "double", schema.finite(F.col("x"))) == [False, False, False, True, True, True, False, True]
    df = spark.createDataFrame([(nan, 1)], "a double, b int")
    assert tuple(schema.nan_to_null(df).first()) == (None, 1)
    got = column(spark, ["1.5", "nan", "x", None, "-2"], "string", scalars.to_number(F.col("x")))
    assert got == [1.5, None, None, None, -2.0]


def test_raster_values(spark):
    got = column(spark, [[-1, 0, 10000, 10001, 30000, 30001]], "array<int>", arrays.clean_reflectance(F.col("x")))
    assert got == [[-1.0, 0.0, 1.0, 1.0, 1.0, -1.0]]
    got = column(spark, [[0.0, 1.0, 2.0, float("nan"), None]], "array<double>", arrays.clean_snow(F.col("x")))
    assert got == [[0.0, 1.0, -1.0, -1.0, -1.0]]
    got = column(spark, [[float(v) for v in range(8)] + [255.0, float("nan")]], "array<double>", arrays.clean_water(F.col("x")))
    assert got == [[1.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0]]
    got = column(spark, [[-1.0] * 20 + [1.0] * 44, [-1.0] * 19 + [1.0] * 45], "array<double>", arrays.channel_is_masked(F.col("x")))
    assert got == [True, False]


def test_image_tensor(spark):
    a4 = [[1000 * (b + 1)] * 64 for b in range(7)]
    for extra in (0, 1):
        a2 = [[1.0] * 64] + [[9.0] * 64] * extra + [[1.0] * 64]
        df = spark.createDataFrame([(a4, a2)], "a4 array<array<int>>, a2 array<array<double>>")
        data = df.select(arrays.image_tensor(F.col("a4"), F.col("a2")).alias("d")).first().d
        assert len(data) == 576 and data[::64] == pytest.approx([.1, .2, .3, .4, .5, .6, .7, 1, 0])


def test_strip_cells(spark):
    # two rows of three 2-pixel cells: 0..5 and 6..11
    got = column(spark, [list(range(12))], "array<int>", arrays.cells_of_strip(F.col("x"), 2, 2, 3))
    assert got == [[[0, 1, 6, 7], [2, 3, 8, 9], [4, 5, 10, 11]]]


def test_fourier_and_products(spark):
    got = column(spark, [0.3], "double", arrays.fourier(F.col("x"), 3))[0]
    assert got == pytest.approx([f(math.pi * 2 ** k * 0.3) for f in (math.sin, math.cos) for k in range(3)])
    assert column(spark, [[3.0, -4.0]], "array<double>", arrays.norm_l2(F.col("x"))) == [5.0]
    assert column(spark, [[3.0, -4.0]], "array<double>", arrays.norm_max(F.col("x"))) == [4.0]
    assert column(spark, [[1, 2], []], "array<int>", arrays.first_or_empty(F.col("x"))) == [[1], []]


def test_names(spark):
    names = ["rmse_GPP_DT", "nse_GPP_NT", "rmse_NEE", "Reco_dt", "xDT", "rmse_rmse_a"]
    expected = ["GPP", "GPPNT", "NEE", "RECO", "X", "RMSEA"]
    assert column(spark, names, "string", text.metric_label(F.col("x"))) == expected
    assert [text.metric_label_of(n) for n in names] == expected
    assert text.split_names(["NEE,pred_LE NEE"], "pred_") == ["pred_NEE", "pred_LE"]
    assert text.split_names(None) is None
    with pytest.raises(ValueError):
        text.split_names([" , "])
    assert text.pick_targets(["lat", "pred_NEE", "pred_LE"], None) == ["pred_NEE", "pred_LE"]
    with pytest.raises(ValueError):
        text.pick_targets(["pred_NEE"], ["GPP"])
    assert text.preferred_first(["a", "time", "b"], ["time", "lat"]) == ["time", "a", "b"]


def test_file_lists(spark):
    files = ["a_IR_1.jpg,a_2.jpg", "b.jpg"]
    assert column(spark, files, "string", text.infrared_files(F.col("x"))) == [["a_IR_1.jpg"], []]
    assert column(spark, files, "string", text.colour_files(F.col("x"))) == [["a_2.jpg"], ["b.jpg"]]
    stamp, product = text.raster_name_parts(F.col("x"))
    paths = ["/d/201701011200A4.tiff", "x/20170101A4.tiff", "201701011200A2.tif"]
    assert column(spark, paths, "string", F.concat(stamp, F.lit("-"), product)) == ["201701011200-A4", "-", "-"]
    got = column(spark, [["enf ", " ENF", "wat"]], "array<string>", text.upper_unique(F.col("x")))
    assert got == [["ENF", "WAT"]]


def test_formats(spark):
    values = [0.125, 0.375, 1234.5, None, float("nan"), -0.5]
    assert column(spark, values, "double", text.fixed(F.col("x"), 2, "--")) == [
        f"{v:.2f}" if v is not None and v == v else "--" for v in values]
    assert column(spark, [39.25 * 1024, 1023.0, 1024.0 ** 2, 3 * 1024.0 ** 5], "double", text.human_bytes(F.col("x"))) == [
        "39.2 KiB", "1023 B", "1.0 MiB", "3072.0 TiB"]
    assert column(spark, [3725.0, 65.0, 5.9, -3.0], "double", text.human_duration(F.col("x"))) == ["1h02m05s", "1m05s", "5s", "0s"]
    assert column(spark, ["a  b\n c", "abcdefgh"], "string", text.compact(F.col("x"), 6)) == ["a b c", "abc..."]
    assert column(spark, [0, 180, -180, -30, 45], "int", text.degree_label(F.col("x"), True)) == ["0°", "180°", "180°", "30°W", "45°E"]
    assert column(spark, [0, -90, 45], "int", text.degree_label(F.col("x"), False)) == ["0°", "90°S", "45°N"]
    assert column(spark, ["a_b"], "string", text.escape_underscores(F.col("x"))) == ["a\\_b"]


def test_classes(spark):
    codes = [0, 13, 16, 12, 99, None]
    assert column(spark, codes, "int", text.class_of_code(F.col("x"), True)) == ["WAT", None, None, "CRO", None, None]
    assert column(spark, codes, "int", text.class_of_code(F.col("x"), False)) == ["WAT", "URB", "BSV", "CRO", None, None]
    assert column(spark, ["ENF", "zzz"], "string", text.class_colour(F.col("x"), F.lit(9))) == ["#006837", "#4DAF4A"]
    df = spark.createDataFrame([("b",), ("MF",), ("NULL",), ("a",), ("WAT",)], "label string")
    assert [r.label for r in text.in_legend_order(df, "label").collect()] == ["NULL", "MF", "WAT", "a", "b"]
    assert [r.label for r in text.in_legend_order(text.legend_only(df, "label"), "label").collect()] == ["NULL", "MF", "a", "b"]


def test_geography(spark):
    assert column(spark, [0.0, 180.0, 359.75, 181.0], "double", geo.wrap_longitude(F.col("x"))) == [0.0, -180.0, -0.25, -179.0]
    assert column(spark, [0.125, 0.375, -0.125, 45.25], "double", geo.cell_key(F.col("x"))) == [0, 2, 0, 181]
    edges = geo.cell_bounds(F.col("x"), F.col("x"))
    assert column(spark, [0], "int", F.array(*[edges[k] for k in ("lat_min", "lat_max", "lon_min", "lon_max")])) == [
        [89.75, 90.0, -180.0, -179.75]]
    assert column(spark, [-1.0, 0.0, 9.9, 50.0], "double", geo.floor_pixel(F.col("x"), 0.0, 5.0, 4)) == [0, 0, 1, 3]
    x, y = geo.robinson(F.lit(180.0), F.col("x"))
    assert column(spark, [0.0, 90.0, -90.0, 120.0], "double", x) == pytest.approx([.8487 * math.pi] + [.8487 * .5322 * math.pi] * 3)
    assert column(spark, [0.0, 90.0, -90.0, 7.5], "double", y) == pytest.approx([0, 1.3523, -1.3523, 1.3523 * .093])
    frame = geo.MapFrame.fit("plate", 0.0, 0.0, 360.0, 200.0)
    px, py = frame.pixels(F.lit(-180.0), F.col("x"))
    assert column(spark, [90.0, -90.0], "double", F.array(px, py)) == [[0, 10], [0, 190]]


def test_light_override(spark):
    changed = scalars.override_low_light(["pred_GPP_DT", "pred_NEE"], F.col("x"), 0.1)
    assert list(changed) == ["pred_GPP_DT"]
    df = spark.createDataFrame([(0.0, 5.0), (0.1, 5.0), (None, 5.0)], "x double, pred_GPP_DT double")
    assert [r[0] for r in df.select(changed["pred_GPP_DT"]).collect()] == [0.0, 5.0, 5.0]
    with pytest.raises(ValueError):
        scalars.override_low_light(["pred_NEE"], F.col("x"), 0.1)


def test_learning_rate(spark):
    got = column(spark, [0.0, 1.0, 2.0, 51.0, 100.0], "double", scalars.learning_rate(F.col("x"), 1.0, 0.1, 2, 100))
    assert got == pytest.approx([0.0, 0.5, 1.0, 0.55, 0.1])
    assert scalars.scaled_peak(0.001, 1024, 1, 4) == 0.016


def test_gaussian(spark):
    got = column(spark, [2.0], "double", scalars.gaussian_nll(F.col("x"), F.lit(1.0), F.lit(0.5)))
    assert got == pytest.approx([0.5 * math.log(2 * math.pi * 0.25) + 2.0])
