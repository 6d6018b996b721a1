"""Pixels of lines and points against plain loops; headers in one pass."""

import random

from pyspark.sql import functions as F

from fluxframe.functions import geo
from fluxframe.operators import mapping
from fluxframe.sources import shards

FRAME = geo.MapFrame("plate", 0.0, 0.0, 1.0, 0.0, 0.0)  # px = lon, py = -lat


def test_lines_are_clipped_and_walked(spark):
    view = (0.0, 0.0, 20.0, 10.0)
    rng = random.Random(1)
    points = [(k, n, rng.choice([rng.uniform(-30, 50), 5.0]), rng.choice([-rng.uniform(-20, 30), -4.0])) for k in range(6) for n in range(8)]
    points += [(9, 0, 1.0, -1.0), (9, 1, None, -2.0), (9, 2, 3.0, -3.0), (10, 0, 2.0, -2.0), (11, 0, -9e9, -5.0), (11, 1, 9e9, -5.0)]
    df = spark.createDataFrame(points, "k long, n long, lon double, lat double").repartition(4)
    got = {(r.px, r.py) for r in mapping.line_pixels(df, FRAME, view, ["k"], ["n"]).collect()}
    assert got and all(0 <= x <= 20 and 0 <= y <= 10 for x, y in got)
    assert {(x, 5) for x in range(21)} <= got  # the line from far outside to far outside
    # every pixel of a fine walk along the visible parts has a pixel beside it, and the other way round
    walked = set()
    for a, b in zip(points, points[1:]):
        if a[0] != b[0] or None in (*a, *b) or a[0] == 11:
            continue
        for s in range(2001):
            x, y = a[2] + (b[2] - a[2]) * s / 2000, -(a[3] + (b[3] - a[3]) * s / 2000)
            if 0 <= x <= 20 and 0 <= y <= 10:
                walked.add((x, y))
    assert all(any(abs(x - p) <= 1 and abs(y - q) <= 1 for p, q in got) for x, y in walked)
    assert all(q == 5 or any(abs(x - p) <= 0.6 and abs(y - q) <= 0.6 for x, y in walked) for p, q in got)


def test_points_drawn_last_are_on_top(spark):
    rng = random.Random(2)
    labels = ["ENF", "EBF", "BSV", "QQQ", None]
    rows = [(rng.uniform(0, 12), -rng.uniform(0, 12), rng.choice(labels)) for _ in range(60)] + [(None, 1.0, "ENF"), (1.0, None, None)]
    df = spark.createDataFrame(rows, "lon double, lat double, igbp string")
    rank = {"ENF": 0, "EBF": 1, "QQQ": 3, "NULL": 4}
    for stamp in (mapping.square(4), mapping.square(1), mapping.disc(2)):
        drawn = {}
        for lon, lat, label in sorted((r for r in rows if None not in r[:2] and r[2] != "BSV"), key=lambda r: rank[r[2] or "NULL"]):
            for a, b in stamp:
                if 1 <= round(lon) + a <= 9:
                    drawn[round(lon) + a, round(-lat) + b] = label or "NULL"
        got = mapping.point_pixels(df, FRAME, stamp, view=(1.0, -99.0, 9.0, 99.0)).collect()
        assert {(r.px, r.py): r.label for r in got} == drawn and len(got) == len(drawn)
    assert mapping.square(4)[0] == (-2, -2) and mapping.square(4)[-1] == (1, 1) and len(mapping.disc(2)) == 13


def test_headers_take_one_job_whatever_the_number_of_files(spark, tmp_path):
    for n in range(12):
        (tmp_path / f"rank_{n:05d}.csv").write_text("" if n == 3 else ('a,"b,c"\n' if n % 2 else 'b,a\n') + f"{n},{n}\n" * 50)
    paths = shards.shard_paths(spark, str(tmp_path))
    spark.sparkContext.setJobGroup("headers", "")
    found = shards.headers(spark, paths)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("headers"))
    spark.sparkContext.setJobGroup("", "")
    assert len(found) == 11 and found["rank_00001.csv"] == ["a", "b,c"] and found["rank_00002.csv"] == ["b", "a"]
    assert jobs <= 3
    loose = shards.read_shards(spark, paths, strict=False)
    assert loose.count() == 550 and loose.agg(F.countDistinct("a")).first()[0] == 11
