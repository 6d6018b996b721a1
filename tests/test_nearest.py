"""Nearest sites against all pairs."""

import math
import random

import pytest

from fluxframe.operators import nearest


def slow(points, sites):
    known = [(i, x, y) for i, x, y in sites if i is not None and None not in (x, y) and math.isfinite(x) and math.isfinite(y)]
    out = []
    for p, x, y in points:
        if None in (x, y) or not (math.isfinite(x) and math.isfinite(y)) or not known:
            out.append((p, None, None))
            continue
        d2, site = min(((sx - x) * (sx - x) + (sy - y) * (sy - y), i) for i, sx, sy in known)
        out.append((p, site, math.sqrt(d2)))
    return sorted(out, key=str)


def run(spark, points, sites, **options):
    p = spark.createDataFrame(points, "p long, lon double, lat double").repartition(3)
    s = spark.createDataFrame(sites, "site long, lon double, lat double")
    df = nearest.nearest_site(p, s, "site", **options)
    return sorted(((r.p, r.nearest, r.distance) for r in df.collect()), key=str)


def crowd(rng, n):
    """A dense town, a line, single sites far out, several sites of one place."""
    sites = [(100 + rng.gauss(0, 0.02), 50 + rng.gauss(0, 0.02)) for _ in range(n)]
    sites += [(k * 0.5, 0.0) for k in range(n // 3)] + [(-500.0, 3.0), (500.0, -7.0)]
    sites += [rng.choice(sites) for _ in range(n // 5)]
    rng.shuffle(sites)
    return [(n * 3 % 10_007, x, y) for n, (x, y) in enumerate(sites)]


@pytest.mark.parametrize("crowded", [4])
def test_against_all_pairs(spark, crowded):
    rng = random.Random(crowded)
    sites = crowd(rng, 300)
    places = [(rng.uniform(-200, 200), rng.uniform(-90, 90)) for _ in range(150)]
    places += [(100 + rng.gauss(0, 0.04), 50 + rng.gauss(0, 0.04)) for _ in range(150)]
    places += [(k * 0.25, 1.0) for k in range(150)]  # halfway between sites: ties
    places += [(x, y) for _, x, y in sites[:40]] + [(1e9, 1e9), (-1e9, 0.0)] + [places[0]] * 30
    points = [(n, x, y) for n, (x, y) in enumerate(places)]
    assert run(spark, points, sites, crowded=crowded) == slow(points, sites)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    points = [(1, 0.0, 0.0), (2, None, 1.0), (3, nan, 1.0), (4, inf, 0.0), (5, -0.0, 0.0), (1, 0.0, 0.0)]
    sites = [(7, 1.0, 0.0), (6, -1.0, 0.0), (5, nan, 0.0), (4, None, 0.0), (None, 0.0, 0.0), (9, 1.0, 0.0)]
    assert run(spark, points, sites) == slow(points, sites)
    assert run(spark, points, sites[:1]) == slow(points, sites[:1])
    assert run(spark, points, [(1, None, 2.0)]) == slow(points, [])
    with pytest.raises(ValueError, match="are there already"):
        run(spark, points, sites, out="p")
    assert run(spark, points[1:2], sites) == [(2, None, None)]


def test_cells_are_cut_until_they_hold_few(spark):
    rng = random.Random(2)
    rows = [(x, y, i) for i, x, y in crowd(rng, 500)]
    places = spark.createDataFrame(rows, "x double, y double, site long").dropDuplicates(["x", "y"])
    cells, sites, levels = nearest.build_cells(places, crowded=10)
    held = sites.groupBy("level", "cx", "cy").count()
    assert levels > 3 and held.agg({"count": "max"}).first()[0] <= 10
    assert sites.count() == places.count() and cells.where('cut').count() > 3
