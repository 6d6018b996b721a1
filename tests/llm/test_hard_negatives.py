import math
import random

import duckdb
import numpy as np
import pytest

from fluxframe.llm import hard_negatives

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def slow(rows):
    """By scoring every row for every anchor."""
    kept = {}
    for i, v, label in sorted((r for r in rows if None not in r and None not in r[1] and all(map(math.isfinite, r[1]))),
                              key=lambda r: (r[2], r[1]), reverse=True):
        kept[i] = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v])
    out = []
    for a, (label, v) in kept.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, own == label)
                        for i, (own, w) in kept.items() if i != a)
        for p, i, _ in [s for s in scored if s[2]][:5]:
            fits = [(n, j) for n, j, same in scored if not same and -30 * p <= -100 * n <= -90 * p]
            out += [(a, i, rank, j, -p, -n) for rank, (n, j) in enumerate(fits[:10], 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def clustered(rng, count, width):
    """Few directions, coarse components: many ties, repeated vectors, a label with half of the rows."""
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    rows = []
    for i in range(count):
        c = rng.choice(centres)
        v = [round(x + rng.gauss(0, 0.4), 1) for x in c]
        rows.append((i * 5 - 100, v, 3 if rng.random() < 0.5 else rng.randint(0, 12)))
    return rows + [(i + 1, v, y) for i, v, y in rows[:40]]


@pytest.mark.parametrize("shard_rows,block_anchors,fanout", [(8192, 20_000, 32), (50, 4, 3)])
def test_against_all_pairs(spark, shard_rows, block_anchors, fanout):
    rows = clustered(random.Random(2), 500, 5)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    found = got(hard_negatives.mine(df, shard_rows=shard_rows, block_anchors=block_anchors, fanout=fanout))
    assert found == slow(rows) and len(found) > 100


def test_tree_prunes_and_finds_the_same():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 300, (20, 6))
    vectors = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(0, 10, (4000, 6)))
    labels, ids = rng.integers(0, 4, 4000), rng.permutation(4000)
    tree = hard_negatives.RTree(ids, labels, vectors)
    for q in range(20):
        for same in (True, False):
            scores = vectors @ vectors[q]
            top = scores.max()
            windows = [(-math.inf, math.inf), (0.3 * top, 0.9 * top), (0, 5), (top + 1, top + 2)]
            found = tree.search(int(ids[q]), int(labels[q]), vectors[q], same, 7, windows)
            for (low, high), own in zip(windows, found):
                fits = (labels == labels[q]) == same
                fits &= (scores >= low) & (scores <= high) & (ids != ids[q])
                assert own == sorted(((int(scores[k]), int(ids[k])) for k in np.flatnonzero(fits)), key=lambda r: (-r[0], r[1]))[:7]
    assert tree.opened < 40 * 125 * 0.6  # of 125 leaves for each walk


def test_whole_table_against_sql(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    expected = sorted(duck.sql(f"select {', '.join(COLUMNS)} from ({hard_negatives.SQL})").fetchall())
    assert got(hard_negatives.mine(df)) == expected and expected
    assert expected == slow([(r["vec_id"], list(r["embedding"]), r["label"]) for r in df.collect()])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 3), (1, [1.0, 0.5], 3), (2, [0.9, 0.5], 4), (3, [0.1, 0.1], 5), (5, [0.4, 0.4], None),
            (6, None, 3), (8, [nan, 1.0], 4), (9, [inf, 1.0], 4), (10, [None, 1.0], 4), (None, [1.0, 1.0], 3),
            (11, [0.5, 0.5], 4), (12, [0.5], 4), (13, [], 4), (100, [], 3), (200, [-1.0, -1.0], 9), (14, [0.5, 0.6], 4),
            (11, [0.5, 0.5], 4), (15, [0.5, 0.5, 9.0], 4)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows],
                               "vec_id long, embedding array<float>, label int, rank string, positive_score double")
    expected = slow([(i, v and [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows])
    assert got(hard_negatives.mine(df)) == expected and expected
    assert hard_negatives.mine(df.limit(0)).count() == 0
