import math

import numpy as np
from fluxframe.llm import hnsw

SCHEMA = "vec_id long, embedding array<float>, score string, label int"


def slow(rows, every=100, k=10):
    good = {(i, tuple(v)) for i, v, *_ in rows if i is not None and v and all(
        x is not None and math.isfinite(x) for x in v) and any(v)}
    out = []
    for q, v in sorted(good):
        if q % every == 0:
            near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w))), i) for i, w in good
                          if i != q and len(w) == len(v))[:k]
            out += [(q, rank, i, d) for rank, (d, i) in enumerate(near, 1)]
    return out


def test_nulls_zeros_ties_and_repeats(spark):
    rng = np.random.default_rng(0)
    common = [1.0, 2.0, 3.0]
    rows = [(n, common, "x", 0) for n in range(0, 60)]
    rows += [(n, rng.normal(size=3).astype("f4").tolist(), None, None) for n in range(60, 220)]
    rows += [(300, None, None, 1), (400, [0.0, 0.0, 0.0], None, 1), (500, [1.0, None, 2.0], None, 1),
             (600, [1.0, float("nan"), 2.0], None, 1), (700, [1.0, float("inf"), 2.0], None, 1), (None, common, "x", 0),
             (800, [1.0, 2.0], None, 1), (801, [1.0, 2.5], None, 1), (900, [], None, 1), rows[3], rows[100]]
    got = hnsw.nearest(spark.createDataFrame(rows, SCHEMA)).orderBy("query_id", "rank").collect()
    expected = slow(rows)
    assert [r[:3] for r in map(tuple, got)] == [r[:3] for r in expected]
    assert np.allclose([r["score"] for r in got], [r[3] for r in expected], rtol=1e-12)


def test_empty(spark):
    assert hnsw.nearest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_over_several_shards(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.select("vec_id", "embedding")
    vectors = rows.withColumnsRenamed({"vec_id": "id", "embedding": "vector"}).selectExpr(
        "id", "cast(vector as array<double>) as vector")
    index = hnsw.build_index(hnsw.distinct_vectors(vectors, 11), shard_rows=300)
    assert index.count() >= 6
    got = hnsw.search(index, vectors.where("id % 20 = 0"), block=16).collect()
    own = {r["vec_id"]: np.array(r["embedding"], float) for r in rows.collect()}
    ids, all_ = np.array(list(own)), np.array(list(own.values()))
    hits = total = 0
    for q in {r["query_id"] for r in got}:
        d = np.sqrt(((all_ - own[q]) ** 2).sum(axis=1))
        best = [i for i in ids[np.lexsort((ids, d))].tolist() if i != q][:10]
        hits += len(set(best) & {r["vec_id"] for r in got if r["query_id"] == q})
        total += 10
    assert total == 10 * 100 and hits >= 0.95 * total
    assert all(abs(r["score"] - np.sqrt(((own[r["query_id"]] - own[r["vec_id"]]) ** 2).sum())) < 1e-12 for r in got)
