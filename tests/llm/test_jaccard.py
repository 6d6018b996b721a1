import random
from itertools import combinations

import numpy as np
import pytest
from fluxframe.llm import jaccard
from fluxframe.llm.components import connected

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = (text or "").translate(LOWER)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if len(words) < 3:
        return {tuple(words)} if words else set()
    return set(zip(words, words[1:], words[2:]))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def slow(rows):
    sets = [(d, shingle_set(t)) for d, t in rows]
    links = [(a, b) for (a, s), (b, t) in combinations([x for x in sets if x[0] is not None], 2)
             if s and t and 100 * len(s & t) >= 90 * len(s | t)]
    found = roots({d for d, _ in sets if d is not None}, links)
    return sorted(((d, len(s), found.get(d)) for d, s in sets), key=str)


def check(docs, rows, **options):
    got = sorted(map(tuple, jaccard.components(docs, **options).collect()), key=str)
    assert got == slow(rows)
    return got


def near_copies(rng, groups, copies, words):
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(words)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, words // 20)):
                own[rng.randrange(words)] = f"e{rng.randint(0, 100)}"
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return list(enumerate(rows, 10))


def test_odd_rows(odd, odd_rows, empty):
    check(odd, [r[:2] for r in odd_rows])
    assert jaccard.components(empty).count() == 0


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(docs, [(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("limit", [1 << 21, 20_000])
def test_families_in_one_task_and_cut(spark, limit):
    rng = random.Random(limit)
    rows = near_copies(rng, 3, 60, 70) + [(n, " ".join(rng.choices("the of and to in".split(), k=40)))
                                          for n in range(1000, 1040)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows, limit=limit)
    assert len({r[2] for r in got}) < len(got) - 60


def test_one_of_each_keeps_every_column(spark):
    rng = random.Random(9)
    rows = [(n, t, "x", 1) for n, t in near_copies(rng, 2, 10, 60)]
    rows += [rows[0], (None, rows[0][1], "y", 2), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, n int")
    left = jaccard.one_of_each(docs)
    ids = [d for d, _, c in slow([r[:2] for r in rows if r[0] is not None]) if d == c]
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == sorted([*set(ids), None, None], key=str)


@pytest.mark.parametrize("seed", range(20))
def test_link_sets_against_all_pairs(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 60, 60).astype(np.uint64)
    sets = []
    for _ in range(40):
        own = base[rng.random(60) > rng.choice([0.0, 0.03, 0.08])]
        sets.append(np.unique(np.concatenate([own, rng.integers(0, 50, rng.integers(0, 4)).astype(np.uint64)])))
    sets.sort(key=len)
    links = [(i, j) for i, j in combinations(range(40), 2)
             if 100 * (x := len(np.intersect1d(sets[i], sets[j]))) >= 90 * (len(sets[i]) + len(sets[j]) - x)]
    assert jaccard.link_sets(sets) == list(roots(range(40), links).values())


def all_pairs(sets, percent=90):
    links = [(i, j) for i, j in combinations(range(len(sets)), 2)
             if 100 * (x := len(np.intersect1d(sets[i], sets[j]))) >= percent * (len(sets[i]) + len(sets[j]) - x)]
    return list(roots(range(len(sets)), links).values())


def test_no_candidate_is_not_no_overlap():
    a, b, k, u = np.split(np.arange(104, dtype=np.uint64), [10, 20, 100])
    sets = [np.concatenate(x) for x in ((a[:6], k, u), (a, k), (b, k), (a, b, k))]
    assert jaccard.link_sets(sets) == all_pairs(sets) == [0, 0, 0, 0]


@pytest.mark.parametrize("percent", [80, 90])
@pytest.mark.parametrize("seed", range(10))
def test_truncated_copies_against_all_pairs(seed, percent):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(4):
        base = rng.permutation(400)[:120].astype(np.uint64)
        for _ in range(14):  # cut at either end, some with words of their own
            start, stop = rng.integers(0, 16), rng.integers(100, 121)
            sets.append(np.unique(np.concatenate([base[start:stop], rng.integers(1000, 9000, rng.integers(0, 6)).astype(np.uint64)])))
    sets.sort(key=len)
    assert jaccard.link_sets(sets, percent) == all_pairs(sets, percent)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(n, n + 1) for n in range(400, 460)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = roots({x for k in links for x in k if k[0] != k[1]}, links)
    assert got == expected
