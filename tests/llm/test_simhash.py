import random
from itertools import combinations

import numpy as np
import xxhash

from fluxframe.llm import simhash
from tests.llm.test_jaccard import LOWER, roots


def slow_fingerprint(text):
    words = [w for w in (text or "").encode().decode("latin-1").translate(LOWER).split(" ")]
    words = [w for part in words for w in part.translate({c: 32 for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode("latin-1"), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow(rows, distance=4):
    """(doc_id, fingerprint, component) by all pairs of different fingerprints."""
    prints = [(d, slow_fingerprint(t)) for d, t in rows]
    kinds = {}
    for d, p in prints:
        if d is not None:
            kinds.setdefault(p, set()).add(d)
    links = [(min(kinds[p]), d) for p in kinds for d in kinds[p]]
    links += [(min(kinds[p]), min(kinds[q])) for p, q in combinations(kinds, 2) if (p ^ q).bit_count() <= distance]
    found = roots({d for d, _ in prints if d is not None}, links)
    return sorted(((d, f"{p:016x}", None if d is None else found[d]) for d, p in prints), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_fingerprint_is_spark_s_hash(spark):
    rows = spark.sql("select xxhash64('a b c d') h").first()["h"]
    assert simhash.fingerprint("A b\tc\n d") == rows % 2**64
    for text in (None, "", " \n", "one", "one two three", "Ü ü É x y z", "a\x1cb\x85 c", "w " * 70_000):
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_whole_table_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(simhash.components(docs)) == slow([(r["doc_id"], r["text"]) for r in docs.collect()])


def near(rng, base, most):
    for b in rng.sample(range(64), rng.randint(0, most)):
        base ^= 1 << b
    return base


def test_links_of_crowded_and_cut_buckets(spark):
    """Chains of neighbours, dense groups and strangers; the same links with parts of seven."""
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(300)} | {0, 2**64 - 1}
    for _ in range(4):
        at = rng.getrandbits(64)
        for _ in range(60):
            prints.add(near(rng, at, 7))
            at = near(rng, at, 5) if rng.random() < 0.3 else at
    prints = sorted(prints)
    edges = [(a, b) for a, b in combinations(range(len(prints)), 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    expected = roots(set(range(len(prints))), edges)
    assert len(set(expected.values())) < len(prints) - 100
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    classes = spark.createDataFrame(list(enumerate(signed)), "first long, fingerprint long")
    for limit in (simhash.BLOCK, 7):
        pairs = [(r["u"], r["v"]) for r in simhash.links(classes, limit=limit).collect()]
        assert roots(set(range(len(prints))), pairs) == expected
        assert len(pairs) < 5 * 20 * len(prints)


def test_every_link_has_a_chain():
    """Pigeonring: whatever the places of the bits, some segment begins a chain within all budgets."""
    rng = random.Random(8)
    for distance in (1, 2, 4, 7):
        ring = simhash.Ring(distance)
        assert sum(ring.masks) == 2**64 - 1 and ring.budgets[0] == 0 and ring.budgets[-1] == distance
        for _ in range(500):
            differs = near(rng, 0, distance)
            assert any(differs & ring.masks[s] == 0 and simhash._holds(differs, ring.chain(s))
                       for s in range(ring.count))


def test_odd_rows(spark, odd, odd_rows, empty):
    assert got(simhash.components(odd)) == slow([r[:2] for r in odd_rows])
    assert simhash.components(empty).count() == 0


def test_one_id_with_several_texts_has_the_links_of_all(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(5, a), (5, b), (3, a), (9, b), (1, "nothing like the others at all")]
    found = got(simhash.components(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {(d, c) for d, _, c in found} == {(5, 3), (3, 3), (9, 3), (1, 1)}
