import random
import re
import zlib
from collections import Counter

import pytest

from fluxframe.llm import spelling
from tests.llm.test_jaccard import LOWER


def slow_counts(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def slow(counts, near=None):
    """Rows of the vocabulary; near words by all pairs, or through all texts with one letter left out."""
    near = near or {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None
    rows = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(rows)


def near_by_gaps(counts):
    gaps = {}
    for w in counts:
        for k in range(len(w)):
            gaps.setdefault(w[:k] + w[k + 1:], set()).add(w)
    near = {w: set() for w in counts}
    for w in counts:
        for k in range(len(w)):
            gap = w[:k] + w[k + 1:]
            near[w] |= {v for v in gaps[gap] | ({gap} & counts.keys()) if one_edit(w, v)}
        near[w] |= {v for v in gaps.get(w, ()) if one_edit(w, v)}
    return near


def got(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def test_whole_table_against_plain_loops(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = slow_counts([(r["doc_id"], r["text"]) for r in docs.collect()])
    expected = slow(counts, near_by_gaps(counts))
    assert got(spelling.variants(docs)) == expected
    assert any(r[1] for r in expected)
    few = dict(list(counts.items())[:700])
    assert slow(few) == slow(few, near_by_gaps(few))


@pytest.mark.parametrize("limit", [spelling.BLOCK, 5])
def test_close_words_in_whole_and_cut_buckets(spark, limit):
    """Words of few letters, many an edit apart; chains of forms; the same with parts of five words."""
    rng = random.Random(limit)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 8))) for _ in range(300)}
    counts = {w: rng.choice((5, 6, 25, 26, 125, 130, 700, 4000)) for w in words}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    near = {r["word"]: (r["n_near"], r["best"]["form"]) for r in spelling.neighbours(table, limit=limit).collect()}
    expected = slow(counts)
    assert {w: n for w, (n, _) in near.items()} == {r[0]: r[4] for r in expected if r[4]}
    assert all(near[r[0]][1] == r[1] for r in expected if r[1])
    forms = spark.createDataFrame([(r[0], r[1]) for r in expected], "word string, form string")
    ends = {r["word"]: r["root"] for r in spelling.roots(forms).collect()}
    assert ends == {r[0]: r[2] for r in expected if r[1]}
    assert any(r[2] not in (r[0], r[1]) for r in expected)


def test_lookup_against_definition():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(90)})
    index = spelling.SlicedIndex(words)
    for w in words:
        replaced, longer, shorter, begun = index.near(w, 1)
        assert [words[p] for p in spelling.places(replaced | longer | shorter)] == [v for v in words if one_edit(w, v)]
        assert [words[p] for p in spelling.places(begun)] == [v for v in words if v[0] == w[0]]


def test_odd_rows(spark, odd, odd_rows, empty):
    odder = odd.unionByName(odd).unionByName(odd).unionByName(odd).unionByName(odd)
    counts = slow_counts([r[:2] for r in odd_rows] * 5)
    assert got(spelling.variants(odder)) == slow(counts, near_by_gaps(counts))
    assert spelling.variants(empty).count() == 0
