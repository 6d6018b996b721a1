import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from fluxframe.llm import packing

FILE, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def check(docs, rows, **options):
    tokenizer = Tokenizer.from_file(FILE)
    ids = defaultdict(list)
    for doc, text in rows:
        ids[doc].append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, FILE, PATTERN, **options).collect():
        assert any(r["doc_tokens"] == len(x) and r["ids_crc32"] == zlib.crc32(
            np.array(x[r["start"]:r["start"] + r["length"]], "<u4").tobytes()) for x in ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for doc, own in pieces.items():  # each token once for every row that has this id
        covered = sorted(s + k for s, n in own for k in range(n))
        assert covered == sorted(k for x in ids[doc] for k in range(len(x)))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert 0 < at <= options.get("window", 1024)
    return sequences


def test_odd_rows(odd, odd_rows, empty):
    check(odd, [r[:2] for r in odd_rows])
    check(odd, [r[:2] for r in odd_rows], window=16, stretch=64)
    assert packing.pack(empty, FILE, PATTERN).count() == 0


def test_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sequences = check(docs, [(r["doc_id"], r["text"]) for r in docs.collect()])
    used = sum(n for own in sequences.values() for _, n in own)
    assert used > 0.97 * 1024 * len(sequences)


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_cheapest(seed):
    rng = np.random.default_rng(seed)
    window, n = 9, int(rng.integers(1, 40))
    ids = rng.integers(0, 4, n)
    ends = np.array([False, False, True, False])
    stops = np.unique(np.append(rng.integers(1, n + 1, 2), n))
    cuts = packing.cut_points(ids, stops, ends, window, 2, 7, 5)

    # the same by trying every predecessor
    penalty = {int(p): 0 for p in stops}
    for p in range(1, n + 1):
        if ends[ids[p - 1]]:
            penalty.setdefault(p, 2)
    edges = [0, *sorted(penalty)]
    for a, b in zip(edges, edges[1:]):
        if b - a > 5:
            penalty.update({p: 7 for p in range(a + 1, b)})
    best = {0: 0}
    for p in sorted(penalty):
        best[p] = min(best[q] + window - (p - q) + penalty[p] for q in best if p - window <= q < p)
    assert cuts[-1] == n and set(cuts) <= set(penalty)
    assert max(np.diff([0, *cuts])) <= window
    assert sum(window - k for k in np.diff([0, *cuts])) + sum(penalty[c] for c in cuts) == best[n]
