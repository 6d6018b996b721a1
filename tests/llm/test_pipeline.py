import random
import zlib
from collections import defaultdict
from itertools import combinations

import __spark_entry__ as driver
import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from fluxframe.llm import queries as llm_queries

from tests.llm.test_compression import slow_row
from tests.llm.test_jaccard import LOWER, roots, slow
from fluxframe.llm import compression


def test_stages_against_plain_loops(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    left = dict(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        kept = {r["doc_id"] for r in out.collect()}
        if name == "language":
            expected = {d for d, t in left.items() if any(c.isalpha() for c in t)}
        elif name == "quality":
            expected = {d for d, t in left.items() if slow_row(t, compression.Rules())[-2]}
        else:
            expected = five_word_copies(list(left.items()))
        assert kept == expected, name
        docs, left = docs.where(docs.doc_id.isin(list(kept))), {d: left[d] for d in kept}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, sf).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
    assert set(pieces) == set(left)
    for doc, own in pieces.items():
        ids = [*tokenizer.encode(left[doc], add_special_tokens=False).ids, 0]
        at = 0
        for start, length, crc in sorted(own):
            assert start == at and crc == zlib.crc32(np.array(ids[at:at + length], "<u4").tobytes())
            at += length
        assert at == len(ids)


def five_word_copies(rows):
    """Smallest ids of groups that share four fifths of their five-word shingles, by all pairs."""
    def shingles(text):
        words = (text or "").translate(LOWER).split()
        return set(zip(*(words[k:] for k in range(5)))) if len(words) >= 5 else {tuple(words)} if words else set()
    sets = [(d, shingles(t)) for d, t in rows]
    links = [(a, b) for (a, s), (b, t) in combinations(sets, 2) if s and t and 5 * len(s & t) >= 4 * len(s | t)]
    return {d for d, c in roots({d for d, _ in sets}, links).items() if c == d}


def test_near_copies_by_five_words_and_four_fifths(spark, sf):
    rng = random.Random(4)
    rows = []
    for _ in range(6):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(200)]
        rows.append(base)
        rows.append(base[:rng.randint(165, 178)])  # a cut tail
        at = rng.randrange(200)
        rows.append(base[:at] + [f"n{rng.randint(0, 3000)}" for _ in range(rng.randint(20, 44))] + base[at:])  # a passage
        for edits in (2, 3, 4, 5, 9):
            own = list(base)
            for k in rng.sample(range(200), edits):
                own[k] = f"e{rng.randint(0, 3000)}"
            rows.append(own)
    rng.shuffle(rows)
    rows = [(n, " ".join(r)) for n, r in enumerate(rows, 5)] + [(1, "a b c d"), (2, "a b c d"), (3, "a b c"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r["doc_id"] for r in corpus_pipeline.without_near_copies(spark, docs, sf).collect()}
    assert kept == five_word_copies(rows)
    assert len(kept) < len(five_word_copies(rows) | {d for d, _, c in slow(rows) if c == d})
    real = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = spark.createDataFrame(real, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.without_near_copies(spark, docs, sf).collect()}
    assert kept == five_word_copies(real)


def test_texts_that_share_an_id_go_only_as_copies(spark):
    rng = random.Random(6)
    a, b, c, d = (" ".join(f"w{rng.randint(0, 9999)}" for _ in range(60)) for _ in range(4))
    rows = [(1, a, "x"), (1, b, "x"), (1, b, "y"), (2, b + " tail", "x"), (3, c, "x"), (3, c, "x"), (None, d, "x"), (None, d, "x"), (4, None, "x"), (5, d, "x")]
    got = corpus_pipeline.without_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), "")
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    assert len(kept) == 7 and {t for _, t in kept} >= {a, c, d, None}
    assert sum(i == 1 for i, _ in kept) in (1, 2) and sum(t in (b, b + " tail") for _, t in kept) == 1
    assert [k for k in kept if k[0] is None] == [(None, d)] * 2 and (5, d) in kept


def test_documents_stay_where_no_language_can_be_learned(spark, odd, odd_rows):
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    left = corpus_pipeline.known_language(spark, unlabelled, "")
    assert left.columns == odd.columns
    assert sorted(r["text"] for r in left.collect()) == sorted(
        r[1] for r in odd_rows if any(c.isalpha() for c in r[1] or ""))


def test_stages_take_odd_rows(spark, odd, empty):
    for table in (odd, empty):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == table.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, "").count()


def test_registered():
    numbers = {int(n[2:].split("_")[0]) for n in llm_queries.QUERIES}
    assert numbers == set(range(1, 14)) and len(llm_queries.QUERIES) == 13
    assert {*llm_queries.QUERIES, "pipeline"} <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(llm_queries.QUERIES))
def test_query_over_its_whole_table(spark, sf, name):
    got = driver.queries()[name](spark, sf)
    if name.startswith(("op4_", "op12_", "op13_")):  # neighbours, words and negatives, not a row per document
        assert got.count() > 0
    else:
        assert got.count() >= spark.read.parquet(f"{sf}/documents.parquet").count()
