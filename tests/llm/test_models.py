"""Language, quality and language models: held-out accuracy, plain recomputation, odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from fluxframe.llm import factorisation, language, lm

SMALL = "/root/testdata/sf0.01"


def held(doc):
    return doc is None or zlib.crc32(str(doc).encode()) % 3 == 1


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


# language

def test_language_on_held_out_rows(docs):
    model = language.fit(docs)
    got = language.predict(docs, model).select("doc_id", "row.lang", "lang_pred", "score").collect()
    own = [r for r in got if held(r["doc_id"])]
    assert len(own) > 300 and sum(r["lang"] == r["lang_pred"] for r in own) >= 0.99 * len(own)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_backs_off_from_words_to_shorter_grams():
    grams = {order: {} for order in (0, *language.ORDERS)}
    grams[0] = {"house": 0}
    grams[3] = {"<ho": 1, "use": 2}
    grams[1] = {"x": 3}
    model = language.Model(["a", "b"], grams, np.array([[1, -1], [2, -2], [4, -4], [7, -7]], np.float32))
    assert model.word("house").tolist() == [1, -1]
    assert model.word("houses").tolist() == [3, -3]  # no 4-gram is known, two 3-grams are
    assert model.word("xyx").tolist() == [7, -7]
    assert model.word("qqq").tolist() == [0, 0]


def test_language_of_odd_rows(odd, odd_rows, empty, docs):
    found = language.predict(odd, language.fit(docs))
    by_text = {r["text"]: (r["lang_pred"], r["score"]) for r in found.select("row.text", "lang_pred", "score").collect()}
    assert found.count() == len(odd_rows)
    assert found.select("row.*").columns == odd.columns
    for text in (None, "", " \n\t ", "!!! *** $$$ %%%"):
        assert by_text[text] == ("und", 0.0)
    assert by_text["word " * 300][0] in ("de", "en", "es", "fr")
    nothing = language.fit(empty)
    assert nothing.languages == []
    assert {r[0] for r in language.predict(odd, nothing).select("lang_pred").collect()} == {"und"}
    assert language.predict(empty, nothing).count() == 0


def slow_language(rows):
    """Languages, and what a word says for each, by plain counting of all rows that may be learned from."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        for token in text.lower().split():
            word = "".join(c for c in token if c.isalpha())
            for order, grams in [(0, [word]), *((n, language.grams(word, n)) for n in (4, 3, 2, 1))] if word else ():
                for g in grams:
                    counts.setdefault((order, g), Counter())[lang] += 1
                    totals[lang, order] += 1
    langs = sorted({k[0] for k in totals})

    def entry(order, g):
        seen = {k: n for k, n in counts.get((order, g), {}).items() if n >= 2}
        if not seen:
            return None
        own = [math.log(seen[k] / (totals[k, order] + 1)) if k in seen else math.log(0.5 / (totals[k, order] + 1)) for k in langs]
        return [x - sum(own) / len(own) for x in own]

    def says(word):
        for order, grams in [(0, [word]), *((n, language.grams(word, n)) for n in (4, 3, 2, 1))]:
            if found := [e for e in (entry(order, g) for g in grams) if e]:
                return [sum(e[k] for e in found) / len(found) for k in range(len(langs))]
        return [0.0] * len(langs)
    return langs, says


def test_language_against_plain_counting(spark, sf):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    known = [(lang, t) for d, t, lang in rows if lang and t is not None and not held(d)]
    langs, says = slow_language(known)
    docs = spark.createDataFrame(rows * 3, "doc_id long, text string, lang string").repartition(4)  # repeated rows count once
    model = language.fit(docs)
    assert model.languages == langs
    for r in language.predict(docs.limit(40), model).select("row.text", "lang_pred", "score").collect():
        words = ["".join(c for c in t if c.isalpha()) for t in (r["text"] or "").lower().split()]
        words = [w for w in words if w]
        if not words:
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        each = [says(w) for w in words]
        total = [min(len(words), 8) * sum(e[k] for e in each) / len(each) for k in range(len(langs))]
        share = [math.exp(x - max(total)) for x in total]
        assert r["lang_pred"] == langs[share.index(max(share))] and abs(r["score"] - max(share) / sum(share)) < 1e-4


def test_repeated_rows_do_not_empty_the_sample(spark):
    rows = [(d, f"text {d}", "en") for d in range(400)] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.sample(docs, 50).count() == 50


def test_language_never_learns_from_held_out_rows(docs):
    swapped = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit("zz"))
                              .otherwise(F.col("lang")))
    assert language.fit(swapped).languages == ["de", "en", "es", "fr"]


# quality

def test_quality_on_held_out_rows(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    got = factorisation.score(docs, factorisation.fit(docs, labels))
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 100 and all(held(r["doc_id"]) for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.97 * len(rows)


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    machine = factorisation.Machine(rng.normal(size=factorisation.SIZE), rng.normal(size=(factorisation.SIZE, 3)))
    rows = [(np.array([1, 5, 9]), rng.normal(size=3)), (np.array([2, 4096]), rng.normal(size=2))]
    got = machine.margin(np.concatenate([a for a, _ in rows]), np.concatenate([x for _, x in rows]), np.array([0, 3]))
    for (at, x), m in zip(rows, got, strict=True):
        pairs = sum(machine.factors[at[i]] @ machine.factors[at[j]] * x[i] * x[j]
                    for i in range(len(at)) for j in range(i + 1, len(at)))
        assert math.isclose(machine.weights[at] @ x + pairs, m, rel_tol=1e-9)


def test_quality_of_odd_rows(spark, odd, odd_rows, empty, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    machine = factorisation.fit(docs, labels, epochs=1)
    got = factorisation.score(odd, machine).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == held(r["doc_id"]) for r in got)
    assert factorisation.score(empty, machine).count() == 0
    assert factorisation.score(odd.drop("n_chars"), machine).count() == len(odd_rows)
    alone = factorisation.fit(docs, labels.where("quality = 1"))
    assert {r["predicted"] for r in factorisation.score(odd, alone).collect()} == {1}
    unlabelled = factorisation.fit(docs, labels.where("quality is null"))
    assert factorisation.score(odd, unlabelled).count() == len(odd_rows)


# cross-entropy difference

def test_junk_is_further_from_the_target_than_prose(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    got = lm.cross_entropy_difference(docs, labels.where("quality = 1"))
    assert got.count() == docs.count()
    means = {r["quality"]: r["m"] for r in got.join(labels, "doc_id").groupBy("quality").agg(F.mean("score").alias("m")).collect()}
    assert means[0] > means[1] + 0.3


def test_losses_of_odd_rows(spark, odd, odd_rows, empty):
    targets = spark.createDataFrame([(8,), (8,), (None,), (99,)], "doc_id long")
    got = lm.cross_entropy_difference(odd, targets)
    assert got.count() == len(odd_rows)
    assert got.where("n_tokens = 0 and score is not null").count() == 0
    assert got.where("n_tokens > 0 and (score is null or isnan(score))").count() == 0
    assert lm.cross_entropy_difference(empty, targets).count() == 0
    assert lm.cross_entropy_difference(odd, targets.limit(0)).count() == len(odd_rows)


def exact_losses(rows, targets):
    """The two models by plain counting of words and pairs themselves, each without the row at hand."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [(d, (t or "").translate(lower).split()) for d, t in rows]
    size = len({w for _, t in texts for w in t})
    pairs = [(d in targets, list(zip([None, *t[:-1]], t, strict=True)) if t else []) for d, t in texts]
    every = [Counter(), Counter()]
    for hit, own in pairs:
        for k in range(1 + hit):
            every[k].update([*own, *(("context", a) for a, _ in own), *(("word", b) for _, b in own)])
            every[k]["all"] += len(own)
    out = []
    for (doc, _), (hit, own) in zip(texts, pairs, strict=True):
        mine = Counter([*own, *(("context", a) for a, _ in own), *(("word", b) for _, b in own)])
        mine["all"] = len(own)
        losses = []
        for k in (1, 0):
            left = lambda g, k=k: every[k][g] - (mine[g] if hit or not k else 0)
            total = 0.0
            for a, b in own:
                p = (left(("word", b)) + 0.5) / (left("all") + 0.5 * size)
                if left(("context", a)):
                    p = 0.6 * left((a, b)) / left(("context", a)) + 0.4 * p
                total -= math.log(p)
            losses.append(total / len(own) if own else None)
        out.append((doc, len(own), *losses))
    return out


@pytest.mark.parametrize(("held", "block"), [(2000, 1 << 14), (50_000, 1 << 17), (lm.HELD, lm.BLOCK)])
def test_every_word_and_pair_counts_by_itself(spark, held, block):
    rng = np.random.default_rng(3)
    # more words than any bounded model has room for, so that a cap shows
    rows = [(n, " ".join([f"Rare{i}" for i in rng.integers(0, 200_000, 900)] + [f"w{i}" for i in rng.integers(0, 30, 100)]))
            for n in range(120)]
    rows += [(200, rows[0][1]), (200, "another text"), (201, None), (202, " \n "), (None, "w1 w2 w1 w2"), (203, "one")]
    targets = {*range(0, 120, 3), 200}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    marks = spark.createDataFrame([(d,) for d in [*targets, 0, 999, None]], "doc_id long")
    got = lm.cross_entropy_difference(docs, marks, held=held, block=block).collect()
    key = lambda r: (str(r[0]), r[1])
    expected = sorted(exact_losses(rows, targets), key=key)
    assert len(got) == len(expected)
    for r, (doc, n, target, background) in zip(sorted(map(tuple, got), key=key), expected, strict=True):
        assert r[:2] == (doc, n)
        if n:
            assert r[2:] == pytest.approx((target, background, target - background), rel=1e-9, abs=1e-9)
        else:
            assert r[2:] == (None, None, None)
