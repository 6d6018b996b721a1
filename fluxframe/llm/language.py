"""Language identification, words first, then ever shorter character n-grams.

A known word scores by its log frequency in every language. An unseen word falls
back to its character n-grams: the longest order of which the model knows any
decides, and the word counts as much as the mean of those n-grams. A document's
score is a softmax over the mean score of its words.

The model is fitted on a bounded sample, ``per_language`` documents of each
language, counted by Spark; its size is bounded by ``entries`` per language and
kind. Prediction is one pass without a shuffle; a task scores each distinct word
once while it remembers it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fluxframe.llm.common import bounded_sample, by_bytes, held_out, with_row

UNKNOWN = "und"
#: Documents of each language that the model is fitted on.
PER_LANGUAGE = 4000
ORDERS = (4, 3, 2, 1)
#: Words and n-grams seen less often are left to the next shorter order.
LEAST_SEEN = 2
#: Words from which on more words add no certainty.
SETTLED_WORDS = 8
REMEMBERED = 200_000


def letters(token: str) -> str:
    """The letters of a lower-cased token."""
    return token if token.isalpha() else "".join([c for c in token if c.isalpha()])


def grams(word: str, order: int) -> list[str]:
    """Character n-grams of a word between its bounds; single characters without bounds."""
    if order == 1:
        return list(word)
    bounded = f"<{word}>"
    return [bounded[i:i + order] for i in range(len(bounded) - order + 1)]


@dataclass
class Model:
    """Languages and, for words (order 0) and each n-gram order, rows of centred log frequencies."""

    languages: list[str]
    index: dict[int, dict[str, int]]
    rows: np.ndarray

    def word(self, word: str) -> np.ndarray:
        """How much a word speaks for each language."""
        known = self.index[0].get(word)
        if known is not None:
            return self.rows[known]
        for order in ORDERS:
            table = self.index[order]
            found = [n for n in map(table.get, grams(word, order)) if n is not None]
            if found:
                return self.rows[found].mean(axis=0)
        return np.zeros(len(self.languages), np.float32)


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, doc_id: str = "doc_id", text: str = "text",
           lang: str = "lang") -> DataFrame:
    """At most ``per_language`` documents of each language to learn from, picked by a hash of their id.

    Only different ids are ranked; the texts of the few chosen ones follow by a
    join. A repeated row counts once; of several texts under one id and language
    the one of the smallest hash is taken.
    """
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(doc_id)).select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
        F.col(lang).cast("string").alias("lang"))
    chosen = bounded_sample(usable.select("doc_id", "lang").distinct(), "lang", "doc_id", per_language)
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")
    return usable.join(chosen, ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(one).select("one.text", "lang")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """The model of a sample of ``docs``, whose size bounds it. Without rows to learn from it has no languages.

    A word or n-gram with fewer than ``LEAST_SEEN`` occurrences in the sample of
    a language is unseen there: it takes the language's floor, and one unseen
    everywhere is left to shorter n-grams.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            counts: dict[str, Counter] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(text.lower().split())
            rows: Counter = Counter()
            for lang, tokens in counts.items():
                for token, n in tokens.items():
                    word = letters(token)
                    if word:
                        rows[lang, 0, word] += n
                        for order in ORDERS:
                            for gram in grams(word, order):
                                rows[lang, order, gram] += n
            if rows:
                langs, orders, keys = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(langs, pa.string()), pa.array(orders, pa.int32()), pa.array(keys, pa.string()),
                     pa.array(list(rows.values()), pa.int64())], ["lang", "order", "gram", "n"])

    counts = (sample(docs, per_language).mapInArrow(counted, "lang string, order int, gram string, n long")
              .groupBy("lang", "order", "gram").agg(F.sum("n").alias("n")))
    kept = (counts.withColumn("total", F.sum("n").over(Window.partitionBy("lang", "order")))
            .where(F.col("n") >= LEAST_SEEN).select("lang", "order", "gram", "n", "total"))
    # words and n-grams of ``per_language`` texts of each language at most
    table = kept.toPandas().sort_values(["order", "gram", "lang"])
    languages = sorted(table["lang"].unique().tolist())
    index: dict[int, dict[str, int]] = {order: {} for order in (0, *ORDERS)}
    blocks, base = [], 0
    for order, part in table.groupby("order"):
        names = index[int(order)]
        for gram in part["gram"]:
            names.setdefault(gram, base + len(names))
        totals = part.groupby("lang")["total"].first()
        floor = np.array([np.log(0.5 / (float(totals.get(lang, 1)) + 1.0)) for lang in languages])
        block = np.tile(floor, (len(names), 1))
        places = np.array([names[g] - base for g in part["gram"]])
        which = np.array([languages.index(lang) for lang in part["lang"]])
        block[places, which] = np.log(part["n"].to_numpy() / (part["total"].to_numpy() + 1.0))
        blocks.append(block - block.mean(axis=1, keepdims=True))
        base += len(names)
    rows = np.concatenate(blocks).astype(np.float32) if blocks else np.zeros((0, 0), np.float32)
    return Model(languages, index, rows)


class _Scorer:
    """Remembers what tokens say."""

    def __init__(self, model: Model):
        self.model, self.places, self.rows = model, {}, [np.zeros(len(model.languages), np.float32)]

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        model = self.model
        if not model.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        if len(self.places) > REMEMBERED:
            self.places, self.rows = {}, self.rows[:1]
        tokens = [t.lower().split() if t else [] for t in texts]
        places = self.places
        for token in {w for words in tokens for w in words if w not in places}:
            word = letters(token)
            if word:
                places[token] = len(self.rows)
                self.rows.append(model.word(word))
            else:
                places[token] = 0
        table = np.array(self.rows)
        out = []
        for words in tokens:
            at = np.array([places[w] for w in words], dtype=np.int64)
            at = at[at > 0]
            if not len(at):
                out.append((UNKNOWN, 0.0))
                continue
            total = table[at].mean(axis=0, dtype=np.float64) * min(len(at), SETTLED_WORDS)
            share = np.exp(total - total.max())
            best = int(np.argmax(share))
            out.append((model.languages[best], float(share[best] / share.sum())))
        return out


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row (all columns of ``docs``), lang_pred and score of every document.

    NULL texts and texts without a letter are ``und`` with score 0. Equal texts
    are predicted alike; among languages that tie the first by name wins. Texts
    are taken whole, whatever their length; repeated rows come back as often, an
    empty table gives no rows, and further columns stay in ``row``, whatever
    their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample, see ``fit``
    carried = with_row(docs, doc_id, text)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in by_bytes(batches, "text"):
            found = scorer(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())], ["doc_id", "row", "lang_pred", "score"])

    row = carried.schema["row"].dataType.simpleString()
    return carried.mapInArrow(predicted, f"doc_id long, row {row}, lang_pred string, score double")
