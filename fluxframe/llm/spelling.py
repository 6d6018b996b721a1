"""Spelling variants: words one edit apart, found by a bit-sliced position index.

An index holds, for each position and letter, the set of its words with that
letter at that position, as bits of one whole number. A word is looked up by
going through its letters once. Recurrences over all indexed words at a time
keep the set without an error so far and the sets with one: replaced (letters
still in step), longer (the indexed word is one position ahead) and shorter
(one position behind).

Two words one edit apart share their first or their last half: of lengths m and
m or m + 1, the m // 2 letters in front of the edit or behind it. Words are
dealt out by both halves, so any two such words meet. A bucket of many words is
cut into parts, and every part is looked up in every part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from fluxframe.llm.common import ASCII_LOWER, by_bytes, documents, runs, tasks
from fluxframe.session import settle

#: Runs of A-Z, a-z and U+00C0 to U+00FF in UTF-8, where \xc3 only ever begins one of the latter.
RUN = re.compile(rb"(?:[a-z]+|(?:\xc3[\x80-\xbf])+)+")
#: One in so many runs loses a letter, by the hash of document and run.
ONE_IN = 199
#: Code points of a word and its occurrences, at least; a form occurs so many times as often.
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: Words of a bucket that are indexed at once.
BLOCK = 1 << 14
#: Different words a task counts before it passes them on.
HELD = 400_000


def slipped(run: bytes, hashed: int) -> bytes:
    """The run without the code point its hash chooses."""
    text = run.decode()
    at = hashed % len(text)
    return (text[:at] + text[at + 1:]).encode()


def count_words(docs: DataFrame, length: int = LEAST_LENGTH, least: int = LEAST_COUNT) -> DataFrame:
    """word and n of the words that are long and frequent enough; counted in the map tasks first."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def out():
            words = pa.array([w.decode() for w in total], pa.string())
            batch = pa.RecordBatch.from_arrays([words, pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return batch.filter(pc.and_(pc.greater_equal(pc.utf8_length(words), length), pc.greater(batch.column(1), 0)))

        for batch in by_bytes(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = RUN.findall((text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER))
                total.update(found)
                start, crc = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), zlib.crc32
                for run in [w for w in set(found) if not crc(w, start) % ONE_IN]:
                    often = found.count(run)
                    total[run] -= often
                    total[slipped(run, crc(run, start))] += often
            if len(total) > HELD:
                yield out()
        if total:
            yield out()

    return (documents(docs).mapInArrow(counted, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least))


class SlicedIndex:
    """Words as bits: one whole number for each position and letter, and for each length."""

    def __init__(self, words: list[str]):
        size = (len(words) + 7) // 8
        bits: dict[tuple[int, str], bytearray] = {}
        lengths: dict[int, bytearray] = {}
        for place, word in enumerate(words):
            byte, bit = place >> 3, 1 << (place & 7)
            for key in enumerate(word):
                bits.setdefault(key, bytearray(size))[byte] |= bit
            lengths.setdefault(len(word), bytearray(size))[byte] |= bit
        self.all = (1 << len(words)) - 1
        self.bits = {k: int.from_bytes(v, "little") for k, v in bits.items()}
        self.lengths = {k: int.from_bytes(v, "little") for k, v in lengths.items()}

    def near(self, word: str, half: int = 0) -> tuple[int, int, int, int]:
        """Words one edit from ``word``: replaced, one letter longer, one shorter; and those with its first ``half`` letters."""
        at, same = self.bits.get, self.all
        replaced = longer = shorter = 0
        begun = same if half == 0 else 0
        for place, letter in enumerate(word):
            here, ahead = at((place, letter), 0), at((place + 1, letter), 0)
            hit = same & here
            replaced = replaced & here | same ^ hit
            longer = (longer | same) & ahead
            shorter = shorter & at((place - 1, letter), 0) | same
            same = hit
            if place + 1 == half:
                begun = same
        size, of = len(word), self.lengths.get
        return replaced & of(size, 0), (longer | same) & of(size + 1, 0), shorter & of(size - 1, 0), begun


def places(bits: int) -> list[int]:
    """Where the bits are."""
    out = []
    while bits:
        low = bits & -bits
        out.append(low.bit_length() - 1)
        bits ^= low
    return out


#: Which words of a bucket are looked up, and in which of them.
BOTH, INDEXED, ASKED = 0, 1, 2


def bucketed(words: DataFrame, length: int = LEAST_LENGTH, limit: int = BLOCK) -> DataFrame:
    """word, n, shorter, behind, role and bucket: each word by both halves, as the shorter and as the longer of two.

    ``shorter`` is the length of the shorter word, ``behind`` says that the last halves agree.
    """
    size = F.length("word")
    kinds = F.inline(F.transform(
        F.filter(F.array(size, size - 1), lambda s: s >= length),
        lambda s: F.struct(s.alias("shorter"), F.expr("word").substr(F.lit(1), F.floor(s / 2).cast("int")).alias("front"),
                           F.expr("word").substr(size - F.floor(s / 2).cast("int") + 1, size).alias("back"))))
    sides = F.inline(F.array(F.struct(F.lit(False).alias("behind"), F.col("front").alias("half")),
                             F.struct(F.lit(True).alias("behind"), F.col("back").alias("half"))))
    met = words.select("word", "n", kinds).select("word", "n", "shorter", sides)
    # written, so that the join with it can split a bucket that holds most of the words
    sizes = settle(met.groupBy("shorter", "behind", "half").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select(
        "shorter", "behind", "half", F.ceil(F.col("many") / F.lit(limit)).cast("int").alias("k")))
    k, part = F.col("k"), F.pmod(F.xxhash64("word"), F.col("k")).cast("int")
    meets = F.when(k == 1, F.array(F.struct(F.lit(0).alias("block"), F.lit(BOTH).alias("role")))).otherwise(F.concat(
        F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.struct((part * k + j).alias("block"), F.lit(INDEXED).alias("role"))),
        F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.struct((i * k + part).alias("block"), F.lit(ASKED).alias("role")))))
    return (met.join(sizes, ["shorter", "behind", "half"]).select("word", "n", "shorter", "behind", "half", F.inline(meets))
            .select("word", "n", "shorter", "behind", "role",
                    F.concat_ws(":", "shorter", "behind", "half", "block").alias("bucket")))


def neighbours(words: DataFrame, length: int = LEAST_LENGTH, limit: int = BLOCK) -> DataFrame:
    """word, n_near and best (n and word of the near word that is the most frequent); words without a near one are missing.

    A bucket passes on one row per word, not its pairs. Two words that share
    both halves are counted where the first halves meet.
    """
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, int, int, str]] = []
        for table in runs(batches, "bucket"):
            own, counts = table.column("word").to_pylist(), table.column("n").to_pylist()
            roles = table.column("role").to_pylist()
            shorter, behind = table.column("shorter")[0].as_py(), table.column("behind")[0].as_py()
            kept = [p for p, role in enumerate(roles) if role != ASKED]
            index = SlicedIndex([own[p] for p in kept])
            for word, role in zip(own, roles, strict=True):
                if role == INDEXED:
                    continue
                replaced, longer, less, begun = index.near(word, shorter // 2)
                near = replaced | longer if len(word) == shorter else less
                if behind:
                    near &= ~begun
                if near:
                    at = [kept[p] for p in places(near)]
                    most = max(counts[p] for p in at)
                    out.append((word, len(at), most, min(own[p] for p in at if counts[p] == most)))
            if len(out) > 50_000:
                yield packed(out)
                out = []
        if out:
            yield packed(out)

    def packed(out):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True),
                                            (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)],
            ["word", "near", "form_n", "form"])

    met = bucketed(words, length, limit)
    parts = (met.repartition(tasks(met), "bucket").sortWithinPartitions("bucket")
             .mapInArrow(found, "word string, near long, form_n long, form string"))
    return parts.groupBy("word").agg(F.sum("near").alias("n_near"),
                                     F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root: the end of each chain of forms, found by doubling the steps.

    Each form is several times as frequent as its word, so chains are short.
    """
    steps = settle(forms.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = settle(steps.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        steps = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return steps


def variants(docs: DataFrame, length: int = LEAST_LENGTH, least: int = LEAST_COUNT, times: int = TIMES,
             limit: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the vocabulary.

    NULL, empty and blank texts have no words; texts are taken whole, whatever
    their length, and repeated rows count again. A NULL doc_id is hashed as the
    empty text. Of near words equally frequent the first in code-point order is
    the form. An empty table gives no rows; further columns are ignored,
    whatever their names.
    """
    words = settle(count_words(docs, length, least))
    near = neighbours(words, length, limit)
    form_n = -F.col("best.less")
    formed = settle(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(form_n >= times * F.col("n"), F.col("best.form")).alias("form"),
        F.when(form_n >= times * F.col("n"), form_n).alias("form_n")))
    return formed.join(roots(formed), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
