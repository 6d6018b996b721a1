"""Cross-entropy difference of a target and a background language model.

Both are bigram models over one vocabulary, interpolated with unigrams in the
same way and smoothed alike; a document's score is the mean over its words of
target loss minus background loss, so low scores look like the target.

A document never speaks for itself: what it has put into either model is taken
out again while it is scored, so members of the target gain nothing by that.

Every word and bigram of all documents is counted by itself, and what is
gathered grows with the input. A word stands before another as often as it is
not the last one of a text, so contexts need no counts of their own. Texts are written once as blocks of word
numbers. A block asks for the counts of its own distinct words and bigrams: its
keys go, packed and in order, to the bucket of their range, where the counts of
all blocks are added up; back come, in the same order, the counts that all
other blocks have. Most bigrams are in one document only, so most of these are
zero and take no room.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from fluxframe.llm.common import ASCII_LOWER, by_bytes, documents
from fluxframe.llm.shingles import mixed
from fluxframe.session import settle

#: Weight of the bigram estimate.
BIGRAM = 0.6
#: Added to every unigram count.
SMOOTHING = 0.5
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK = 4 << 20
#: Texts in a block, where they are short.
ROWS = 50_000
#: Words whose keys are counted in one bucket, on average.
HELD = 1 << 20
#: Bytes of ``low``, a key's second hash; its lowest bit is 1 for bigrams.
LOW = 3


def lower_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as planes of their bytes, compressed; planes of zeros take no room."""
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(packed: bytes, count: int, *kinds: type) -> list[np.ndarray]:
    planes, out, start = zstandard.ZstdDecompressor().decompress(packed), [], 0
    for kind in kinds:
        width = np.dtype(kind).itemsize
        part = np.frombuffer(planes, np.uint8, width * count, start).reshape(width, count)
        out.append(np.ascontiguousarray(part.T).reshape(-1).view(kind))
        start += width * count
    return out


def text_blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """Texts as numbers of their words: block, ids, lengths, distinct words, and two packed columns.

    ``numbers`` are the words of all texts, one after another, ``words`` the
    distinct words in the order of their numbers.
    """
    def block(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        table: dict[bytes, int] = {}
        numbers = np.array([table.setdefault(w, len(table)) for words in texts for w in words], np.uint32)
        words = zstandard.ZstdCompressor(level=3).compress(b" ".join(table))  # a word holds no blank
        return pa.RecordBatch.from_arrays(
            [pa.array([uuid.uuid4().hex]), pa.array([ids], pa.list_(pa.int64())),
             pa.array([list(map(len, texts))], pa.list_(pa.int64())), pa.array([len(table)], pa.int64()),
             pa.array([pack(numbers)], pa.binary()), pa.array([words], pa.binary())],
            ["block", "ids", "lengths", "distinct", "numbers", "words"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in by_bytes(batches, "text", size // 4):
            own = batch.column("text")
            if ids and (held + own.nbytes > size or len(ids) + len(own) > ROWS):
                yield block(ids, texts)
                ids, texts, held = [], [], 0
            ids += batch.column("doc_id").to_pylist()
            texts += map(lower_words, own.to_pylist())
            held += own.nbytes
        if ids:
            yield block(ids, texts)

    return docs.mapInArrow(
        cut, "block string, ids array<long>, lengths array<long>, distinct long, numbers binary, words binary")


class Keys:
    """The distinct words and bigrams of a block, and where each occurrence finds its own.

    Keys are 87 bits of hashes and one bit that tells bigrams from words:
    ``high`` and ``low``, in the order of ``high``.
    """

    def __init__(self, row: dict):
        lengths = np.array(row["lengths"], np.int64)
        (numbers,) = unpack(row["numbers"], int(lengths.sum()), np.uint32)
        size = row["distinct"]
        names = zstandard.ZstdDecompressor().decompress(row["words"]).split(b" ") if size else []
        # nothing stands before the first word of a text; that place has a number and a hash of its own
        hashes = np.frombuffer(b"".join([*map(xxhash.xxh3_128_digest, names), bytes(16)]), ">u8").astype(np.uint64)
        words = numbers.astype(np.int64)
        before = np.concatenate([[size], words[:-1]])[:len(words)]
        self.first, self.last = np.zeros((2, len(words)), bool)
        ends = np.cumsum(lengths)[lengths > 0]
        self.first[ends - lengths[lengths > 0]] = True
        self.last[ends - 1] = True
        before[self.first] = size
        pairs, at = np.unique(before * (size + 1) + words, return_inverse=True)
        first, second = np.divmod(pairs, size + 1)
        odd = np.uint64(0x9E3779B97F4A7C15)
        high, low = (np.concatenate([mixed(mixed(h[first] ^ odd) + h[second] * odd), h[:size]])
                     for h in hashes.reshape(-1, 2).T)
        low = ((low >> np.uint64(64 - 8 * LOW)) & ~np.uint64(1)).astype(np.uint32)
        low[:len(pairs)] |= np.uint32(1)
        order = np.argsort(high, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.lengths, self.text = lengths, np.repeat(np.arange(len(lengths)), lengths)
        self.high, self.low = high[order], low[order]
        #: Of every occurrence of a word: place of its bigram and of itself; number of the word before it.
        self.pair, self.word, self.before = place[at], place[len(pairs) + words], before
        #: Place of the word before it; of no use where there is none.
        self.context = np.where(self.first, 0, np.concatenate([[0], self.word[:-1]])[:len(words)])

    def counts(self, hits: np.ndarray) -> np.ndarray:
        """How often each key occurs in all texts of the block and in those of the target; then as their last word."""
        def often(places):
            return np.bincount(places, minlength=len(self.high))
        inside = hits[self.text]
        return np.stack([often(self.pair) + often(self.word), often(self.pair[inside]) + often(self.word[inside]),
                         often(self.word[self.last]), often(self.word[self.last & inside])])

    def bounds(self, buckets: int) -> np.ndarray:
        """Where the keys of each bucket start; buckets are equal ranges of ``high``."""
        dealt = ((self.high >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        return np.searchsorted(dealt, np.arange(buckets + 1))


def flags(row: dict) -> np.ndarray:
    found = np.zeros(len(row["lengths"]), bool)
    found[row["hits"] or []] = True
    return found


def asked(blocks: DataFrame, buckets: int) -> DataFrame:
    """The keys and counts of each block, a row for every bucket they go to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for at in range(batch.num_rows) for r in batch.slice(at, 1).to_pylist()):
                keys = Keys(row)
                counts = keys.counts(flags(row)).astype(np.uint32)
                bounds = keys.bounds(buckets)
                used = np.flatnonzero(np.diff(bounds))
                parts = [slice(bounds[b], bounds[b + 1]) for b in used]
                packed = [pack(np.diff(keys.high[p], prepend=np.uint64(0)), keys.low[p], *counts[:, p]) for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used, pa.int32()), pa.array([row["block"]] * len(used), pa.string()),
                     pa.array([p.stop - p.start for p in parts], pa.int64()), pa.array(packed, pa.binary())],
                    ["bucket", "block", "n", "packed"])

    return blocks.mapInArrow(run, "bucket int, block string, n long, packed binary")


def answered(requests: DataFrame) -> DataFrame:
    """For the keys of each request, in their order, what all other blocks have; and how many words are new here."""
    def run(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_pylist()
        parts = [unpack(p, n, np.uint64, *[np.uint32] * 5)
                 for p, n in zip(table.column("packed").to_pylist(), sizes, strict=True)]
        high = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        low, *own = (np.concatenate([p[k] for p in parts]) for k in range(1, 6))
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        new = np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
        starts, group = np.flatnonzero(new), np.cumsum(new) - 1
        others = []
        for counts in own:
            counts = counts[order].astype(np.int64)
            left = np.empty(len(order), np.int64)
            left[order] = np.add.reduceat(counts, starts)[group] - counts
            others.append(left)
        ends = np.cumsum(sizes)
        packed = [pack(*(o[e - n:e] for o in others)) for n, e in zip(sizes, ends, strict=True)]
        words = np.zeros(len(sizes), np.int64)
        words[0] = (low[starts] & 1 == 0).sum()
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "n": table.column("n"),
                         "packed": pa.array(packed, pa.binary()), "words": pa.array(words)})

    return requests.groupBy("bucket").applyInArrow(
        run, "block string, bucket int, n long, packed binary, words long")


def own_counts(text: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
    """For every occurrence, how often its text holds the same key."""
    _, at, often = np.unique(text * size + place, return_inverse=True, return_counts=True)
    return often[at]


def scored(blocks: DataFrame, answers: DataFrame, totals: Sequence[int], texts: Sequence[int],
           words: int) -> DataFrame:
    """doc_id, n_tokens and the losses of every text.

    ``totals`` are the words, ``texts`` the texts with a word, each of the background and of the target.
    """
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {name: [] for name in ("doc_id", "n_tokens", "target_loss", "background_loss")}
        for row in left.to_pylist():
            keys, hits = Keys(row), flags(row)
            replies = sorted(zip(*(right.column(c).to_pylist() for c in ("bucket", "n", "packed")), strict=True))
            others = [unpack(packed, n, *[np.int64] * 4) for _, n, packed in replies]
            every = keys.counts(hits)
            if others:
                every = every + np.stack([np.concatenate(parts) for parts in zip(*others, strict=True)])
            own_pairs, own_words = (own_counts(keys.text, p, len(keys.high)) for p in (keys.pair, keys.word))
            own_contexts = own_counts(keys.text, keys.before, row["distinct"] + 1)
            length, losses = keys.lengths[keys.text], []
            for k, own in ((1, hits[keys.text].astype(np.int64)), (0, 1)):
                alone = ((every[k][keys.word] - own * own_words + SMOOTHING)
                         / (totals[k] - own * length + SMOOTHING * words))
                seen = np.where(keys.first, texts[k], (every[k] - every[2 + k])[keys.context]) - own * own_contexts
                follows = (every[k][keys.pair] - own * own_pairs) / np.maximum(seen, 1)
                each = -np.log(np.where(seen > 0, BIGRAM * follows + (1 - BIGRAM) * alone, alone))
                losses.append(np.bincount(keys.text, each, len(hits)) / np.maximum(keys.lengths, 1))
            none = keys.lengths == 0
            out["doc_id"].append(pa.array(row["ids"], pa.int64()))
            out["n_tokens"].append(pa.array(keys.lengths))
            for name, loss in zip(("target_loss", "background_loss"), losses, strict=True):
                out[name].append(pa.array(loss.astype(np.float64), mask=none))
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table({name: pa.chunked_array(parts, kind)
                         for (name, parts), kind in zip(out.items(), kinds, strict=True)})

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        run, "doc_id long, n_tokens long, target_loss double, background_loss double")


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, held: int = HELD, block: int = BLOCK) -> DataFrame:
    """Score ``docs`` against the model of those whose doc_id is in ``targets``.

    doc_id, n_tokens, target_loss, background_loss and their difference ``score``
    for every document. Repeated target ids count once, ids without a document
    not at all; a row without an id is in the background only. Texts without a
    word have no losses and no score. Equal texts with equal flags score alike;
    an empty table gives no rows. ``held`` and ``block`` bound what a task holds
    and change no result.
    """
    blocks = settle(text_blocks(documents(docs), block))
    marked = targets.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct()
    rows = blocks.select("block", F.posexplode(F.arrays_zip("ids", "lengths")).alias("at", "row"))
    rows = rows.select("block", "at", F.col("row.ids").alias("doc_id"), F.col("row.lengths").alias("length"))
    # both sides are shuffled at every size, since targets have no bound
    size = [F.sum("length").alias("words"), F.count(F.when(F.col("length") > 0, True)).alias("texts")]
    hits = settle(rows.join(marked.hint("merge"), "doc_id", "left_semi").groupBy("block").agg(
        F.collect_list("at").alias("hits"), *size))
    every = rows.agg(*size).first()
    within = hits.agg(F.sum("words").alias("words"), F.sum("texts").alias("texts")).first()
    totals, texts = ([every[c] or 0, within[c] or 0] for c in ("words", "texts"))
    flagged = blocks.join(hits.select("block", "hits"), "block", "left")
    answers = settle(answered(asked(flagged, max(1, -(-totals[0] // held)))))
    words = answers.agg(F.sum("words")).first()[0] or 0
    found = scored(flagged, answers.drop("words"), totals, texts, words)
    return found.withColumn("score", F.col("target_loss") - F.col("background_loss"))
