"""Order-preserving packing by dynamic programming over document and sentence ends.

Documents stay in the order of the table. Their tokens, one after another, are
cut into windows of at most ``window`` tokens. A window may end after a document
(no penalty) or after a sentence (``sentence_penalty``); a sentence of more than
``long_sentence`` tokens may be cut at any of them (``hard_penalty``). The cuts minimise

    sum over windows of (window - length) + penalty of its end.

With positions p_0 < p_1 < ... and best costs f, the transition is
``f_j = window - p_j + penalty_j + min(f_i + p_i)`` over ``p_i >= p_j - window``:
a sliding minimum, kept in a monotone queue, so the work is linear.

Each task streams its own rows: no shuffle, and only a stretch of tokens is held.
The last window of a stretch is carried into the next, so stretches leave no
padding behind; a task leaves at most one short window.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fluxframe.llm.common import by_bytes, documents

WINDOW = 1024
SENTENCE_PENALTY = 4
HARD_PENALTY = 24
LONG_SENTENCE = 64
#: Tokens planned at once; bounds memory, not results beyond the next cut.
STRETCH = 1 << 18

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def vocabulary(file: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Bytes of every token of a byte-level BPE file, and its special tokens.

    In such files ids follow the merge ranks, so ids serve as ranks.
    """
    with open(file, encoding="utf-8") as f:
        whole = json.load(f)
    # printable characters stand for themselves, the others for 256, 257, ...
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}
    special = {t["content"]: t["id"] for t in whole["added_tokens"]}
    return {bytes(byte[c] for c in t): n for t, n in whole["model"]["vocab"].items() if t not in special}, special


def encoder(file: str, pattern: str):
    """A function from text to ids, and a table of which ids end a sentence."""
    import tiktoken

    ranks, special = vocabulary(file)
    coder = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    ends = np.zeros(max([*ranks.values(), *special.values()]) + 1, bool)
    for token, n in ranks.items():
        ends[n] = token.rstrip(b"\"')]")[-1:] in (b".", b"!", b"?", b"\n")

    def encode(text: str) -> np.ndarray:
        return np.asarray(coder.encode_to_numpy(text, allowed_special="all"), dtype=np.uint32)
    return encode, ends


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, window: int = WINDOW,
               sentence_penalty: int = SENTENCE_PENALTY, hard_penalty: int = HARD_PENALTY,
               long_sentence: int = LONG_SENTENCE) -> list[int]:
    """The cheapest window ends over ``ids``; ``doc_ends`` are the positions after documents."""
    n = len(ids)
    penalty = np.full(n + 1, -1, np.int64)
    penalty[1:][sentence_end[ids]] = sentence_penalty
    penalty[doc_ends] = 0
    allowed = np.flatnonzero(penalty[1:] >= 0) + 1
    edges = np.concatenate([[0], allowed, [n]])
    for left in np.flatnonzero(np.diff(edges) > min(window, long_sentence)):
        inside = penalty[edges[left] + 1:edges[left + 1]]
        inside[inside < 0] = hard_penalty
    penalty[n] = max(penalty[n], 0)
    positions = np.concatenate([[0], np.flatnonzero(penalty[1:] >= 0) + 1])

    return _cheapest(positions.tolist(), penalty[positions].tolist(), window)


def _cheapest(positions: list[int], penalties: list[int], window: int) -> list[int]:
    """Window ends of least cost; among equals the earliest start, hence the longest window."""
    origin = [0] * len(positions)
    queue = deque([(0, 0, 0)])  # (f_i + p_i, p_i, i), values rising
    for j in range(1, len(positions)):
        p = positions[j]
        while queue[0][1] < p - window:
            queue.popleft()
        best, _, origin[j] = queue[0]
        value = best + window + penalties[j]
        while queue and queue[-1][0] > value:
            queue.pop()
        queue.append((value, p, j))
    cuts, j = [], len(positions) - 1
    while j > 0:
        cuts.append(positions[j])
        j = origin[j]
    return cuts[::-1]


class _Stretch:
    """Documents, or what is left of them, waiting to be cut into windows."""

    def __init__(self):
        self.parts: list[tuple] = []  # doc_id, place of the first token in the document, ids, tokens of the document
        self.size = 0

    def add(self, part: tuple):
        self.parts.append(part)
        self.size += len(part[2])

    def take(self, count: int, number: int, rows: list[tuple]):
        """Move the next ``count`` tokens to sequence ``number``, one row per document touched."""
        offset, used = 0, 0
        while offset < count:
            doc, first, ids, total = self.parts[used]
            piece = ids[:count - offset]
            rows.append((doc, first, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), total, number, offset))
            offset += len(piece)
            if len(piece) == len(ids):
                used += 1
            else:
                self.parts[used] = (doc, first + len(piece), ids[len(piece):], total)
        del self.parts[:used]
        self.size -= count

    def pack(self, ends: np.ndarray, last: bool, options: tuple[int, ...], number: int):
        """Rows of all windows but the last one, which stays here unless ``last``."""
        cuts = cut_points(np.concatenate([p[2] for p in self.parts]), np.cumsum([len(p[2]) for p in self.parts]),
                          ends, *options)
        rows: list[tuple] = []
        lengths = np.diff([0, *cuts]).tolist()
        for length in lengths if last else lengths[:-1]:
            self.take(length, number, rows)
            number += 1
        return rows, number


def pack(docs: DataFrame, file: str, pattern: str, window: int = WINDOW, sentence_penalty: int = SENTENCE_PENALTY,
         hard_penalty: int = HARD_PENALTY, long_sentence: int = LONG_SENTENCE, separator: int = 0,
         stretch: int = STRETCH) -> DataFrame:
    """Pieces of documents, with the sequence each lies in and the place there.

    A document is its tokens followed by ``separator``; a NULL or empty text is
    the separator alone. Every token lies in exactly one piece. Sequence numbers
    are unique over the table, gapless within a partition. Equal documents are
    packed one by one; a NULL doc_id stays NULL. An empty table gives no rows.
    """
    options = (window, sentence_penalty, hard_penalty, long_sentence)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ends = encoder(file, pattern)
        number = TaskContext.get().partitionId() << 33
        waiting = _Stretch()
        for batch in by_bytes(batches, "text", 1 << 20):
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(separator))
                waiting.add((doc, 0, ids, len(ids)))
                if waiting.size >= stretch:
                    rows, number = waiting.pack(ends, False, options, number)
                    out += rows
            if out:
                yield _batch(out)
        if waiting.parts:
            yield _batch(waiting.pack(ends, True, options, number)[0])

    return documents(docs).mapInArrow(packed, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
