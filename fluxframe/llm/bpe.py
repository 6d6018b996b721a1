"""BPE encoding with an index of pair occurrences, and decoding.

A task collects the distinct words of a stretch of its rows, lays their symbols
out in one array and indexes every adjacent pair that has a merge rank by all
its positions. Active ranks are applied in ascending order, each to all its
positions from left to right; a merge changes only the pairs beside it, and only
their lists are updated. Every distinct word is merged once, however often it
occurs. Rows stay where they are: no shuffle.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fluxframe.llm.common import by_bytes, documents

#: Words a task remembers between stretches; only speed depends on it.
REMEMBERED = 200_000
STRETCH_BYTES = 4 << 20
#: Up to here Python and the tokenizer's own code agree on case and composition.
LATIN_END = 0x24F


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """A BPE file with byte-level symbols and a suffix at the end of words."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        ids, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.tokens = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, n in [*ids.items(), *self.special.items()]:
            self.tokens[n] = token
        self.inner = np.array([ids[c] for c in byte_symbols()])
        self.final = np.array([ids[c + suffix] for c in byte_symbols()])
        self.bits = (len(self.tokens) - 1).bit_length()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.left = [ids[a] for a, _ in pairs]
        self.right = [ids[b] for _, b in pairs]
        self.merged = [ids[a + b] for a, b in pairs]
        self.rank = {a << self.bits | b: r for r, (a, b) in enumerate(zip(self.left, self.right, strict=True))}
        keys = np.array(sorted(self.rank), dtype=np.int64)
        self.sorted_keys, self.sorted_ranks = keys, np.array([self.rank[k] for k in keys.tolist()])


def merge_words(vocabulary: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one array, and where each word ends in it. No word is empty."""
    v = vocabulary
    raw = np.frombuffer(b"".join(words), dtype=np.uint8)
    stops = np.cumsum([len(w) for w in words])
    starts = np.concatenate([[0], stops[:-1]])
    symbols = v.inner[raw]
    symbols[stops - 1] = v.final[raw[stops - 1]]

    after = np.arange(1, len(raw) + 1)
    after[stops - 1] = -1
    before = np.arange(-1, len(raw) - 1)
    before[starts] = -1
    # the index of pair occurrences: rank -> positions of the left symbol
    lefts = np.flatnonzero(after >= 0)
    keys = symbols[lefts].astype(np.int64) << v.bits | symbols[lefts + 1]
    found = np.minimum(np.searchsorted(v.sorted_keys, keys), len(v.sorted_keys) - 1)
    hit = v.sorted_keys[found] == keys
    lefts, ranks = lefts[hit], v.sorted_ranks[found[hit]]
    order = np.argsort(ranks, kind="stable")
    lefts, ranks = lefts[order], ranks[order]
    edges = [*np.flatnonzero(np.diff(ranks, prepend=-1)).tolist(), len(ranks)]
    index = {int(ranks[e]): lefts[e:f].tolist() for e, f in zip(edges[:-1], edges[1:], strict=True)}

    _apply(v, symbols := symbols.tolist(), after.tolist(), before.tolist(), index)
    left = np.array(symbols)
    alive = left >= 0
    return left[alive], np.cumsum(np.add.reduceat(alive, starts))


def _apply(v: Vocabulary, symbols: list[int], after: list[int], before: list[int], index: dict[int, list[int]]):
    """Merge in place; a position that was merged away holds -1."""
    rank_of, bits, heap = v.rank.get, v.bits, list(index)
    heapq.heapify(heap)
    push, pop, lists = heapq.heappush, heapq.heappop, index.get
    while heap:
        rank = pop(heap)
        a, b, c = v.left[rank], v.right[rank], v.merged[rank]
        shifted = c << bits
        positions = index.pop(rank)
        positions.sort()
        for p in positions:
            if symbols[p] != a:
                continue  # an earlier merge took it
            q = after[p]
            if q < 0 or symbols[q] != b:
                continue
            symbols[p], symbols[q] = c, -1
            after[p] = n = after[q]
            if n >= 0:
                before[n] = p
                new = rank_of(shifted | symbols[n])
                if new is not None:
                    own = lists(new)
                    if own is None:
                        index[new] = [p]
                        push(heap, new)
                    else:
                        own.append(p)
            m = before[p]
            if m >= 0:
                new = rank_of(symbols[m] << bits | c)
                if new is not None:
                    own = lists(new)
                    if own is None:
                        index[new] = [m]
                        push(heap, new)
                    else:
                        own.append(m)


class _Words(dict):
    """Word -> place, with the words that are new since the last merge."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        self.fresh.append(word)
        return place


class Encoder:
    """Texts to ids. Words are merged once as long as they are remembered."""

    def __init__(self, file: str):
        self.vocabulary = Vocabulary(file)
        self.split = Splitter(file, self.vocabulary.special)
        self._forget()

    def _forget(self):
        self.words, self.ids, self.starts = _Words(), np.empty(0, np.uint32), np.zeros(1, np.int64)
        special = self.vocabulary.special
        if special:
            for token in special:
                self.words["\n" + token] = len(self.words)
            self.ids = np.array(list(special.values()), np.uint32)
            self.starts = np.arange(len(special) + 1)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.words) > REMEMBERED:
            self._forget()
        look_up = self.words.__getitem__
        places = []
        for text in texts:
            words = self.split(text) if text else []
            places.append(np.fromiter(map(look_up, words), np.int64, len(words)))
        if self.words.fresh:
            ids, stops = merge_words(self.vocabulary, [w.encode() for w in self.words.fresh])
            self.starts = np.concatenate([self.starts, self.starts[-1] + stops])
            self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
            self.words.fresh = []
        starts, sizes, flat = self.starts, np.diff(self.starts), self.ids
        out = []
        for own in places:
            lengths = sizes[own]
            ends = np.cumsum(lengths)
            total = int(ends[-1]) if len(ends) else 0
            out.append(flat[np.repeat(starts[own] - ends + lengths, lengths) + np.arange(total)])
        return out


class Splitter:
    """Texts to words, as the tokenizer file's normaliser and pattern say.

    Text of Latin letters is normalised and split here; where other characters
    occur, the tokenizers library's own normaliser and splitter are asked, whose
    Unicode tables may differ from Python's.
    """

    def __init__(self, file: str, special: Iterable[str]):
        import regex
        from tokenizers import Tokenizer

        with open(file, encoding="utf-8") as f:
            whole = json.load(f)
        pattern = whole["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(pattern).findall
        # among ASCII characters these are all letters and numbers
        self.find_ascii = re.compile(pattern.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9"), re.ASCII).findall
        self.beyond = re.compile(f"[^\\x00-{chr(LATIN_END)}]").search
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")").split
        self.special = set(special)
        self.library = Tokenizer.from_file(file)
        self.byte = {c: b for b, c in enumerate(byte_symbols())}

    def __call__(self, text: str) -> list[str]:
        """Words in order; special tokens come as a line feed and their name, which no word can be."""
        if "<|" not in text:
            return self._plain(text)
        out = []
        for part in self.apart(text):
            if part in self.special:
                out.append("\n" + part)
            elif part:
                out += self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.find_ascii(text.lower())
        if not self.beyond(text):
            return self.find(unicodedata.normalize("NFC", text).lower())
        normal = self.library.normalizer.normalize_str(text)
        return [bytes(self.byte[c] for c in piece).decode("utf-8")
                for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]


def encode(docs: DataFrame, file: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit, back to back) of every text.

    A NULL or empty text has no ids. Copies are encoded alike; an empty table
    gives no rows.
    """
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(file)
        for batch in by_bytes(batches, "text", STRETCH_BYTES):
            out = encoder(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in out], pa.int64()),
                 pa.array([x.astype("<u4").tobytes() for x in out], pa.binary())], ["doc_id", "n_tokens", "ids"])

    return documents(docs).mapInArrow(encoded, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, file: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Replace ``ids`` by the tokens they name, with blanks between; special tokens are kept.

    The tokenizer file names no decoder, so this is what decoding means for it.
    NULL ids give NULL.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != ids)
    place = encoded.columns.index(ids)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Vocabulary(file).tokens
        for batch in by_bytes(batches, ids, STRETCH_BYTES):
            texts = [None if x is None else " ".join([tokens[n] for n in np.frombuffer(x, "<u4").tolist()])
                     for x in batch.column(place).to_pylist()]
            kept = [n for n in range(batch.num_columns) if n != place]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(texts, pa.string())],
                                             [*(batch.schema.names[n] for n in kept), out])

    return encoded.mapInArrow(decoded, f"{schema}, `{out}` string")
