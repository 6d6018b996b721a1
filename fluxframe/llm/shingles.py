"""Texts as sets of hashed shingles of a few words, a batch at a time."""

from __future__ import annotations

import numpy as np
import xxhash

from fluxframe.llm.common import ASCII_LOWER

#: Odd multipliers; any will do, they only have to stay the same within a job.
FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                                  0x85EBCA77C2B2AE63)]
REMEMBERED = 300_000


def mixed(h: np.ndarray) -> np.ndarray:
    """The last step of a 64-bit hash: every bit of the input reaches every bit of the result."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class _Known(dict):
    """Word -> place in the arrays of hashes and sizes, filled as words come up."""

    def __init__(self):
        self.fresh_hashes: list[int] = []
        self.fresh_sizes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        self.fresh_hashes.append(xxhash.xxh3_64_intdigest(word))
        self.fresh_sizes.append(len(word))
        return place


class Shingler:
    """Distinct shingles of texts. Words are hashed once as long as they are remembered."""

    def __init__(self, words: int = 3):
        self.words = words  # as many as there are factors at most
        self._forget()

    def _forget(self):
        self.known, self.hashes, self.sizes = _Known(), np.empty(0, np.uint64), np.empty(0, np.int64)

    def _look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > REMEMBERED:
            self._forget()
        known = self.known
        places = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        if known.fresh_sizes:
            fresh = np.array(known.fresh_hashes, np.uint64), np.array(known.fresh_sizes, np.int64)
            known.fresh_hashes, known.fresh_sizes = [], []
            at, end = len(known) - len(fresh[0]), len(known)
            if end > len(self.hashes):  # room for twice as many
                self.hashes = np.resize(self.hashes, 2 * end) if at else np.empty(2 * end, np.uint64)
                self.sizes = np.resize(self.sizes, 2 * end) if at else np.empty(2 * end, np.int64)
            self.hashes[at:end], self.sizes[at:end] = fresh
        return self.hashes[places], self.sizes[places]

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes, and the bytes each shingle has.

        Fewer words than a shingle has count as one shingle; no word gives none.
        """
        words = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
        if not words:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        h, size = self._look_up(words)
        if len(words) < self.words:
            whole = np.array([len(words)], np.uint64)
            for n in range(len(words)):
                whole = whole + h[n:n + 1] * FACTORS[n]
            return mixed(whole), np.array([size.sum()])
        count = len(words) - self.words + 1
        h = mixed(sum(h[n:n + count] * FACTORS[n] for n in range(self.words)))
        size = sum(size[n:n + count] for n in range(self.words))
        order = np.argsort(h)
        h = h[order]
        first = np.concatenate([[True], h[1:] != h[:-1]])
        return h[first], size[order[first]]
