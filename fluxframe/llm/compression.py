"""Quality rules on compressibility, after a few base counts.

A document is compressed as a whole and in fixed chunks (zstandard). Text that
repeats itself compresses too well, random strings hardly at all. What is normal
depends on the length, since short texts give the compressor less to refer to,
so every length has its own band; chunks have one of theirs. Each task reads its
own rows once: no shuffle, no statistics of other rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from fluxframe.llm.common import by_bytes, documents, with_row

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"

#: (bytes from which the band holds, least and greatest ratio). Prose of the
#: languages at hand lies at least 0.05 inside; repeated words lie below 0.3.
BANDS = ((0, 0.42, 0.95), (512, 0.38, 0.85), (1024, 0.36, 0.75), (2048, 0.33, 0.70), (8192, 0.29, 0.65),
         (32768, 0.26, 0.65))
CHUNK_BYTES = 2048
#: Limits for single chunks, and the shares of bytes in chunks below or above that reject a document. Chunks of good
#: rows of the four languages come to 0.53 at most, base64 to 0.77 at least; hex (0.52 to 0.54) can't be told from prose.
CHUNK_BAND = (0.25, 0.66)
CHUNK_SHARE = 0.5
NOISE_SHARE = 0.25
#: (bytes from which it holds, greatest ratio) of a shorter last chunk, halfway between good rows and base64 again.
REST_LIMITS = ((256, 0.87), (512, 0.78), (1024, 0.70), (1536, 0.66))
LEVEL = 3

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, n_bytes long, ratio double, n_chunks long, chunks_below long, "
          "chunks_above long, verdict string")


@dataclass(frozen=True)
class Rules:
    bands: Sequence[tuple[int, float, float]] = BANDS
    chunk_bytes: int = CHUNK_BYTES
    chunk_band: tuple[float, float] = CHUNK_BAND
    chunk_share: float = CHUNK_SHARE
    noise_share: float = NOISE_SHARE
    rest_limits: Sequence[tuple[int, float]] = REST_LIMITS
    level: int = LEVEL
    min_words: int = 50
    max_repeat_percent: int = 50

    def band(self, size: int) -> tuple[float, float]:
        return [(low, high) for start, low, high in self.bands if size >= start][-1]


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - (len(raw) - len(raw.translate(None, WHITE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip(WHITE)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts = Counter(windows)
        free = 0  # first word not yet counted
        for n, window in enumerate(windows):
            if counts[window] > 1:
                repeated += n + 3 - max(n, free)
                free = n + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def compression(text: str | None, rules: Rules, compressor) -> tuple[int, float | None, int, int, int, str]:
    """n_bytes, ratio, n_chunks, chunks_below, chunks_above, verdict.

    A text of at least ``chunk_bytes`` is cut into chunks of that size. A rest that
    has a limit of its own is a chunk too, a smaller one belongs to the last chunk.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return 0, None, 0, 0, 0, "empty"
    ratio = len(compressor.compress(raw)) / len(raw)
    low, high = rules.chunk_band
    cuts = [*range(0, len(raw) - rules.chunk_bytes + 1, rules.chunk_bytes), len(raw)]
    if len(raw) % rules.chunk_bytes >= rules.rest_limits[0][0] and len(cuts) > 1:
        cuts.insert(-1, len(raw) // rules.chunk_bytes * rules.chunk_bytes)
    below, above = [], []  # sizes of chunks
    for start, stop in zip(cuts, cuts[1:], strict=False):
        size = stop - start
        part = len(compressor.compress(raw[start:stop])) / size
        limit = high if size >= rules.chunk_bytes else [most for least, most in rules.rest_limits if size >= least][-1]
        if part < low:
            below.append(size)
        elif part > limit:
            above.append(size)
    least, most = rules.band(len(raw))
    if ratio < least:
        verdict = "repetitive"
    elif ratio > most:
        verdict = "incompressible"
    elif sum(below) > rules.chunk_share * len(raw):
        verdict = "repetitive chunks"
    elif sum(above) > rules.noise_share * len(raw):
        verdict = "incompressible chunks"
    else:
        verdict = "kept"
    return len(raw), ratio, len(cuts) - 1, len(below), len(above), verdict


def judge(docs: DataFrame, rules: Rules = Rules(), carry: bool = False) -> DataFrame:
    """One row per document: counts, ratios, ``base_failed``, ``kept`` and the method's ``verdict``.

    ``carry`` adds ``row``, a struct of all columns of ``docs``.

    NULL and empty texts have no words and fail the base; their ratio is NULL.
    Copies get equal rows. An empty table gives no rows.
    """
    names = [part.split()[0] for part in SCHEMA.split(", ")]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=rules.level)
        for batch in by_bytes(batches, "text"):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counts = base_counts(text)
                failed = counts[0] < rules.min_words or 100 * counts[4] > rules.max_repeat_percent * counts[0]
                found = compression(text, rules, compressor)
                rows.append((doc, *counts, failed, not failed and found[-1] == "kept", *found))
            kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.int64(), pa.float64()] + [pa.int64()] * 3 + [pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*columns, batch.column("row")] if carry else columns, [*names, "row"] if carry else names)

    if not carry:
        return documents(docs).mapInArrow(judged, SCHEMA)
    whole = with_row(docs)
    return whole.mapInArrow(judged, f"{SCHEMA}, row {whole.schema['row'].dataType.simpleString()}")
