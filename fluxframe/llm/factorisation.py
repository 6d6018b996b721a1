"""A factorisation machine for text quality.

Inputs are hashed words (log counts, scaled to length one), statistics of the
text's structure and its stored size. The score adds to the linear part all
pairwise interactions of low rank ``k``,

    sum over i < j of <v_i, v_j> x_i x_j = 1/2 sum over f of ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),

which takes time linear in the inputs a document has.

Fitting uses a bounded sample, ``per_class`` labelled rows of either class,
weighted back to the classes' true shares. Scoring is one pass over whole texts
without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from fluxframe.llm.common import bounded_sample, by_bytes, held_out

#: Labelled rows of each class that the model is fitted on.
PER_CLASS = 3000
#: Hash buckets of words; bounds both the model and a row of the sample.
BUCKETS = 1 << 12
RANK = 8
REMEMBERED = 300_000

#: Structure statistics, in the order of ``structure``.
STATISTICS = ("bias", "log_words", "log_size", "word_length", "upper", "digits", "symbols", "marks", "exclaims",
              "pipes", "distinct_words", "most_repeated", "repeats_next", "lines", "distinct_lines", "upper_words",
              "decorated_words", "non_ascii")
SIZE = BUCKETS + len(STATISTICS)


def structure(text: str, words: list[bytes], counts: Counter, n_chars: float | None) -> list[float]:
    """Shares and log sizes, all roughly between 0 and 1."""
    raw = text.encode("utf-8", "surrogatepass")
    size, n = max(len(raw), 1), max(len(words), 1)

    def share(characters: bytes) -> float:
        return (len(raw) - len(raw.translate(None, characters))) / size

    lines = [line for line in raw.split(b"\n") if line.strip()]
    return [
        1.0, np.log1p(len(words)) / 10, np.log1p(max(n_chars or 0, 0)) / 12, min(size / n / 20, 2.0),
        share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share(b"0123456789"), 4 * share(b"#*$%&|<>@^~=+_/\\{}[]"),
        4 * share(b".,;:?"), 8 * share(b"!"), 8 * share(b"|"), len(counts) / n,
        max(counts.values(), default=0) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        min(10 * len(lines) / n, 2.0), len(set(lines)) / max(len(lines), 1),
        sum(c for w, c in counts.items() if w.isupper()) / n,
        sum(c for w, c in counts.items() if not w[-1:].isalnum() and w[-1] < 128) / n,
        (len(raw) - len(text)) / size,
    ]


class Inputs:
    """Sparse inputs of texts; the buckets of words are remembered."""

    def __init__(self):
        self.buckets: dict[bytes, int] = {}

    def __call__(self, text: str | None, n_chars: float | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        words = text.encode("utf-8", "surrogatepass").split()
        counts, buckets = Counter(words), self.buckets
        if len(buckets) > REMEMBERED:
            buckets.clear()
        for w in counts:
            if w not in buckets:
                buckets[w] = xxhash.xxh3_64_intdigest(w.lower()) % BUCKETS
        values = np.bincount(np.array([buckets[w] for w in counts], dtype=np.int64),
                             weights=np.array(list(counts.values()), dtype=np.float64), minlength=BUCKETS)
        at = np.flatnonzero(values)
        x = np.log1p(values[at])
        x /= max(float(np.sqrt((x * x).sum())), 1e-9)
        return (np.concatenate([at, np.arange(BUCKETS, SIZE)]).astype(np.int32),
                np.concatenate([x, structure(text, words, counts, n_chars)]).astype(np.float32))


@dataclass
class Machine:
    weights: np.ndarray
    factors: np.ndarray

    def margin(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of rows laid out back to back, each beginning at one of ``starts``."""
        parts = self.factors[at] * x[:, None]
        sums = np.add.reduceat(parts, starts)
        squares = np.add.reduceat((parts * parts).sum(axis=1), starts)
        return np.add.reduceat(self.weights[at] * x, starts) + 0.5 * ((sums * sums).sum(axis=1) - squares)


def probability(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _inputs(docs: DataFrame, text: str, n_chars: str | None) -> list[Column]:
    size = F.col(n_chars).cast("double") if n_chars in docs.columns else F.lit(None).cast("double")
    return [F.col(text).cast("string").alias("text"), size.alias("n_chars")]


def sample(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> DataFrame:
    """Texts to learn from with ``y`` and ``weight``; rows held out, or labelled both ways, are never used."""
    known = (labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y"))
             .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("doc_id"))
             .groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("__y")).where("y = __y").drop("__y"))
    chosen = bounded_sample(known, "y", "doc_id", per_class)
    sizes = known.groupBy("y").agg(F.count(F.lit(1)).alias("__all"))
    weighed = chosen.join(sizes, "y").select(
        "doc_id", "y", (F.col("__all") / F.least(F.col("__all"), F.lit(per_class))).alias("weight"))
    # per_class rows of a few numbers at most for each of the two classes
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_inputs(docs, "text", "n_chars"))
    return texts.join(F.broadcast(weighed), "doc_id").dropDuplicates(["doc_id"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, rank: int = RANK,
        epochs: int = 12, seed: int = 7) -> Machine:
    """A machine fitted on the sample; without labels of both classes it scores by their share alone."""
    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inputs = Inputs()
        for batch in by_bytes(batches, "text"):
            got = [inputs(t, n) for t, n in zip(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist(),
                                                strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), batch.column("weight"),
                 pa.array([a.tobytes() for a, _ in got], pa.binary()),
                 pa.array([x.tobytes() for _, x in got], pa.binary())], ["doc_id", "y", "weight", "at", "x"])

    rows = (sample(docs, labels, label, per_class).select("doc_id", "y", "weight", "text", "n_chars")
            .mapInArrow(sparse, "doc_id long, y int, weight double, at binary, x binary").collect())
    rows.sort(key=lambda r: r["doc_id"])
    rng = np.random.default_rng(seed)
    machine = Machine(np.zeros(SIZE, np.float32), rng.normal(0, 0.05, (SIZE, rank)).astype(np.float32))
    y = np.array([r["y"] for r in rows], dtype=np.float64)
    weight = np.array([r["weight"] for r in rows])
    if not len(rows) or not 0 < y.sum() < len(y):
        share = float(y.mean()) if len(y) else 0.5
        machine.factors[:] = 0
        machine.weights[BUCKETS] = np.log((share + 0.01) / (1.01 - share))
        return machine
    at = [np.frombuffer(r["at"], np.int32) for r in rows]
    x = [np.frombuffer(r["x"], np.float32) for r in rows]
    _train(machine, at, x, y, weight / weight.mean(), epochs, rng)
    return machine


def _train(machine: Machine, at, x, y, weight, epochs: int, rng, batch: int = 128, rate: float = 0.05,
           decay: float = 1e-4):
    """AdaGrad on the weighted logistic loss."""
    rank = machine.factors.shape[1]
    seen_w, seen_v = np.full(SIZE, 1e-6), np.full((SIZE, rank), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for start in range(0, len(order), batch):
            rows = order[start:start + batch]
            lengths = np.array([len(at[r]) for r in rows])
            flat_at, flat_x = np.concatenate([at[r] for r in rows]), np.concatenate([x[r] for r in rows])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            slope = (probability(machine.margin(flat_at, flat_x, starts)) - y[rows]) * weight[rows] / len(rows)
            each = np.repeat(slope, lengths) * flat_x
            factors = machine.factors[flat_at]
            sums = np.repeat(np.add.reduceat(factors * flat_x[:, None], starts), lengths, axis=0)
            used, place = np.unique(flat_at, return_inverse=True)
            by_weight = np.bincount(place, each, len(used)) + decay * machine.weights[used]
            slopes = each[:, None] * (sums - factors * flat_x[:, None])
            by_factor = np.stack([np.bincount(place, slopes[:, f], len(used)) for f in range(rank)], axis=1)
            by_factor += decay * machine.factors[used]
            seen_w[used] += by_weight ** 2
            seen_v[used] += by_factor ** 2
            machine.weights[used] -= (rate * by_weight / np.sqrt(seen_w[used])).astype(np.float32)
            machine.factors[used] -= (rate * by_factor / np.sqrt(seen_v[used])).astype(np.float32)


def score(docs: DataFrame, machine: Machine, n_chars: str = "n_chars") -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    A NULL text is scored as an empty one, a missing size as 0; texts are taken
    whole. Equal rows score alike and come back as often, a score of exactly 0.5
    predicts 1, an empty table gives no rows. Columns other than doc_id, text and
    ``n_chars`` are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # SIZE * (RANK + 1) numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"),
                       *_inputs(docs, "text", n_chars))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inputs = Inputs()
        for batch in by_bytes(batches, "text"):
            got = [inputs(t, n) for t, n in zip(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist(),
                                                strict=True)]
            starts = np.cumsum([0, *(len(a) for a, _ in got[:-1])])
            scores = probability(shared.value.margin(np.concatenate([a for a, _ in got]),
                                                     np.concatenate([x for _, x in got]), starts).astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()),
                 pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")
