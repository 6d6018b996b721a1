"""The scoring network as a vectorised function over Arrow batches.

Spark prepares fixed-size number arrays per sample and distributes the rows;
inside a task a batch is a handful of matrix products. Weights are the only
thing broadcast, and their size is fixed by the configuration, not the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from fluxframe import vocab

MAX_WEIGHT_BYTES = 256 << 20
ROWS_AT_ONCE = 128  # keeps the intermediate arrays inside the processor cache
PIECE = 1 << 15  # numbers that several element-wise steps pass over before the next ones


@dataclass(frozen=True)
class NetConfig:
    """``layers``: w = attend to the same time step's series, c = attend to the
    static inputs, s = attend to the other time steps."""

    predictors: tuple[str, ...] = vocab.PREDICTORS
    targets: tuple[str, ...] = ("NEE",)
    length: int = 32
    width: int = 64
    frequencies: int = 12
    embedding: int = 22
    heads: int = 8
    mlp_ratio: int = 3
    layers: str = "wcswcswcswcsss"
    shared: bool = False
    mask_ratio: float = 0.3

    @property
    def token(self) -> int:
        return 2 * self.frequencies + self.embedding

    def slot(self, position: int) -> str:
        """Where a layer's weights live; shared kinds use one slot."""
        kind = self.layers[position]
        return kind if self.shared and kind in "wc" else f"{kind}{position}"


def init_weights(cfg: NetConfig, seed: int = 0) -> dict[str, np.ndarray]:
    """Seeded random weights: linear maps normal with Glorot scale, zero biases."""
    rng = np.random.default_rng(seed)
    weights: dict[str, np.ndarray] = {}

    def linear(name, fan_in, fan_out):
        scale = np.sqrt(2.0 / (fan_in + fan_out))
        weights[name] = rng.normal(0, scale, (fan_in, fan_out)).astype(np.float32)
        weights[name + "/b"] = np.zeros(fan_out, np.float32)

    def table(name, rows, cols):
        weights[name] = rng.normal(0, 1, (rows, cols)).astype(np.float32)

    table("embed/series", len(vocab.PREDICTORS), cfg.embedding)
    table("embed/static", len(vocab.STATIC), cfg.embedding)
    table("embed/channel", vocab.CHANNELS, cfg.embedding)
    table("embed/class", len(vocab.CLASSES), cfg.token)
    table("latent", cfg.length, cfg.width)
    for c in range(vocab.CHANNELS):
        linear(f"image/{c}", vocab.PIXELS, 2 * cfg.frequencies)
    for position, kind in enumerate(cfg.layers):
        slot = cfg.slot(position)
        if f"{slot}/q" in weights:
            continue
        source = cfg.width if kind == "s" else cfg.token
        linear(f"{slot}/q", cfg.width, cfg.width)
        linear(f"{slot}/k", source, cfg.width)
        linear(f"{slot}/v", source, cfg.width)
        linear(f"{slot}/o", cfg.width, cfg.width)
        linear(f"{slot}/up", cfg.width, cfg.mlp_ratio * cfg.width)
        linear(f"{slot}/down", cfg.mlp_ratio * cfg.width, cfg.width)
        for norm in ("n1", "n2"):
            weights[f"{slot}/{norm}"] = np.ones(cfg.width, np.float32)
            weights[f"{slot}/{norm}/b"] = np.zeros(cfg.width, np.float32)
    for t in cfg.targets:
        linear(f"head/{t}", cfg.width, 1)
    return weights


def parameter_count(weights: dict[str, np.ndarray]) -> int:
    return int(sum(w.size for w in weights.values()))


def _gelu(x):
    """In place; error function by the five-term rational fit, good to single precision."""
    flat = x.reshape(-1)
    half = np.float32(np.sqrt(0.5))
    for first in range(0, flat.size, PIECE):
        part = flat[first:first + PIECE]
        z = np.abs(part)
        z *= half
        t = z * np.float32(0.3275911)
        t += 1
        np.reciprocal(t, out=t)
        tail = t * np.float32(1.061405429)
        for c in (-1.453152027, 1.421413741, -0.284496736, 0.254829592):
            tail += np.float32(c)
            tail *= t
        np.multiply(z, z, out=t)
        np.negative(t, out=t)
        tail *= np.exp(t, out=t)
        # x/2 (1 + erf) is x or 0 less half of |x| times what the error function lacks of one
        z *= half
        tail *= z
        np.maximum(part, 0, out=part)
        part -= tail
    return x


def _apply(w, name, x):
    # one large product instead of a stack of small ones
    flat = x.reshape(-1, x.shape[-1]) @ w[name]
    flat += w[name + "/b"]
    return flat.reshape(*x.shape[:-1], flat.shape[-1])


def _norm(w, name, x):
    width = x.shape[-1]
    centred = x - (x.reshape(-1, width) @ np.full(width, 1 / width, np.float32)).reshape(*x.shape[:-1], 1)
    centred /= np.sqrt(np.einsum("...i,...i->...", centred, centred)[..., None] / np.float32(width) + np.float32(1e-12))
    centred *= w[name]
    centred += w[name + "/b"]
    return centred


def _powers(scores, hidden, axis):
    """Exponentials in place, 0 where hidden; rows whose powers could leave single precision are shifted by their largest."""
    small = max(scores.max(), -scores.min()) < 40
    if hidden is not None:
        np.copyto(scores, np.float32(-np.inf), where=hidden)
    if not small:
        scores -= scores.max(axis, keepdims=True)
    return np.exp(scores, out=scores)


def _mix(q, k, v, heads, hidden):
    """What queries (N,Q,W) take from tokens (N,S,W)."""
    size = q.shape[-1] // heads
    if q.shape[1] == 1:
        # with one query each, products of whole rows are summed up by head
        of_head = np.repeat(np.eye(heads, dtype=np.float32), size, 0)
        scores = ((q * k).reshape(-1, q.shape[-1]) @ of_head).reshape(*k.shape[:2], heads) / np.float32(np.sqrt(size))
        with np.errstate(invalid="ignore"):
            weight = _powers(scores, None if hidden is None else hidden[:, 0, :, None], 1)
            weight /= weight.sum(1, keepdims=True)
            return ((weight.reshape(-1, heads) @ of_head.T).reshape(k.shape) * v).sum(1, keepdims=True)

    def split(y):
        return y.reshape(*y.shape[:2], heads, size).transpose(0, 2, 1, 3)

    scores = split(q) @ split(k).transpose(0, 1, 3, 2)
    scores /= np.float32(np.sqrt(size))
    with np.errstate(invalid="ignore"):
        weight = _powers(scores, None if hidden is None else hidden[:, None], -1)
        total = weight.reshape(-1, weight.shape[-1]) @ np.ones(weight.shape[-1], np.float32)
        mixed = weight @ split(v)
        mixed /= total.reshape(*weight.shape[:-1], 1)
    return mixed.transpose(0, 2, 1, 3).reshape(q.shape)


def _attend(w, slot, heads, x, source, hidden, at=None):
    """Queries (N,Q,W) over source (N,S,D); True in ``hidden`` (N,1|Q,S) is ignored.

    With ``at`` the source holds different entries only, and ``at`` tells which are meant.
    """
    q, k, v = _apply(w, f"{slot}/q", _norm(w, f"{slot}/n1", x)), _apply(w, f"{slot}/k", source), _apply(w, f"{slot}/v", source)
    if at is not None:
        k, v = k[at], v[at]
    x = x + _apply(w, f"{slot}/o", _mix(q, k, v, heads, hidden))
    inner = _gelu(_apply(w, f"{slot}/up", _norm(w, f"{slot}/n2", x)))
    x += _apply(w, f"{slot}/down", inner)
    return x


def _number_tokens(values, table, frequencies):
    """Fourier features beside the variable's embedding; missing ones are hidden."""
    hidden = np.isnan(values)
    angle = np.nan_to_num(values)[..., None] * (np.pi * 2.0 ** np.arange(frequencies))
    waves = np.concatenate([np.sin(angle), np.cos(angle)], -1).astype(np.float32)
    waves[hidden] = 0
    return np.concatenate([waves, np.broadcast_to(table, (*values.shape, table.shape[-1]))], -1), hidden


def forward(w: dict[str, np.ndarray], cfg: NetConfig, series: np.ndarray, static: np.ndarray,
            classes: np.ndarray, images: np.ndarray) -> np.ndarray:
    """series (B,L,P), static (B,3), class index (B) or -1, images (B,9,64) or NaN."""
    batch = len(series)
    known = [vocab.PREDICTORS.index(p) for p in cfg.predictors]
    # windows overlap, so most values of a batch occur several times; each becomes a token once
    tokens, at = [], np.empty(series.shape, np.int64)
    for n, table in enumerate(w["embed/series"][known]):
        values, found = np.unique(series[..., n], return_inverse=True)
        at[..., n] = found.reshape(at.shape[:2]) + sum(map(len, tokens))
        tokens.append(_number_tokens(values, table, cfg.frequencies)[0])
    steps, steps_hidden = np.concatenate(tokens), np.isnan(series)
    # rows of one place and image come one after another
    fresh = np.ones(batch, bool)
    fresh[1:] = (images[1:] != images[:-1]).any((1, 2)) | (static[1:] != static[:-1]).any(1) | (classes[1:] != classes[:-1])
    place_at = np.cumsum(fresh) - 1
    static, classes, images = static[fresh], classes[fresh], images[fresh]
    place, place_hidden = _number_tokens(static, w["embed/static"], cfg.frequencies)

    absent = np.isnan(images).any((1, 2))
    pixels = np.where(absent[:, None, None], np.float32(0), images)
    shown = np.stack([_apply(w, f"image/{c}", pixels[:, c]) for c in range(vocab.CHANNELS)], 1)
    channels = np.concatenate([shown, np.broadcast_to(w["embed/channel"], (len(images), *w["embed/channel"].shape))], -1)
    channels_hidden = absent[:, None] | ((pixels < 0).mean(-1) > cfg.mask_ratio)

    cover = np.where(classes[:, None] >= 0, w["embed/class"][np.maximum(classes, 0)], np.float32(0))[:, None]
    static_tokens = np.concatenate([channels, place, cover], 1)
    static_hidden = np.concatenate([channels_hidden, place_hidden, classes[:, None] < 0], 1)[place_at, None]

    # the heads read the last time step alone, and only layers of kind s look at other steps
    final = cfg.layers.rfind("s")
    x = np.broadcast_to(w["latent"] if final >= 0 else w["latent"][-1:], (batch, cfg.length if final >= 0 else 1, cfg.width))
    for position, kind in enumerate(cfg.layers):
        slot = cfg.slot(position)
        if kind == "w":
            per_step = x.reshape(-1, 1, cfg.width)
            own, own_hidden = (y[:, -x.shape[1]:].reshape(-1, y.shape[2]) for y in (at, steps_hidden))
            x = _attend(w, slot, cfg.heads, per_step, steps, own_hidden[:, None], own).reshape(x.shape)
        elif kind == "c":
            x = _attend(w, slot, cfg.heads, x, static_tokens, static_hidden, place_at)
        else:
            x = _attend(w, slot, cfg.heads, x[:, -1:] if position == final else x, x, None)
    return np.concatenate([_apply(w, f"head/{t}", x[:, -1]) for t in cfg.targets], 1)


def flat_window(frame: str, predictors: Sequence[str]):
    """Array of structs -> one flat float array, missing as NaN, built in the JVM."""
    hole = F.lit(float("nan")).cast("float")
    return F.flatten(F.transform(frame, lambda r: F.array(
        *[F.coalesce(r[p].cast("float"), hole) for p in predictors])))


def _rows(lists: pa.Array, size: int) -> np.ndarray:
    """Lists of ``size`` numbers as the rows of a table; a missing list is NaN throughout."""
    if not pc.all(pc.equal(pc.list_value_length(lists), size), min_count=0).as_py():
        raise ValueError(f"a list does not have {size} numbers")
    values = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    if not lists.null_count:
        return values
    table = np.full((len(lists), size), np.nan, values.dtype)
    table[lists.is_valid().to_numpy(zero_copy_only=False)] = values
    return table


def score(samples: DataFrame, weights: dict[str, np.ndarray], cfg: NetConfig,
          keep: Sequence[str], frame: str = "frame", image: str | None = "data") -> DataFrame:
    """Add ``pred_<target>`` to samples that have frame, lat, lon, elev, igbp.

    A sample whose inputs are all missing scores NULL.
    """
    size = sum(a.nbytes for a in weights.values())
    if size > MAX_WEIGHT_BYTES:
        raise ValueError(f"weights of {size} bytes are too large to broadcast")
    shared = samples.sparkSession.sparkContext.broadcast(weights)
    classes = F.array(*[F.lit(c) for c in vocab.CLASSES])
    hole = F.lit(float("nan")).cast("float")
    prepared = samples.select(
        *keep, flat_window(frame, cfg.predictors).alias("__window"),
        F.array(*[F.coalesce(F.col(c).cast("float"), hole) for c in vocab.STATIC]).alias("__static"),
        (F.coalesce(F.array_position(classes, F.col("igbp")), F.lit(0)) - 1).cast("int").alias("__class"),
        (F.col(image) if image else F.lit(None).cast("array<float>")).alias("__image"))
    kept = prepared.select(*keep).schema
    result = T.StructType(kept.fields + [T.StructField(f"pred_{t}", T.DoubleType()) for t in cfg.targets])
    names = [*keep, *[f"pred_{t}" for t in cfg.targets]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            series = _rows(batch.column("__window"), cfg.length * len(cfg.predictors))
            static = _rows(batch.column("__static"), len(vocab.STATIC))
            images = _rows(batch.column("__image"), vocab.CHANNELS * vocab.PIXELS)
            known = batch.column("__class").to_numpy()
            out = np.empty((len(series), len(cfg.targets)))
            for first in range(0, len(series), ROWS_AT_ONCE):
                part = slice(first, first + ROWS_AT_ONCE)
                out[part] = forward(w, cfg, series[part].reshape(-1, cfg.length, len(cfg.predictors)), static[part], known[part],
                                    images[part].reshape(-1, vocab.CHANNELS, vocab.PIXELS))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(column) for column in out.T]], names)

    scored = prepared.mapInArrow(run, result)
    return scored.withColumns({f"pred_{t}": F.when(~F.isnan(f"pred_{t}"), F.col(f"pred_{t}"))
                               for t in cfg.targets})
