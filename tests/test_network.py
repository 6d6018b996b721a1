"""The network against a plain per-sample computation, and inside Spark."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxframe import vocab
from fluxframe.operators import network
from fluxframe.plans import scoring

CFG = network.NetConfig(predictors=("TA", "SW_IN"), targets=("NEE", "GPP_DT"), length=3, width=8, frequencies=2,
                        embedding=4, heads=2, mlp_ratio=2, layers="wcsw")


def plain(w, cfg, series, static, cls, image):
    """One sample, one token, one head at a time, in double precision."""
    w = {k: v.astype(float) for k, v in w.items()}

    def lin(name, x):
        return np.array([sum(x[i] * w[name][i, j] for i in range(len(x))) + w[name + "/b"][j]
                         for j in range(w[name].shape[1])])

    def norm(name, x):
        mean = sum(x) / len(x)
        var = sum((v - mean) ** 2 for v in x) / len(x)
        return (x - mean) / math.sqrt(var + 1e-12) * w[name] + w[name + "/b"]

    def number(value, emb):
        waves = [f(math.pi * 2 ** k * value) for f in (math.sin, math.cos) for k in range(cfg.frequencies)]
        return np.concatenate([waves, emb])

    def layer(slot, query, tokens):
        size = cfg.width // cfg.heads
        q = lin(slot + "/q", norm(slot + "/n1", query))
        ks, vs = [lin(slot + "/k", t) for t in tokens], [lin(slot + "/v", t) for t in tokens]
        mixed = []
        for h in range(cfg.heads):
            part = slice(h * size, (h + 1) * size)
            scores = [math.exp(q[part] @ k[part] / math.sqrt(size)) for k in ks]
            mixed.append(sum(s * v[part] for s, v in zip(scores, vs)) / sum(scores))
        x = query + lin(slot + "/o", np.concatenate(mixed))
        up = lin(slot + "/up", norm(slot + "/n2", x))
        return x + lin(slot + "/down", np.array([0.5 * u * (1 + math.erf(u / math.sqrt(2))) for u in up]))

    steps = [[number(v, w["embed/series"][vocab.PREDICTORS.index(p)]) for p, v in zip(cfg.predictors, row) if v == v]
             for row in series]
    fixed = []
    if image is not None:
        for c in range(vocab.CHANNELS):
            if sum(v < 0 for v in image[c]) / 64 <= cfg.mask_ratio:
                fixed.append(np.concatenate([lin(f"image/{c}", image[c]), w["embed/channel"][c]]))
    fixed += [number(v, w["embed/static"][n]) for n, v in enumerate(static) if v == v]
    if cls in vocab.CLASSES:
        fixed.append(w["embed/class"][vocab.CLASSES.index(cls)])
    x = list(w["latent"])
    for n, kind in enumerate(cfg.layers):
        slot = cfg.slot(n)
        if kind == "w":
            x = [layer(slot, q, steps[t]) for t, q in enumerate(x)]
        else:
            tokens = fixed if kind == "c" else list(x)
            x = [layer(slot, q, tokens) for q in x]
    return [float(lin(f"head/{t}", x[-1])[0]) for t in cfg.targets]


@pytest.fixture(scope="module")
def inputs():
    rng = np.random.default_rng(7)
    batch = 6
    series = rng.normal(size=(batch, 3, 2)).astype(np.float32)
    series[0, 1, 0] = series[3, :, 1] = np.nan
    static = rng.normal(size=(batch, 3)).astype(np.float32)
    static[2] = np.nan
    classes = ["ENF", None, "WAT", "SNO", "???", "MF"]
    images = [rng.normal(0.8, 1, size=(9, 64)).astype(np.float32) if n not in (1, 4) else None for n in range(batch)]
    return series, static, classes, images


@pytest.mark.parametrize("shared", [False, True])
def test_forward(inputs, shared):
    cfg = network.NetConfig(**{**CFG.__dict__, "shared": shared})
    w = network.init_weights(cfg, 3)
    rng = np.random.default_rng(1)
    for k in w:
        if k.endswith("/b"):
            w[k] = rng.normal(0, 0.1, w[k].shape).astype(np.float32)
    series, static, classes, images = inputs
    index = np.array([vocab.CLASSES.index(c) if c in vocab.CLASSES else -1 for c in classes])
    dense = np.stack([np.full((9, 64), np.nan, np.float32) if i is None else i for i in images])
    got = network.forward(w, cfg, series, static, index, dense)
    for n in range(len(series)):
        assert got[n] == pytest.approx(plain(w, cfg, series[n], static[n], classes[n], images[n]), abs=2e-4)
        alone = network.forward(w, cfg, series[n:n + 1], static[n:n + 1], index[n:n + 1], dense[n:n + 1])
        assert alone[0] == pytest.approx(got[n], abs=1e-5)


@pytest.mark.parametrize("layers", ["wcs", "scw", "wc", "swsc"])
def test_no_work_is_done_twice(monkeypatch, layers):
    """Overlapping windows of one place: each value is a token once, and the last steps alone go on behind the last s."""
    cfg = network.NetConfig(**{**CFG.__dict__, "layers": layers})
    w = network.init_weights(cfg, 3)
    rng = np.random.default_rng(2)
    events = rng.normal(size=(22, 2)).astype(np.float32)
    events[4, 1] = np.nan
    series = np.stack([events[n:n + 3] for n in range(20)])
    static = np.repeat(rng.normal(size=(2, 3)).astype(np.float32), 10, 0)
    classes = np.repeat([1, 1, 2, -1], 5)
    images = np.repeat(rng.normal(0.8, 1, size=(4, 9, 64)).astype(np.float32), [5, 3, 7, 5], 0)
    images[15:] = np.nan
    tokens, inner = [], []
    number, gelu = network._number_tokens, network._gelu
    monkeypatch.setattr(network, "_number_tokens", lambda values, *rest: tokens.append(values.size) or number(values, *rest))
    monkeypatch.setattr(network, "_gelu", lambda x: inner.append(x.size // x.shape[-1]) or gelu(x))
    got = network.forward(w, cfg, series, static, classes, images)
    assert tokens[:2] == [22, 22] and tokens[2] < static.size
    full, last = 60, 20
    assert inner == {"wcs": [full, full, last], "scw": [last] * 3, "wc": [last] * 2, "swsc": [full, full, last, last]}[layers]
    for n in range(20):
        image = None if n >= 15 else images[n]
        cls = vocab.CLASSES[classes[n]] if classes[n] >= 0 else None
        assert got[n] == pytest.approx(plain(w, cfg, series[n], static[n], cls, image), abs=2e-4)


@pytest.mark.parametrize("scale", [1, 30, 400])
def test_large_scores(scale):
    """Also scores beyond what single precision can raise to a power."""
    rng = np.random.default_rng(1)
    scores = (scale * rng.normal(size=(50, 7))).astype(np.float32)
    hidden = rng.random((50, 7)) < 0.3
    hidden[:, 0] = False
    exact = np.where(hidden, -np.inf, scores.astype(float))
    exact = np.exp(exact - exact.max(1, keepdims=True))
    got = network._powers(scores.copy(), hidden, 1)
    assert (got[hidden] == 0).all()
    assert got / got.sum(1, keepdims=True) == pytest.approx(exact / exact.sum(1, keepdims=True), abs=1e-5)


def test_list_sizes(spark):
    df = spark.createDataFrame([(1, [(1.0, 1.0)] * 3, 0.1, 0.1, 0.1, "ENF", [0.5] * 575)],
                               "id long, frame array<struct<TA:double,SW_IN:double>>, lat float, lon float, elev float, igbp string, data array<float>")
    with pytest.raises(Exception, match="a list does not have 576 numbers"):
        network.score(df, network.init_weights(CFG), CFG, ["id"]).collect()


def test_weights():
    w, same, other = network.init_weights(CFG, 1), network.init_weights(CFG, 1), network.init_weights(CFG, 2)
    assert all((w[k] == same[k]).all() for k in w) and (w["latent"] != other["latent"]).any()
    shared = network.NetConfig(**{**CFG.__dict__, "shared": True})
    assert network.parameter_count(network.init_weights(shared)) < network.parameter_count(w)


def test_score(spark, inputs):
    series, static, classes, images = inputs
    data = [(n, [(float(r[0]) if r[0] == r[0] else None, float(r[1]) if r[1] == r[1] else None) for r in series[n]],
             *[float(v) if v == v else None for v in static[n]], classes[n],
             None if images[n] is None else [float(v) for v in images[n].ravel()]) for n in range(6)]
    data.append((6, [(None, None)] * 3, 0.1, 0.1, 0.1, "ENF", None))
    df = spark.createDataFrame(data, "id long, frame array<struct<TA:double,SW_IN:double>>, lat float, lon float, "
                                     "elev float, igbp string, data array<float>")
    w = network.init_weights(CFG, 3)
    got = {r.id: (r.pred_NEE, r.pred_GPP_DT) for r in network.score(df, w, CFG, ["id"]).collect()}
    assert got[6] == (None, None)  # nothing to attend to
    for n in range(6):
        assert got[n] == pytest.approx(plain(w, CFG, series[n], static[n], classes[n], images[n]), abs=2e-4)


def test_score_grid(spark):
    facts = spark.createDataFrame(
        [(n, n % 3, 20170601000000 + 10000 * n, n / 30 - .5, n / 30 - .5) for n in range(20)],
        "id long, coord_id long, timestamp long, TA double, SW_IN double")
    dim = spark.createDataFrame([(0, 45.0, 90.0, 8.0, "ENF"), (1, 0.0, 0.0, None, None), (2, 1.0, 1.0, 1.0, "WAT")],
                                "coord_id long, lat double, lon double, elev double, igbp string")
    w = network.init_weights(CFG, 3)
    every = scoring.score_grid(facts, dim, None, w, CFG)
    assert every.columns == ["id", "coord_id", "lat", "lon", "igbp", "timestamp", "pred_NEE", "pred_GPP_DT"]
    assert sorted(r.id for r in every.collect()) == list(range(6, 20))
    some = scoring.score_grid(facts, dim, None, w, CFG, start="2017-06-01 09:00", end="2017-06-01 15:00:00", exclude=["wat"],
                              targets=["GPP_DT"], light_threshold=0.0, numbered=True)
    got = some.orderBy("__sample_order").collect()
    assert [(r["__sample_order"], r.coord_id, r.id) for r in got] == [(0, 0, 9), (1, 0, 12), (2, 0, 15), (3, 1, 10), (4, 1, 13)]
    assert [r.low_light for r in got] == [True, True, False, True, True]
    full = {r.id: r.pred_GPP_DT for r in every.collect()}
    assert all(r.pred_GPP_DT == (0.0 if r.low_light else pytest.approx(full[r.id])) for r in got)
    assert got[0].lat == 0.25 and "pred_NEE" not in some.columns
    first = scoring.score_grid(facts, dim, None, w, CFG, max_samples=5)
    assert sorted((r.coord_id, r.id) for r in first.collect()) == [(0, 6), (0, 9), (0, 12), (0, 15), (0, 18)]
    assert scoring.score_grid(facts, dim, None, w, CFG, max_samples=500).count() == 14
    with pytest.raises(ValueError, match="SW_IN"):
        scoring.score_grid(facts, dim, None, w, network.NetConfig(**{**CFG.__dict__, "predictors": ("TA",)}), light_threshold=1.0)
    with pytest.raises(ValueError, match="unknown"):
        scoring.score_grid(facts, dim, None, w, CFG, targets=["XX"])
