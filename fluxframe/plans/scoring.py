"""Grid scoring end to end: index, windows, images, network, override, output."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from fluxframe.functions import scalars, text
from fluxframe.operators import network, samples
from fluxframe.operators.ordering import dense_order

ORDER = ("coord_id", "timestamp", "id")


def first_samples(index: DataFrame, most: int):
    """The (location, time, id) of the last of the first ``most`` samples, if
    there are more. One row reaches the driver."""
    numbered = samples.ordered_samples(index.select(*ORDER))
    row = numbered.where(F.col("__sample_order") == most - 1).first()
    return None if row is None else tuple(row[c] for c in ORDER)


def score_grid(facts: DataFrame, dim: DataFrame, images: DataFrame | None, weights: dict[str, np.ndarray],
               cfg: network.NetConfig, start: str | None = None, end: str | None = None,
               exclude: Sequence[str] = (), targets: Sequence[str] | None = None,
               light_threshold: float | None = None, max_samples: int | None = None,
               numbered: bool = False) -> DataFrame:
    """Predictions per location and hour.

    The start and end are inclusive dates or timestamps. ``light_threshold`` is
    a raw SW_IN below which GPP outputs become 0; ``low_light`` marks the rows.
    """
    if light_threshold is not None and "SW_IN" not in cfg.predictors:
        raise ValueError("the light override needs SW_IN among the predictors")
    low, high, _ = scalars.date_range(start, end)
    if max_samples is not None:
        index = samples.grid_sample_index(samples.without_classes(facts, dim, exclude), cfg.length, low, high)
        stop = first_samples(index, max_samples)
        if stop is not None:
            # windows only look back, so rows after the last sample are not needed
            last = F.struct(*[F.lit(v).cast(facts.schema[c].dataType).alias(c) for c, v in zip(ORDER, stop)])
            facts = facts.where(F.struct(*ORDER) <= last)
    built = samples.grid_samples(facts, dim, cfg.length, cfg.predictors, images, low, high, exclude)
    if images is None:
        built = built.withColumn("data", F.lit(None).cast("array<float>"))
    light = F.element_at("frame", -1)["SW_IN"] if light_threshold is not None else F.lit(None).cast("double")
    keep = ["id", "coord_id", "timestamp", "lat", "lon", "igbp", "__light"]
    kept = built.withColumn("__light", light)
    # elev is an input of the network but not of the output
    scored = network.score(kept, weights, cfg, keep)
    names = [f"pred_{t}" for t in cfg.targets]
    if light_threshold is not None:
        limit = scalars.normalise_value("SW_IN", light_threshold)
        dark = F.coalesce(F.col("__light") < limit, F.lit(False))
        scored = scored.withColumns(scalars.override_low_light(names, F.col("__light"), limit))
        scored = scored.withColumn("low_light", dark)
    wanted = text.pick_targets(names, targets)
    extra = ["low_light"] if light_threshold is not None else []
    result = scored.select("id", "coord_id", "lat", "lon", "igbp", "timestamp", *wanted, *extra)
    return dense_order(result, ORDER, "__sample_order") if numbered else result
