"""Running meters over files that keep arriving."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Kept per series: its last values, and how many there were and their sum, NULLs left out.
STATE = "last array<double>, n long, total double"


#: Rows whose windows are laid out at once.
ROWS = 1 << 14


def _meters(values: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """Meters of every ``window`` values in a row, added up in their order."""
    frames = np.lib.stride_tricks.sliding_window_view(values, window)
    there = ~np.isnan(frames)
    count, filled = there.sum(axis=1), np.where(there, frames, 0.0)
    mean = np.add.accumulate(filled, axis=1)[:, -1] / np.where(count, count, np.nan)
    apart = (np.where(there, frames - mean[:, None], 0.0) ** 2).sum(axis=1)
    middle = np.maximum((count - 1) // 2, 0)
    return {"median": np.sort(frames, axis=1)[np.arange(len(frames)), middle], "avg": mean,
            "std": np.sqrt(apart / np.where(count > 1, count - 1, np.nan)), "max": np.fmax.reduce(frames, axis=1)}


def running_meters(stream: DataFrame, name: str, step: str, value: str, window: int = 20) -> DataFrame:
    """name, step, value; median, avg, std, max of the last ``window`` rows, ``global_avg`` and number (``steps``) of all so far.

    The median of an even number of values is the lower middle one, NULLs are
    passed over, and a deviation needs two values, as in the meters over whole
    tables. Within one batch rows are taken in the order of ``step``, then
    ``value``; batches follow each other as they arrive, so a step that comes late
    is counted where it comes. A series without a name is a series like others.
    State is ``window - 1`` values a series. A task holds the rows that a series has
    in one batch: bound it where the stream is read, by ``maxBytesPerTrigger``.
    """
    kinds = {f.name: f.dataType for f in stream.schema}
    layout = T.StructType([T.StructField(name, kinds[name]), T.StructField(step, kinds[step])]
                          + [T.StructField(c, T.DoubleType())
                             for c in (value, "median", "avg", "std", "max", "global_avg")] + [T.StructField("steps", T.LongType())])

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n, total = state.get if state.exists else ([], 0, 0.0)
        rows = pd.concat(list(parts)).sort_values([step, value], kind="stable")
        own = rows[value].to_numpy("float64", na_value=np.nan)
        kept = np.array([np.nan if v is None else v for v in last], np.float64)
        before = np.concatenate([np.full(window - 1 - len(kept), np.nan), kept])
        every = np.concatenate([before, own])
        out = pd.concat([pd.DataFrame(_meters(every[at:at + ROWS + window - 1], window))
                         for at in range(0, len(own), ROWS)], ignore_index=True)
        counts, sums = n + np.cumsum(~np.isnan(own)), np.cumsum(np.concatenate([[total], np.nan_to_num(own)]))[1:]
        out["global_avg"] = np.where(counts > 0, sums / np.maximum(counts, 1), np.nan)
        out["steps"] = counts
        kept = [None if np.isnan(v) else float(v) for v in every[len(every) - window + 1:]]
        state.update((kept, int(counts[-1]), float(sums[-1])))
        out.insert(0, name, [key[0]] * len(out))
        out.insert(1, step, rows[step].to_numpy())
        out.insert(2, value, own)
        yield out

    narrow = stream.select(name, step, F.col(value).cast("double").alias(value))
    return narrow.groupBy(name).applyInPandasWithState(run, layout, STATE, "append", GroupStateTimeout.NoTimeout)
