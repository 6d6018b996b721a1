"""Scalar expressions: normalisation, calendar, dates, cleaning."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime, time

from pyspark.sql import Column, DataFrame, functions as F

from fluxframe import vocab


def _centre_and_span(name: str) -> tuple[float, float]:
    low, high, cyclic = vocab.BOUNDS[name]
    return (low + high) / 2, (high - low) / (2 if cyclic else 1)


def normalise(name: str, col: Column, strict_bounds: bool = True) -> Column:
    """Centre and scale one variable; values outside its bounds become NULL.

    SWC_* and WTD have their bounds the wrong way round, so with strict bounds
    no value is ever inside and the whole column becomes NULL. That is what the
    published data went through; ``strict_bounds=False`` orders the bounds.
    """
    low, high, _ = vocab.BOUNDS[name]
    if not strict_bounds:
        low, high = min(low, high), max(low, high)
    centre, span = _centre_and_span(name)
    return F.when(col.between(low, high), (col - centre) / span)


def normalise_all(df: DataFrame, strict_bounds: bool = True) -> DataFrame:
    found = [c for c in vocab.PREDICTORS if c in df.columns]
    return df.withColumns({c: normalise(c, F.col(c), strict_bounds) for c in found})


def normalise_value(name: str, value: float) -> float:
    """The same scaling for one literal, without the bounds check."""
    centre, span = _centre_and_span(name)
    return (value - centre) / span


def day_of_year(ts: Column) -> Column:
    return F.dayofyear(ts)


def time_of_day(ts: Column) -> Column:
    """Hour counted from 1."""
    return F.hour(ts) + 1


def timestamp_to_int(ts: Column) -> Column:
    """YYYYMMDDHHMMSS, built from parts so that it stays in generated code."""
    clock = F.hour(ts) * 10000 + F.minute(ts) * 100 + F.second(ts)
    return date_number(ts).cast("long") * 1_000_000 + clock


def int_to_date(ts_int: Column) -> Column:
    """First eight digits of a YYYYMMDDHHMMSS number."""
    return F.floor(ts_int / 1_000_000).cast("int")


def date_number(ts: Column) -> Column:
    """YYYYMMDD of a timestamp."""
    return F.year(ts) * 10000 + F.month(ts) * 100 + F.dayofmonth(ts)


def asset_date(name: Column) -> Column:
    """Date of an asset called ``.../YYYY_MM_DD``; malformed names give NULL."""
    leaf = F.element_at(F.split(name, "/"), -1)
    dashed = F.when(leaf.rlike(r"^\d{4}_\d{2}_\d{2}$"), F.replace(leaf, F.lit("_"), F.lit("-")))
    return dashed.try_cast("date")


def digits_to_timestamp(digits: Column) -> Column:
    """8 or 14 digits -> timestamp without zone; anything else, or no date, is NULL."""
    day = F.regexp_replace(digits, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    spaced = F.regexp_replace(day, r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1-$2-$3 $4:$5:$6")
    return F.when(digits.rlike(r"^(\d{8}|\d{14})$"), spaced).try_cast("timestamp_ntz")


# Accepted date texts by shape; the first two are whole days.
DATE_SHAPES = (
    (r"^\d{4}-\d{2}-\d{2}$", "%Y-%m-%d", True),
    (r"^\d{8}$", "%Y%m%d", True),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "%Y-%m-%dT%H:%M:%S", False),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "%Y-%m-%d %H:%M:%S", False),
    (r"^\d{14}$", "%Y%m%d%H%M%S", False),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}$", "%Y-%m-%dT%H:%M", False),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$", "%Y-%m-%d %H:%M", False),
    (r"^\d{12}$", "%Y%m%d%H%M", False),
)


def parse_bound_column(text: Column, is_end: bool) -> Column:
    """Date text -> YYYYMMDDHHMMSS, whole days stretched to 23:59:59 for an end.

    The shape decides the format, so twelve digits are always minutes. Text of
    no known shape, or no valid date, gives NULL. Each value is parsed once:
    its digits alone, filled up with zeros, are the number.
    """
    trimmed = F.trim(text)
    digits = F.rpad(F.regexp_replace(trimmed, "[^0-9]", ""), 14, "0")
    shaped = trimmed.rlike("|".join(shape for shape, *_ in DATE_SHAPES))
    valid = digits_to_timestamp(F.when(shaped, digits)).isNotNull()
    number = digits.cast("long")
    if is_end:
        whole_day = trimmed.rlike("|".join(shape for shape, *_, whole in DATE_SHAPES if whole))
        number = F.when(whole_day, number + 235959).otherwise(number)
    return F.when(valid, number)


def parse_bound(text: str, is_end: bool) -> tuple[int, str]:
    """One bound given on a command line -> (number, label for file names)."""
    trimmed = text.strip()
    for shape, python_format, whole_day in DATE_SHAPES:
        if not re.match(shape, trimmed):
            continue
        try:
            moment = datetime.strptime(trimmed, python_format)
        except ValueError:
            break
        if whole_day:
            label = moment.strftime("%Y%m%d")
            moment = datetime.combine(moment.date(), time(23, 59, 59) if is_end else time())
        else:
            label = moment.strftime("%Y%m%d%H%M%S")
        return int(moment.strftime("%Y%m%d%H%M%S")), label
    raise ValueError(f"not a date: {text!r}")


def date_range(start: str | None, end: str | None) -> tuple[int | None, int | None, str | None]:
    """Inclusive bounds and a tag such as ``20170601_to_20170630``."""
    low = parse_bound(start, False) if start is not None else (None, None)
    high = parse_bound(end, True) if end is not None else (None, None)
    if low[0] is not None and high[0] is not None and high[0] < low[0]:
        raise ValueError("the end lies before the start")
    if start is None and end is None:
        return None, None, None
    return low[0], high[0], f"{low[1] or 'start'}_to_{high[1] or 'end'}"


def whole_column_timestamp(df: DataFrame, column: str) -> DataFrame:
    """Turn an integer column into timestamps if *all* its values allow it.

    All 14 digits, or all 8 digits, and all valid; otherwise it stays as it is.
    Only the one-row verdict reaches the driver.
    """
    text = F.col(column).cast("string")
    parsed = digits_to_timestamp(text)
    verdict = df.agg(F.min(F.length(text)).alias("short"), F.max(F.length(text)).alias("long"),
                     F.bool_and(parsed.isNotNull()).alias("valid")).first()
    fits = verdict.valid and verdict.short == verdict.long
    return df.withColumn(column, parsed) if fits else df


def clean_target(col: Column, limit: float = vocab.TARGET_LIMIT) -> Column:
    """Infinities, NaN and magnitudes beyond the limit become NULL."""
    return F.when(F.abs(col) <= limit, col)


def to_number(text: Column) -> Column:
    """Text that is no number becomes NULL."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def clamp(col: Column, low, high) -> Column:
    return F.least(F.greatest(col, F.lit(low)), F.lit(high))


def scale_static(name: str, col: Column) -> Column:
    """Static predictors as the model sees them: scaled, single precision."""
    return (col / vocab.STATIC_SCALE[name]).cast("float")


def unscale_degrees(scaled: Column) -> Column:
    return scaled.cast("double") * 180.0


def override_low_light(predictions: Sequence[str], light: Column, threshold: float) -> dict[str, Column]:
    """Set the GPP outputs to 0 where normalised light is below the threshold.

    Missing light compares as unknown, so those rows stay as they are.
    """
    flux = {c: c.removeprefix("pred_") for c in predictions}
    affected = [c for c in predictions if flux[c] == "GPP" or flux[c].startswith("GPP_")]
    if not affected:
        raise ValueError("no GPP output to override")
    return {c: F.when(light < threshold, F.lit(0.0)).otherwise(F.col(c)) for c in affected}


def learning_rate(epoch: Column, peak: float, floor: float, warmup: float, total: float) -> Column:
    """Linear warm-up, then half a cosine down to ``floor``."""
    progress = (epoch - warmup) / (total - warmup)
    cosine = floor + (peak - floor) * 0.5 * (1.0 + F.cos(F.lit(3.141592653589793) * progress))
    return F.when(epoch < warmup, peak * epoch / warmup).otherwise(cosine)


def scaled_peak(base: float, batch: int, accumulate: int, workers: int) -> float:
    """Learning rate for an effective batch, given per 256 samples."""
    return base * batch * accumulate * workers / 256


def gaussian_nll(y: Column, mean: Column, sigma: Column) -> Column:
    """Negative log likelihood per row, with sigma kept above 1e-6."""
    s2 = F.pow(F.greatest(sigma, F.lit(1e-6)), 2)
    return 0.5 * F.log(F.lit(6.283185307179586) * s2) + 0.5 * F.pow(y - mean, 2) / s2


def activation(name: str, x: Column) -> Column:
    """Activations that Spark can express; the error-function one runs in the model."""
    known = {
        "relu": F.greatest(x, F.lit(0.0)),
        "relu6": clamp(x, 0.0, 6.0),
        "sigmoid": 1.0 / (1.0 + F.exp(-x)),
        "tanh": F.tanh(x),
    }
    return known[name]
