"""Text expressions: formats, names, file lists, sizes, labels."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fluxframe import vocab


def fixed(col: Column, decimals: int, missing: str = "") -> Column:
    """Fixed-point text, ties to even; missing numbers give the token."""
    number = col.cast("double")
    return F.when(number.isNotNull() & ~F.isnan(number), _printed(number, decimals)).otherwise(F.lit(missing))


def _printed(number: Column, decimals: int, unit: str = "") -> Column:
    # the formatter alone would round ties up; rounding alone drops the sign of zero
    rounded = F.bround(number, decimals)
    shown = F.format_string(f"%.{decimals}f{unit}", rounded)
    return F.when((number < 0) & (rounded == 0), F.concat(F.lit("-"), F.ltrim(shown, F.lit("-")))).otherwise(shown)


def thousands(col: Column) -> Column:
    return F.format_number(col.cast("long"), 0)


def metric_label(name: Column) -> Column:
    """rmse_GPP_DT -> GPP, nse_GPP_NT -> GPPNT, rmse_NEE -> NEE."""
    bare = F.regexp_replace(name, "^(rmse_|nse_)", "")
    bare = F.regexp_replace(bare, "(?i)_?dt$", "")
    return F.upper(F.replace(bare, F.lit("_"), F.lit("")))


def metric_label_of(name: str) -> str:
    """The same for a column name on the driver."""
    bare = re.sub("^(rmse_|nse_)", "", name)
    return re.sub("(?i)_?dt$", "", bare).replace("_", "").upper()


def partner_metric(name: Column) -> Column:
    return F.regexp_replace(name, "^rmse_", "nse_")


def infrared_files(files: Column) -> Column:
    return F.filter(F.split(files, ","), lambda f: F.contains(f, F.lit("_IR_")))


def colour_files(files: Column) -> Column:
    return F.filter(F.split(files, ","), lambda f: ~F.contains(f, F.lit("_IR_")))


def raster_name_parts(path: Column) -> tuple[Column, Column]:
    """(timestamp, product) of ``<12 digits>A2|A4.tiff``; empty text if no match."""
    leaf = F.element_at(F.split(path, "/"), -1)
    pattern = r"^(\d{12})(A2|A4)\.tiff$"
    return F.regexp_extract(leaf, pattern, 1), F.regexp_extract(leaf, pattern, 2)


def raster_name(day: Column, product: Column) -> Column:
    return F.concat(F.date_format(day, "yyyyMMdd"), F.lit("1200"), product, F.lit(".tiff"))


def shard_name(rank: Column) -> Column:
    return F.format_string("rank_%05d.csv", rank.cast("int"))


def quote_identifier(name: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))


def escape_underscores(text: Column) -> Column:
    return F.replace(text, F.lit("_"), F.lit("\\_"))


def bold(text: Column) -> Column:
    return F.concat(F.lit("\\textbf{"), text, F.lit("}"))


def compact(text: Column, width: int) -> Column:
    """Collapse white space and shorten with three dots."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    if width < 3:
        return flat
    return F.when(F.length(flat) > width,
                  F.concat(F.substring(flat, 1, width - 3), F.lit("..."))).otherwise(flat)


def human_bytes(size: Column) -> Column:
    """1536 -> 1.5 KiB, up to TiB."""
    size = size.cast("double")
    result = _printed(size / 1024.0 ** 4, 1, " TiB")
    for power, unit in ((3, "GiB"), (2, "MiB"), (1, "KiB")):
        result = F.when(F.abs(size) < 1024.0 ** (power + 1),
                        _printed(size / 1024.0 ** power, 1, " " + unit)).otherwise(result)
    return F.when(F.abs(size) < 1024.0, _printed(size, 0, " B")).otherwise(result)


def human_duration(seconds: Column) -> Column:
    """3725 -> 1h02m05s; negative counts as zero."""
    whole = F.greatest(seconds.cast("long"), F.lit(0).cast("long"))
    hours, minutes, rest = F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60
    return (F.when(hours > 0, F.format_string("%dh%02dm%02ds", hours, minutes, rest))
            .when(minutes > 0, F.format_string("%dm%02ds", minutes, rest))
            .otherwise(F.format_string("%ds", rest)))


def degree_label(value: Column, is_lon: bool) -> Column:
    negative, positive = ("W", "E") if is_lon else ("S", "N")
    number = F.abs(value).cast("int").cast("string")
    side = F.concat(number, F.lit("°"), F.when(value < 0, F.lit(negative)).otherwise(F.lit(positive)))
    plain = (value == 0) | (F.abs(value) == 180) if is_lon else value == 0
    return F.when(plain, F.concat(number, F.lit("°"))).otherwise(side)


def class_of_code(code: Column, at_ingest: bool) -> Column:
    """Land-cover code -> class. Ingest leaves two codes empty."""
    pairs = [F.lit(x) for k, v in vocab.CLASS_OF_CODE.items()
             if not (at_ingest and k in vocab.CODES_EMPTY_AT_INGEST) for x in (k, v)]
    return F.try_element_at(F.create_map(*pairs), code.cast("int"))


def _legend_map(field: int) -> Column:
    return F.create_map(*[F.lit(x) for row in vocab.LEGEND for x in (row[0], row[field])])


def class_colour(label: Column, fallback_index: Column | None = None) -> Column:
    """Colour of a class; unknown ones cycle through the fallback colours."""
    index = F.lit(0) if fallback_index is None else fallback_index
    spare = F.array(*[F.lit(c) for c in vocab.FALLBACK_COLOURS])
    cycled = F.element_at(spare, (F.pmod(index, F.lit(len(vocab.FALLBACK_COLOURS))) + 1).cast("int"))
    return F.coalesce(F.try_element_at(_legend_map(1), label), cycled)


def class_name(label: Column) -> Column:
    return F.coalesce(F.try_element_at(_legend_map(2), label), label)


def legend_position(label: Column) -> Column:
    """Position in the legend; unknown classes come after all known ones."""
    order = F.array(*[F.lit(row[0]) for row in vocab.LEGEND])
    found = F.array_position(order, label)
    return F.when(found > 0, found).otherwise(F.lit(len(vocab.LEGEND) + 1).cast("long"))


def in_legend_order(df: DataFrame, label: str) -> DataFrame:
    return df.orderBy(legend_position(F.col(label)), label)


def legend_only(df: DataFrame, label: str) -> DataFrame:
    return df.where(~F.col(label).isin(*vocab.LEGEND_HIDDEN))


def upper_unique(values: Column) -> Column:
    """Trim, upper-case and de-duplicate a list, keeping its order."""
    return F.array_distinct(F.transform(values, lambda v: F.upper(F.trim(v))))


def split_names(values: Iterable[str] | None, prefix: str = "") -> list[str] | None:
    """Names given as several comma- or space-separated arguments, each once."""
    if values is None:
        return None
    names = [n for v in values for n in v.replace(",", " ").split()]
    full = [n if n.startswith(prefix) else prefix + n for n in names]
    if not full:
        raise ValueError("no name given")
    return list(dict.fromkeys(full))


def pick_targets(columns: Sequence[str], wanted: Iterable[str] | None) -> list[str]:
    """Requested ``pred_*`` columns; all of them when nothing is asked for."""
    offered = [c for c in columns if c.startswith("pred_")]
    asked = split_names(wanted, "pred_")
    if asked is None:
        return offered
    unknown = [a for a in asked if a not in offered]
    if unknown:
        raise ValueError(f"unknown targets {unknown}; available: {offered}")
    return asked


def preferred_first(names: Sequence[str], preferred: Sequence[str]) -> list[str]:
    return [p for p in preferred if p in names] + [n for n in names if n not in preferred]
