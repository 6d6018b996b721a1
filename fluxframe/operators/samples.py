"""Sample indexes and trailing windows.

Two populations that must not be mixed up. Grid samples count *rows* per
location, with rows before the start date serving as context. Site samples
count rows that have a target but look back over *ids*.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fluxframe import vocab
from fluxframe.functions.arrays import first_or_empty
from fluxframe.functions.scalars import clean_target, scale_static
from fluxframe.functions.text import colour_files, infrared_files
from fluxframe.operators.asof import with_image_date, with_tensor, with_tensors
from fluxframe.operators.numbering import number_rows
from fluxframe.operators.ordering import (Hot, Limit, find_hot, from_nth_row, keyed_join,
                                          nth_row, over_last_rows)


STATICS = (*vocab.STATIC, "igbp")


def without_classes(facts: DataFrame, dim: DataFrame, classes: Sequence[str], key: str = "coord_id",
                    label: str = "igbp") -> DataFrame:
    """Drop facts of locations in the given classes.

    Locations without a class, or missing from the dimension, stay.
    """
    if not classes:
        return facts
    excluded = dim.where(F.col(label).isin(*[c.strip().upper() for c in classes])).select(key)
    return facts.join(excluded, key, "left_anti")


def grid_sample_index(facts: DataFrame, length: int, start=None, end=None, key: str = "coord_id",
                      time: str = "timestamp", row_id: str = "id", limit: Limit = None) -> DataFrame:
    """Rows that have at least ``length - 1`` predecessors at their location.

    The end bound cuts the rows that are counted; the start bound only cuts the
    rows that are returned.
    """
    counted = facts if end is None else facts.where(F.col(time) <= F.lit(end))
    returned = counted if start is None else counted.where(F.col(time) >= F.lit(start))
    return from_nth_row(counted, [key], [time, row_id], length, rows=returned, limit=limit)


def site_sample_index(facts: DataFrame, targets: Sequence[str], length: int, key: str = "site",
                      row_id: str = "id", limit: Limit = None) -> DataFrame:
    """Rows with any target, less the first ``length - 1`` such rows per site."""
    usable = facts.where(F.coalesce(*targets).isNotNull())
    return from_nth_row(usable, [key], [row_id], length, limit=limit)


def trailing_frames(facts: DataFrame, key: str, order: Sequence[str], length: int,
                    fields: Sequence[str], out: str = "frame", limit: Limit = None) -> DataFrame:
    """The last ``length`` rows per location, oldest first; short frames are left out."""
    item = F.struct(*order, *fields)
    framed = over_last_rows(facts, [key], order, length, {out: F.collect_list(item)}, limit=limit)
    return framed.where(F.size(out) == length)


def over_id_range(facts: DataFrame, key: str, row_id: str, length: int, values: dict[str, Column],
                  block: int = 1_000_000) -> DataFrame:
    """Aggregates over the rows of the key whose id lies in ``[id-length+1, id]``.

    Ids are cut into blocks; each block also gets the rows it reaches back to.
    Ids are unique, so no task holds more than ``block + length`` rows of a key
    however many rows the key has.
    """
    block = max(block, length)
    home = F.floor(F.col(row_id) / block)
    furthest = F.floor((F.col(row_id) + length - 1) / block)
    blocks = facts.withColumn("__block", F.explode(F.sequence(home, furthest)))
    frame = (Window.partitionBy(key, "__block").orderBy(row_id)
             .rangeBetween(-(length - 1), Window.currentRow))
    return (blocks.select("*", *[v.over(frame).alias(n) for n, v in values.items()])
            .where(F.col("__block") == home).drop("__block"))


def site_frames(facts: DataFrame, length: int, fields: Sequence[str], out: str = "frame") -> DataFrame:
    """Trailing window of a site row by id distance; id gaps make it shorter."""
    item = F.struct("id", "timestamp", *fields)
    return over_id_range(facts, "site", "id", length, {out: F.collect_list(item)})


def one_per_row(images: DataFrame, row_id: str, payload: str, order: Sequence[str] = ()) -> DataFrame:
    """``id`` and ``image``: one image for each row id, the first by ``order``.

    Without an order the smallest payload counts, so that the choice is always
    the same.
    """
    first = F.min_by(payload, F.struct(*order)) if order else F.min(payload)
    return images.groupBy(F.col(row_id).alias("id")).agg(first.alias("image"))


def first_image_in_window(facts: DataFrame, images: DataFrame, key: str, row_id: str, image_id: str,
                          payload: str, length: int, out: str = "image", order: Sequence[str] = ()) -> DataFrame:
    """The oldest image among the rows of the id window.

    Images are matched to their own row first, by equality, so no range join
    is needed. Of several images on one row the first by ``order`` counts.
    """
    single = one_per_row(images, image_id, payload, order)
    pictured = keyed_join(facts, single.select(F.col("id").alias(row_id), F.col("image").alias("__image")), [row_id])
    return over_id_range(pictured, key, row_id, length,
                         {out: F.first("__image", ignorenulls=True)}).drop("__image")


def dim_lookup(facts: DataFrame, dim: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """Attach the attributes of a location; a missing location is an error.

    Spark broadcasts the dimension if its size is below the session's limit and
    otherwise splits the partitions of hot locations.
    """
    flagged = dim.withColumn("__known", F.lit(True))
    joined = facts.join(flagged, key, "left")
    if strict:
        # raised by the row itself, in the same pass
        checked = F.coalesce(F.col("__known"),
                             F.raise_error(F.concat(F.lit(f"no dimension row for {key} "),
                                                    F.coalesce(F.col(key).cast("string"), F.lit("NULL"))))
                             .cast("boolean"))
        joined = joined.where(checked)
    return joined.drop("__known")


def scaled_statics(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: scale_static(c, F.col(c)) for c in vocab.STATIC})


def of_entities(facts: DataFrame, entities: DataFrame | Sequence, key: str) -> DataFrame:
    """Facts of the listed entities (a split, or those still active)."""
    if isinstance(entities, DataFrame):
        return facts.join(entities.select(key), key, "left_semi")
    return facts.where(F.col(key).isin(*entities))


def with_split(facts: DataFrame, splits: dict[str, Sequence], key: str, out: str = "split") -> DataFrame:
    """Label rows train/val/test by disjoint entity lists; unlisted rows are dropped."""
    listed = [e for members in splits.values() for e in members]
    if len(listed) != len(set(listed)):
        raise ValueError("an entity is in two splits")
    label = F.lit(None).cast("string")
    for name, members in splits.items():
        label = F.when(F.col(key).isin(*members), F.lit(name)).otherwise(label)
    return facts.withColumn(out, label).where(F.col(out).isNotNull())


def hash_order(row_id: str, *salt) -> Column:
    """A repeatable pseudo-random sort key."""
    return F.md5(F.concat_ws(":", *[F.lit(str(x)) for x in salt], F.col(row_id).cast("string")))


def epoch_order(samples: DataFrame, row_id: str, seed: int, epoch: int, out: str = "position") -> DataFrame:
    """Positions of a repeatable shuffle that differs from epoch to epoch.

    Rank r of n workers takes the positions with remainder r.
    """
    shuffled = samples.withColumn("__hash", hash_order(row_id, seed, epoch))
    return number_rows(shuffled, ["__hash", row_id], out).drop("__hash")


def reservoir(rows: DataFrame, row_id: str, k: int, seed: int = 0) -> DataFrame:
    """A uniform sample of k rows: those with the smallest hashes."""
    return rows.orderBy(hash_order(row_id, seed), row_id).limit(k)


def ordered_samples(index: DataFrame, key: str = "coord_id", time: str = "timestamp",
                    row_id: str = "id", out: str = "__sample_order") -> DataFrame:
    """0-based global position over (location, time, id)."""
    return number_rows(index, [key, time, row_id], out)


def order_slice(numbered: DataFrame, first: int, stop: int, order: str = "__sample_order") -> DataFrame:
    return numbered.where((F.col(order) >= first) & (F.col(order) < stop))


def site_samples(facts: DataFrame, dim: DataFrame, length: int, predictors: Sequence[str],
                 targets: Sequence[str], images: DataFrame | None = None,
                 photos: DataFrame | None = None, single_image: bool = True,
                 sites: Sequence[str] | None = None) -> DataFrame:
    """Complete site samples: window, static attributes, images, cleaned targets.

    One row per indexed id with the window as an array of structs. Everything
    is joined to the narrow rows, so the windows themselves are never shuffled.
    """
    facts = facts if sites is None else of_entities(facts, sites, "site")
    has_target = F.coalesce(*targets).isNotNull()
    # whether a row is a sample is decided on the targets as stored
    gate = nth_row(facts.where(has_target), ["site"], ["id"], length)
    rows = keyed_join(facts, gate.withColumnRenamed("id", "__gate"), ["site"])
    rows = rows.withColumn("__sample", has_target & (F.col("id") >= F.col("__gate"))).drop("__gate")
    rows = rows.withColumns({t: clean_target(F.col(t)) for t in targets})
    rows = scaled_statics(dim_lookup(rows, dim, "site"))

    values = {"frame": F.collect_list(F.struct("id", "timestamp", *predictors, *targets))}
    if images is not None and single_image:
        single = one_per_row(images, "row_id", "data", [c for c in ("modis_id",) if c in images.columns])
        rows = rows.join(single.withColumnRenamed("image", "__img"), "id", "left")
        values["images"] = F.first("__img", ignorenulls=True)
    elif images is not None:
        order = ["modis_id"] if "modis_id" in images.columns else ["data"]
        item = F.struct(*[F.col(c).alias(f"__{n}") for n, c in enumerate(order)], F.col("data").alias("__data"))
        several = images.groupBy(F.col("row_id").alias("id")).agg(F.array_sort(F.collect_list(item)).alias("__several"))
        rows = rows.join(several.select("id", F.col("__several.__data").alias("__img")), "id", "left")
        values["images"] = F.collect_list("__img")
    if photos is not None:
        rows = rows.join(photos.select(F.col("row_id").alias("id"), F.col("files").alias("__pics")), "id", "left")
        values["__files"] = F.collect_list("__pics")

    framed = over_id_range(rows, "site", "id", length, values).where(F.coalesce("__sample", F.lit(False)))
    framed = framed.drop("__img", "__pics", "__sample")
    if images is not None and not single_image:
        framed = framed.withColumn("images", F.flatten("images"))
    if images is not None and single_image:
        framed = framed.withColumn("images", F.when(F.col("images").isNotNull(), F.array("images"))
                                   .otherwise(F.array().cast(framed.select(F.array("images")).schema[0].dataType)))
    if photos is not None:
        joined = F.array_join("__files", ",")
        for column, files in (("photos_ir", infrared_files(joined)), ("photos_rgb", colour_files(joined))):
            found = F.when(F.size("__files") > 0, files).otherwise(F.array().cast("array<string>"))
            framed = framed.withColumn(column, first_or_empty(found) if single_image else found)
        framed = framed.drop("__files")
    return framed


def grid_samples(facts: DataFrame, dim: DataFrame, length: int, predictors: Sequence[str],
                 images: DataFrame | None = None, start=None, end=None,
                 exclude: Sequence[str] = (), limit: Limit = None, single_image: bool = True) -> DataFrame:
    """Complete grid samples: window, static attributes and latest image.

    ``timestamp`` is a YYYYMMDDHHMMSS number or a timestamp, and the bounds are of
    its type; numbers know no fractions of a second, so those need the latter.
    The facts are shuffled by location once: images are found as dates in that
    order, windows are built, rows that are no samples go, and only then come
    attributes and tensors. The tensor join keeps the location's distribution.
    With ``single_image`` off, ``images`` holds the different images in use over
    the window, oldest first, and ``image_dates`` their dates.
    """
    rows = without_classes(facts, dim, exclude).select("id", "coord_id", "timestamp", *predictors)
    rows = rows if end is None else rows.where(F.col("timestamp") <= F.lit(end))
    if not isinstance(limit, Hot):
        counted = rows.select("coord_id")
        counted = counted if images is None else counted.union(images.select("coord_id"))
        limit = find_hot(counted, ["coord_id"], limit)
    carried: list[str] = []
    order = ["timestamp", "id"]
    if images is not None:
        rows = with_image_date(rows, images, limit=limit)
        carried = ["image_date"]
    values = {"frame": F.collect_list(F.struct(*order, *predictors))}
    if images is not None and not single_image:
        values["image_dates"] = F.collect_set("image_date")
        carried = ["image_dates"]
    framed = over_last_rows(rows, ["coord_id"], order, length, values, limit=limit).where(F.size("frame") == length)
    if "image_dates" in values:
        framed = framed.withColumn("image_dates", F.array_sort("image_dates"))
    framed = framed if start is None else framed.where(F.col("timestamp") >= F.lit(start))
    framed = framed.select("id", "coord_id", "timestamp", "frame", *carried)
    framed = scaled_statics(dim_lookup(framed, dim.select("coord_id", *STATICS), "coord_id"))
    if images is not None and single_image:
        framed, carried = with_tensor(framed, images), ["image_date", "data"]
    elif images is not None:
        framed, carried = with_tensors(framed, images), ["image_dates", "images"]
    return framed.select("id", "coord_id", "timestamp", "frame", *STATICS, *carried)
