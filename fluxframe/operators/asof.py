"""As-of lookup: the latest item dated at or before each row, per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T

from fluxframe.functions.scalars import date_number, int_to_date
from fluxframe.operators.ordering import Hot, Limit, find_hot, running_last, spread


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str,
                  right_time: str, payload: dict[str, str], limit: Limit = None) -> DataFrame:
    """Left rows with columns of the latest right row whose time is not later.

    Both sides go through one sort per key and the latest right row is carried
    forward, so the work is linear: no pair of rows is ever formed. ``payload``
    maps new column names to right columns; keep it narrow and fetch wide
    columns by key afterwards. Right rows must be unique on keys and time.
    Left rows without an earlier right row get NULLs.
    """
    keys = list(keys)
    item = F.struct(*[F.col(src).alias(dst) for dst, src in payload.items()])
    # keys stay outside the row: what follows on the same keys needs no new shuffle
    row = F.struct(F.lit(True).alias("__left"), *[F.col(c) for c in left.columns if c not in keys])
    rights = right.select(*keys, F.col(right_time).alias("__time"), F.lit(0).alias("__side"),
                          item.alias("__item"))
    lefts = left.select(*keys, F.col(left_time).alias("__time"), F.lit(1).alias("__side"),
                        row.alias("__row"))
    both = rights.unionByName(lefts, allowMissingColumns=True)
    found = running_last(both, keys, ["__time", "__side"], "__item", "__match", limit=limit)
    return (found.where(F.col("__side") == 1)
            .select(*[F.col(c if c in keys else f"__row.{c}").alias(c) for c in left.columns],
                    *[F.col(f"__match.{n}").alias(n) for n in payload]))


def with_image_date(rows: DataFrame, images: DataFrame, limit: Limit = None) -> DataFrame:
    """Attach ``image_date``, the date of the location's latest image, or NULL.

    ``timestamp`` is a YYYYMMDDHHMMSS number, or a timestamp where seconds are too
    coarse to order the rows. Only dates take part in the sort; what follows on the
    same location needs no new shuffle.
    """
    dates = images.select("coord_id", "modis_date")
    exact = isinstance(rows.schema["timestamp"].dataType, (T.TimestampType, T.TimestampNTZType))
    dated = rows.withColumn("__date", (date_number if exact else int_to_date)(F.col("timestamp")))
    return asof_backward(dated, dates, ["coord_id"], "__date", "modis_date",
                         {"image_date": "modis_date"}, limit=limit).drop("__date")


def with_tensor(rows: DataFrame, images: DataFrame) -> DataFrame:
    """Attach the tensor of ``image_date`` as ``data``.

    Where the session lets joins use part of their keys, rows distributed by
    location stay where they are and the tensors come to them. Rows without an
    image match nothing; they are spread by time instead of piling up.
    """
    nowhere = -1 - F.pmod(F.xxhash64("timestamp"), F.lit(1_000_000)).cast("int")
    keyed = rows.withColumn("__at", F.coalesce("image_date", nowhere))
    tensors = images.select("coord_id", F.col("modis_date").alias("__at"), "data")
    return keyed.join(tensors, ["coord_id", "__at"], "left").drop("__at")


def with_tensors(rows: DataFrame, images: DataFrame) -> DataFrame:
    """Attach the tensors of all ``image_dates`` as ``images``, in their order.

    Dates are looked up one by one and put together again by row id.
    """
    asked = rows.select("id", "coord_id", F.posexplode("image_dates").alias("__n", "__at"))
    tensors = images.select("coord_id", F.col("modis_date").alias("__at"), "data")
    found = asked.join(tensors, ["coord_id", "__at"]).groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("__n", "data"))).alias("__found"))
    none = F.array().cast(found.select(F.col("__found.data")).schema[0].dataType)
    joined = rows.join(found, "id", "left")
    return joined.withColumn("images", F.coalesce(F.col("__found.data"), none)).drop("__found")


def latest_image(rows: DataFrame, images: DataFrame, since=None, limit: Limit = None) -> DataFrame:
    """Attach the latest image of the row's location, or NULL if there is none.

    With ``since`` only rows not before it get one.
    """
    matched = with_image_date(rows, images, limit=limit)
    if since is not None:
        matched = matched.withColumn(
            "image_date", F.when(F.col("timestamp") >= F.lit(since), F.col("image_date")))
    return with_tensor(matched, images)


def distinct_images(facts: DataFrame, images: DataFrame, key: str, date: str, image_date: str,
                    order: Sequence[str], length: int, limit: Limit = None) -> DataFrame:
    """The different images in use over each trailing window, oldest first.

    Every row first gets its own image date; the window then collects the dates
    that occur in it. Rows before the first image contribute nothing.
    """
    limit = limit if isinstance(limit, Hot) else find_hot(facts.select(key).union(images.select(key)), [key], limit)
    matched = asof_backward(facts, images, [key], date, image_date, {"__image": image_date}, limit=limit)
    s = spread(matched, [key], order, reach=length - 1, limit=limit)
    frame = s.window(order).rowsBetween(-(length - 1), Window.currentRow)
    dates = F.array_sort(F.collect_set("__image").over(frame))
    return s.own(s.rows.withColumn("image_dates", dates)).drop("__image")
