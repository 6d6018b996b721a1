"""Order-based operators that no hot key can pin to one task.

A plain ``Window.partitionBy(key)`` sorts all rows of a key in one task. Here
keys are counted first; those beyond the limit (at most rows/limit of them)
are cut into equal chunks along the order, and each chunk gets the few rows
before it that its frames reach. All other keys take the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from fluxframe.session import hot_key_rows, settle

CHUNK, HALO, SEQ, PLACE = "__chunk", "__halo", "__seq", "__place"
WHOLE = -1  # chunk number of keys that were not cut
ROW_BYTES = 8  # what a stored row takes at least, for estimates


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row that settles ties in an order; rows that agree in it are equal.

    Maps have no order of their own and are hashed as sorted entries, maps
    inside other values as text.
    """
    def holds_map(kind: T.DataType) -> bool:
        return "map<" in kind.simpleString()

    def hashable(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.MapType) and not holds_map(field.dataType.valueType):
            return F.array_sort(F.map_entries(column))
        return F.to_json(F.struct(column)) if holds_map(field.dataType) else column
    return F.xxhash64(*[hashable(f) for f in df.schema.fields])


def dense_order(df: DataFrame, order: Sequence[str | Column], name: str, start: int = 0) -> DataFrame:
    """Number all rows ``start, start+1, ...`` along a total order.

    One range shuffle: each slice is numbered on its own and shifted by the
    sizes of the slices before it. ``order`` must end in a unique column.
    """
    placed = settle(df.repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn(PLACE, F.monotonically_increasing_id()))
    # one number per slice, so no more than the shuffle has partitions
    slice_no = F.shiftright(PLACE, 33)
    sizes = {r["slice"]: r["count"] for r in placed.groupBy(slice_no.alias("slice")).count().collect()}
    shifts = [start]
    for n in range(max(sizes, default=0)):
        shifts.append(shifts[-1] + sizes.get(n, 0))
    shift = F.element_at(F.array(*[F.lit(n).cast("long") for n in shifts]), (slice_no + 1).cast("int"))
    in_slice = F.col(PLACE).bitwiseAND(F.lit((1 << 33) - 1))
    # a projection of a written table: its size stays known to the optimiser
    return placed.withColumn(name, shift + in_slice).drop(PLACE)


def keyed_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left",
               extra: Column | None = None) -> DataFrame:
    """Join on ``keys`` under which NULL equals NULL; keeps the left key columns.

    No broadcast is forced: Spark broadcasts the right side only when its
    measured size allows, and otherwise splits skewed partitions.
    """
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = extra
    for key in keys:
        equal = F.col(key).eqNullSafe(F.col(f"__r_{key}"))
        condition = equal if condition is None else condition & equal
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


@dataclass
class Hot:
    """Keys with more than ``limit`` rows: a written table, or None if there are none."""

    keys: list[str]
    limit: int
    table: DataFrame | None


#: How operators take it: rows a key may have, a count made before, or the default.
Limit = int | Hot | None


def find_hot(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> Hot:
    """Count rows per key, combining in the map tasks; only the keys are read.

    Where several operators follow on the same keys, count once at the source
    and hand the result to all of them. Input whose estimated size is below
    ``ROW_BYTES`` for each of ``limit`` rows is not counted at all: results are
    the same either way, and so little is no burden for one task.
    """
    limit = limit or hot_key_rows(df.sparkSession)
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < ROW_BYTES * limit:
        return Hot(list(keys), limit, None)
    crowded = df.groupBy(*keys).count().where(F.col("count") > limit).select(*keys)
    return Hot(list(keys), limit, None if crowded.isEmpty() else settle(crowded))


@dataclass
class Spread:
    """Rows ready for windows; with CHUNK, HALO and SEQ where keys were cut.

    Ties in the order are settled by ``tie`` in both cases, so that a result
    never depends on whether its key was cut.
    """

    rows: DataFrame
    keys: list[str]
    cut: bool
    tie: Column

    def window(self, order):
        if not self.cut:
            return Window.partitionBy(*self.keys).orderBy(*order, self.tie)
        # chunks were cut along the same order, tie included
        return Window.partitionBy(*self.keys, CHUNK).orderBy(*order, SEQ)

    def own(self, df: DataFrame) -> DataFrame:
        """Drop the helper rows and columns again."""
        return df.where(~F.col(HALO)).drop(CHUNK, HALO, SEQ) if self.cut else df


def spread(df: DataFrame, keys: Sequence[str], order: Sequence[str], reach: int = 0,
           limit: Limit = None) -> Spread:
    """Cut the hot keys of ``df`` into chunks of ``limit`` rows along ``order``.

    ``reach`` is how many preceding rows a frame looks back on.
    """
    keys = list(keys)
    # the hash also lets a flood of rows that tie in the order be cut
    tie = row_hash(df)
    hot = limit if isinstance(limit, Hot) else find_hot(df, keys, limit)
    if hot.table is None:
        return Spread(df, keys, False, tie)

    helpers = {CHUNK: F.lit(WHOLE).cast("long"), HALO: F.lit(False), SEQ: F.lit(None).cast("long")}
    cold_rows = keyed_join(df, hot.table, keys, "left_anti").withColumns(helpers)
    hot_rows = dense_order(keyed_join(df, hot.table, keys, "left_semi"), [*keys, *order, tie], SEQ)
    home = F.floor(F.col(SEQ) / hot.limit)
    furthest = F.floor((F.col(SEQ) + reach) / hot.limit)
    hot_rows = (hot_rows.withColumn(CHUNK, F.explode(F.sequence(home, furthest)))
                .withColumn(HALO, F.col(CHUNK) != home))
    columns = [*df.columns, CHUNK, HALO, SEQ]
    return Spread(cold_rows.select(*columns).unionByName(hot_rows.select(*columns)), keys, True, tie)


def over_last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], length: int,
                   values: dict[str, Column], limit: Limit = None) -> DataFrame:
    """Add aggregates over each row and the ``length - 1`` rows before it."""
    s = spread(df, keys, order, reach=length - 1, limit=limit)
    frame = s.window(order).rowsBetween(-(length - 1), Window.currentRow)
    return s.own(s.rows.select("*", *[v.over(frame).alias(n) for n, v in values.items()]))


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, str],
             limit: Limit = None) -> DataFrame:
    """Add, per entry ``new: column``, the value of the row just before."""
    s = spread(df, keys, order, reach=1, limit=limit)
    w = s.window(order)
    return s.own(s.rows.select("*", *[F.lag(c).over(w).alias(n) for n, c in columns.items()]))


def _running(s: Spread, order, local: Column, end: Column, merge, complete, out: str) -> DataFrame:
    """A running value inside each chunk, completed by what earlier chunks hold.

    ``end`` sums up a chunk, ``merge`` folds the ends of all earlier chunks and
    ``complete(carry, local)`` joins the two.
    """
    so_far = s.window(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = s.rows.withColumn(out, local.over(so_far))
    if not s.cut:
        return s.own(rows)
    # one row per chunk of a cut key: no more than 2 * rows / limit in all
    ends = s.rows.where(F.col(CHUNK) != WHOLE).groupBy(*s.keys, CHUNK).agg(end.alias("__end"))
    earlier = (Window.partitionBy(*s.keys).orderBy(CHUNK)
               .rowsBetween(Window.unboundedPreceding, -1))
    carry = ends.select(*s.keys, CHUNK, merge("__end").over(earlier).alias("__carry"))
    joined = keyed_join(rows, carry, [*s.keys, CHUNK])
    return s.own(joined.withColumn(out, complete(F.col("__carry"), F.col(out)))).drop("__carry")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str,
                limit: Limit = None) -> DataFrame:
    """Cumulative sum of ``value`` per key."""
    s = spread(df, keys, order, limit=limit)
    return _running(s, order, F.sum(value), F.sum(value), F.sum,
                    lambda carry, local: F.coalesce(carry + local, local, carry), out)


def running_count(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str,
                  limit: Limit = None) -> DataFrame:
    """1-based position of each row within its key."""
    ones = df.withColumn("__one", F.lit(1).cast("long"))
    return running_sum(ones, keys, order, "__one", out, limit=limit).drop("__one")


def running_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str,
                 limit: Limit = None) -> DataFrame:
    """Latest non-NULL ``value`` at or before each row of its key."""
    s = spread(df, keys, order, limit=limit)
    newest = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(SEQ)))
    return _running(s, order, F.last(value, ignorenulls=True), newest,
                    lambda c: F.last(c, ignorenulls=True),
                    lambda carry, local: F.coalesce(local, carry), out)


def nth_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int,
            limit: Limit = None) -> DataFrame:
    """The n-th row of every key that has one (keys and order columns only).

    Up to a limit of its own, Spark keeps the first n rows per key in each map
    task before it shuffles, so a hot key costs no more than any other; beyond
    it the rows of a hot key are counted in chunks. Only keys and order come
    back, so both ways return the same row whatever ties there are.
    """
    narrow = df.select(*keys, *order)
    if n <= int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        w = Window.partitionBy(*keys).orderBy(*order)
        counted = narrow.withColumn("__rn", F.row_number().over(w))
    else:
        counted = running_count(narrow, keys, order, "__rn", limit=limit)
    return counted.where(F.col("__rn") == n).drop("__rn")


def from_nth_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int,
                 rows: DataFrame | None = None, limit: Limit = None) -> DataFrame:
    """Drop the first n-1 rows of every key.

    ``rows`` may be an already filtered ``df``; positions still count in ``df``.
    Only the n-th row is looked up. For that, each map task sorts the keys and
    order columns of its own rows; the table itself is not shuffled when there
    are few keys.
    """
    rows = df if rows is None else rows
    gate = nth_row(df, keys, order, n, limit=limit).select(
        *keys, F.struct(*order).alias("__gate"))
    passed = F.struct(*order) >= F.col("__gate")
    return keyed_join(rows, gate, keys, "inner", extra=passed).drop("__gate")


def balanced_shards(df: DataFrame, order: Sequence[str], shards: int, out: str = "shard",
                    position: str | None = None) -> DataFrame:
    """Contiguous shards along the order; the first ones take the remainder."""
    numbered = df if position else dense_order(df, order, "__pos")
    pos = F.col(position or "__pos")
    base, extra = divmod(numbered.count(), shards)
    bulky = extra * (base + 1)
    shard = (F.when(pos < bulky, F.floor(pos / (base + 1)))
             .otherwise(extra + F.floor((pos - bulky) / max(base, 1))))
    return numbered.withColumn(out, shard.cast("long")).drop("__pos")
