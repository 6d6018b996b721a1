"""Numbers along a total order, by slices with exact counts.

Slices are found by counting, from the order's columns alone: a slice is split
evenly between the least and the greatest value it holds of the first column
that still differs in it, and the parts that hold too many rows are split again.
So slices follow from the data; nothing is sampled, and a task that is repeated
cuts alike. Therefore no row has to be written: rows go to their slices in one
shuffle, are sorted there, and get the count of all slices before theirs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F, types as T

from fluxframe.operators.ordering import row_hash
from fluxframe.session import counted, hot_key_rows, settle

PATH = "__path"
#: Parts that a slice is cut into at once, at most.
PARTS = 4096
#: Bytes of a text that are looked at together, and how many times.
CHUNK, CHUNKS = 6, 4
HUGE = 1e300
#: Rows that are not worth a slice of their own.
LEAST_ROWS = 100_000


def digits(field: T.StructField, descending: bool = False) -> list[Column]:
    """Doubles whose order, one after the other, never contradicts that of the column; NULL comes first.

    They need not tell all values apart: what they leave together is sorted together.
    """
    column, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        values = [F.isnan(column).cast("double"), F.least(F.greatest(F.nanvl(column, F.lit(0.0)).cast("double"), F.lit(-HUGE)), F.lit(HUGE))]
    elif isinstance(kind, (T.NumericType, T.BooleanType)):
        values = [column.cast("double")]
    elif isinstance(kind, T.DateType):
        values = [F.unix_date(column).cast("double")]
    elif isinstance(kind, T.TimestampType):
        values = [F.unix_micros(column).cast("double")]
    elif isinstance(kind, T.TimestampNTZType):
        values = [F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), column).cast("double")]
    elif isinstance(kind, (T.StringType, T.BinaryType)):
        whole = F.hex(column if isinstance(kind, T.BinaryType) else F.encode(column, "UTF-8"))
        values = [F.conv(F.rpad(F.substring(whole, 2 * CHUNK * n + 1, 2 * CHUNK), 2 * CHUNK, "0"), 16, 10).cast("double")
                  for n in range(CHUNKS)]
    else:
        values = []
    there = ([column.isNotNull().cast("double")] if field.nullable else []) + [F.coalesce(v, F.lit(0.0)) for v in values]
    return [-v if descending else v for v in there]


def _ends(columns: dict[str, list[str]]) -> list[Column]:
    """How many rows there are, whether each column has one value, and what its digits lie between."""
    single = [(F.min(c).eqNullSafe(F.max(c)) & F.count(c).isin(0, F.count(F.lit(1)))).alias(f"same_{k}")
              for k, c in enumerate(columns)]
    names = [n for own in columns.values() for n in own]
    return [F.count(F.lit(1)).alias("rows"), *single, *[F.min(n).alias(f"low_{n}") for n in names],
            *[F.max(n).alias(f"high_{n}") for n in names]]


def _part(value: Column, low, width, parts) -> Column:
    # halves, so that the width of the widest range is still a number
    return F.least(F.floor((value / 2 - low) / width * parts), parts - 1).cast("int")


def slices(keys: DataFrame, columns: dict[str, list[str]],
           most: int | None = None) -> tuple[Callable[[DataFrame], DataFrame], DataFrame]:
    """What adds the path of its slice to each row, and the slices with their rows.

    ``columns`` has the columns of the order, each with its digit columns. Paths
    are in the order of the rows. A slice has ``most`` rows at most unless it
    has but one value for the digits of the first column that differs in it.
    Without ``most`` there is about a slice for each task.
    """
    spark = keys.sparkSession
    names = [n for own in columns.values() for n in own]
    # one row: nothing is cut yet
    whole = keys.agg(*_ends(columns)).first()
    if most is None:
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        most = min(hot_key_rows(spark), max(LEAST_ROWS, -(-whole["rows"] // tasks)))
    path = F.array().cast("array<int>")
    for k, own in enumerate(columns.values()):
        name = next((n for n in own if whole["rows"] > most and whole[f"low_{n}"] / 2 < whole[f"high_{n}"] / 2), None)
        if name:
            low = whole[f"low_{name}"] / 2
            parts = min(-(-whole["rows"] // most) * 8, PARTS)
            path = F.array(_part(F.col(name), F.lit(low), F.lit(whole[f"high_{name}"] / 2 - low), F.lit(parts)))
        if name or not whole[f"same_{k}"]:
            break
    rounds: list[DataFrame] = []

    def placed(df: DataFrame) -> DataFrame:
        df = df.withColumn(PATH, path)
        for rules in rounds:
            value = F.coalesce(*[F.when(F.col("__which") == n, F.col(n)) for n in names])
            part = _part(value, F.col("__low"), F.col("__width"), F.col("__parts"))
            deeper = F.when(F.col("__which").isNotNull(), F.concat(PATH, F.array(part))).otherwise(F.col(PATH))
            df = df.join(rules, PATH, "left").withColumn("__deeper", deeper).drop(PATH, "__which", "__low", "__width", "__parts")
            df = df.withColumnRenamed("__deeper", PATH)
        return df

    if whole["rows"] <= most:
        return placed, spark.range(1).select(F.array().cast("array<int>").alias(PATH), F.lit(whole["rows"]).alias("rows"))
    # the next column may only be looked at where all before it are the same
    which = F.lit(None).cast("string")
    for k, own in reversed(list(enumerate(columns.values()))):
        differs = [F.when(F.col(f"low_{n}") / 2 < F.col(f"high_{n}") / 2, F.lit(n)) for n in own]
        which = F.coalesce(*differs, F.when(F.col(f"same_{k}"), which))
    while True:
        seen = Observation()
        held = placed(keys).groupBy(PATH).agg(*_ends(columns)).withColumn("__which", F.when(F.col("rows") > most, which))
        held = settle(held.observe(seen, F.count("__which").alias("crowded")))
        if not counted(seen, "crowded"):
            return placed, held.select(PATH, "rows")
        low, high = (F.coalesce(*[F.when(F.col("__which") == n, F.col(f"{end}_{n}")) for n in names]) for end in ("low", "high"))
        rounds.append(settle(held.where("__which is not null").select(
            PATH, "__which", (low / 2).alias("__low"), (high / 2 - low / 2).alias("__width"),
            F.least(F.ceil(F.col("rows") / most) * 8, F.lit(PARTS)).alias("__parts"))))


def number_rows(df: DataFrame, order: Sequence[str], name: str, start: int = 0, descending: Sequence[str] = (),
                most: int | None = None) -> DataFrame:
    """Number all rows ``start, start+1, ...`` along the ``order`` columns; no row is written.

    NULL comes first, or last in a descending column; -0.0 equals 0.0. Rows that
    tie are numbered by a hash of the row; equal rows are interchangeable.
    ``most`` bounds the rows of a slice.
    """
    listed = {c: digits(df.schema[c], c in descending) for c in order}
    columns = {c: [f"__digit{k}_{n}" for n in range(len(own))] for k, (c, own) in enumerate(listed.items())}
    looked = {n: d for c in order for n, d in zip(columns[c], listed[c], strict=True)}
    placed, held = slices(df.select(*order).withColumns(looked), columns, most)
    # one row per slice: some eight times as many as there are tasks, or rows / most
    before = Window.orderBy(PATH).rowsBetween(Window.unboundedPreceding, -1)
    begins = held.select(PATH, (F.coalesce(F.sum("rows").over(before), F.lit(0)) + start).alias("__begin"))
    along = Window.partitionBy(PATH).orderBy(*[F.desc(c) if c in descending else F.asc(c) for c in order], "__tie")
    tie = F.lit(0) if set(df.columns) == set(order) else row_hash(df)
    numbered = placed(df.withColumn("__tie", tie).withColumns(looked)).join(begins, PATH)
    return numbered.withColumn(name, F.col("__begin") + F.row_number().over(along) - 1).select(*df.columns, name)
