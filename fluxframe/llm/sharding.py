"""Hierarchical weighted hash tree: regions, racks and shards drawn level by level.

At every node each child draws an exponential variate from the hash of the row's
key and the child's name, divided by the child's weight; the smallest draw wins.
A child's draw does not depend on its siblings, so a changed weight moves rows
only between that child and the others below the same parent, and what lies in
untouched subtrees stays. A new shard that opens its own region takes rows only
into itself; one put into an existing rack raises the weights of its rack and
region and draws rows into these subtrees as well.

Everything is a column expression: three draws per row, no shuffle. Slots are
numbered with one shuffle of narrow rows, cut along a hash of the key so that no
shard, however large, is one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from fluxframe.llm.common import documents
from fluxframe.operators.numbering import number_rows

#: Rows per slice when slots are numbered; only the size of tasks depends on it.
SLICE_ROWS = 100_000


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def layout(shards: int, per_rack: int = 2, per_region: int = 4) -> list[Leaf]:
    """Equal shards in racks of ``per_rack`` and regions of ``per_region``."""
    return [Leaf(n // per_region, n // per_rack, n) for n in range(shards)]


def grown(tree: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a rack and region of its own."""
    new = max((leaf.shard for leaf in tree), default=-1) + 1
    return [*tree, Leaf(max((leaf.region for leaf in tree), default=-1) + 1,
                        max((leaf.rack for leaf in tree), default=-1) + 1, new, weight)]


def hash_unit(key: Column, salt: str) -> Column:
    """A number in (0, 1) from 52 bits of md5."""
    digits = F.substring(F.md5(F.concat(key, F.lit(salt))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def _drawn(key: Column, kind: str, weights: dict[int, float]) -> Column:
    """The child with the smallest draw; ties go to the smaller number."""
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    draws = [F.struct((-F.ln(hash_unit(key, f"/{kind}{n}")) / w).alias("draw"), F.lit(n).alias("n"))
             for n, w in sorted(weights.items())]
    return F.least(*draws)["n"]


def _totals(leaves: Sequence[Leaf], level: str) -> dict[int, float]:
    weights: dict[int, float] = {}
    for leaf in leaves:
        if leaf.weight > 0:
            number = getattr(leaf, level)
            weights[number] = weights.get(number, 0.0) + leaf.weight
    return weights


def _descend(key: Column, leaves: Sequence[Leaf], levels: Sequence[str]) -> list[Column]:
    """Columns of the child drawn at each level below ``leaves``."""
    level, *below = levels
    weights = _totals(leaves, level)
    here = _drawn(key, level, weights)
    if not below:
        return [here]
    paths = {n: _descend(key, [x for x in leaves if getattr(x, level) == n], below) for n in sorted(weights)}
    picked = []
    for depth in range(len(below)):
        choice = None
        for n, path in paths.items():
            choice = F.when(here == n, path[depth]) if choice is None else choice.when(here == n, path[depth])
        picked.append(choice)
    return [here, *picked]


def place(df: DataFrame, key: Column, tree: Sequence[Leaf], region: str = "region", rack: str = "rack",
          shard: str = "shard") -> DataFrame:
    """Add the region, rack and shard of each row. A NULL key is drawn as the text ``null``.

    Of equal keys all copies meet in one shard. Shards of weight 0 get nothing;
    a tree without weight is refused.
    """
    if not any(leaf.weight > 0 for leaf in tree) or any(leaf.weight < 0 for leaf in tree):
        raise ValueError("a tree needs weights, none of them negative")
    text = F.coalesce(key.cast("string"), F.lit("null"))
    chosen = _descend(text, tree, ("region", "rack", "shard"))
    return df.withColumns(dict(zip((region, rack, shard), chosen, strict=True)))


def number_slots(df: DataFrame, shard: str, key: Column, ties: Sequence[str], slot: str = "slot",
                 slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Number the rows of every shard 0, 1, ... along a hash of the key, a second hash of ``ties``, then ``ties``.

    Slices of about ``slice_rows`` rows are cut along that order by exact counts,
    each is numbered in one task. A flood of one key is cut by the second hash,
    as far as ``ties`` differ; rows that agree in them are interchangeable and
    share a slice.
    """
    key_hash = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("long")
    ordered = df.withColumns({"__h": key_hash, "__h2": F.xxhash64(*ties)})
    numbered = number_rows(ordered, [shard, "__h", "__h2", *ties], "__at", most=slice_rows)
    # one row per shard
    sizes = ordered.groupBy(shard).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(shard).alias("__shard"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    joined = numbered.join(starts, F.col(shard) == F.col("__shard"))
    return joined.withColumn(slot, (F.col("__at") - F.col("__start")).cast("long")).drop("__h", "__h2", "__at", "__shard", "__start")


def shard_documents(docs: DataFrame, tree: Sequence[Leaf], wider: Sequence[Leaf]) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document.

    ``size`` is the text's UTF-8 bytes and one (NULL: none). Texts are read once
    and never shuffled: only these numbers are. Repeated rows count again and get
    slots of their own; an empty table gives no rows; further columns are
    ignored, whatever their names.
    """
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    narrow = documents(docs).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = place(narrow, F.col("doc_id"), tree)
    placed = place(placed, F.col("doc_id"), wider, "__region", "__rack", "grown_shard").drop("__region", "__rack")
    slots = number_slots(placed, "shard", F.col("doc_id"), ["doc_id", "size", "text_crc32"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "region", "rack", "shard", "slot",
                        "grown_shard")
