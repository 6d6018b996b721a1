"""Hard negatives by STR-packed R-trees: inner products of anchors within windows of scores.

Rows are dealt to shards by hash, and each shard is packed into an R-tree by
sort-tile-recursive: sorted by label, cut into slabs, each slab sorted by the
widest coordinate, cut again, and so on. A node knows the least and greatest
value of every coordinate below it, which gives an interval for the inner
product with an anchor, and the range of labels.

A best-first queue takes the node with the highest possible score next. A node
is left out if its interval lies outside the window of scores, or strictly
below the k-th best score found so far. All windows of an anchor are answered by
one walk. First the anchor's best rows of its own label are found (no window),
then, for each of these, the best rows of other labels within its window.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fluxframe.session import settle

#: Anchors are rows whose id this divides.
EVERY = 100
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is at least and at most this percentage of the positive's.
LOW, HIGH = 30, 90
#: Rows of a shard, anchors that one task looks up in it, and rows of a leaf or children of a node.
SHARD_ROWS, BLOCK_ANCHORS, FANOUT = 8192, 20_000, 32
#: Coordinates by which a shard is tiled, besides the label.
TILED = 3
INFINITE = float("inf")


def usable(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label and v (whole numbers as doubles) of the rows that take part, one for each id."""
    parts = F.transform(F.col("v"), lambda x: F.floor(x.cast("double") * 256).cast("double"))
    rows = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
                             F.col(vector).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != INFINITE))
    moved = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    kept = rows.where("vec_id is not null and label is not null and v is not null").where(finite)
    one = kept.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row"))
    return one.select("vec_id", "row.*").select("vec_id", moved.alias("label"), parts.alias("v"))


def tiled(keys: np.ndarray, leaves: int, order: np.ndarray, fanout: int) -> np.ndarray:
    """``order`` so that every ``fanout`` rows lie close together: slabs by the first key, in these by the next, and so on."""
    order = order[np.argsort(keys[0][order], kind="stable")]
    if len(keys) == 1 or leaves <= 1:
        return order
    slabs = max(1, round(leaves ** (1 / len(keys))))
    rows = -(-leaves // slabs) * fanout
    return np.concatenate([tiled(keys[1:], -(-len(part) // fanout), part, fanout)
                           for part in (order[at:at + rows] for at in range(0, len(order), rows))])


class RTree:
    """Packed boxes over rows, level by level from the leaves up; node n of a level holds entries n * fanout on below it."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, fanout: int = FANOUT):
        wide = np.argsort(-vectors.var(axis=0), kind="stable")[:TILED]
        order = tiled([labels, *(vectors[:, c] for c in wide)], -(-len(ids) // fanout), np.arange(len(ids)), fanout)
        self.fanout, self.ids, self.labels, self.vectors = fanout, ids[order], labels[order], vectors[order]
        self.lows, self.highs, self.label_lows, self.label_highs = [], [], [], []
        self.opened = 0  # leaves whose rows were scored, by all walks
        low, high, first, last = self.vectors, self.vectors, self.labels, self.labels
        while not self.lows or len(low) > 1:
            at = np.arange(0, len(low), fanout)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            first, last = np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)
            self.lows.append(low)
            self.highs.append(high)
            self.label_lows.append(first)
            self.label_highs.append(last)

    def search(self, anchor: int, label: int, query: np.ndarray, same: bool, most: int,
               windows: list[tuple[float, float]]) -> list[list[tuple[int, int]]]:
        """For each window of scores the ``most`` best (score, id): highest first, then the smallest id.

        Rows of the anchor's label, or of all others; never the anchor itself.
        """
        up, down = np.maximum(query, 0), np.minimum(query, 0)
        best: list[list[tuple[float, int]]] = [[] for _ in windows]  # heaps of (score, -id), the worst first
        kth = [-INFINITE] * len(windows)
        floor, ceiling = min(w[0] for w in windows), max(w[1] for w in windows)

        def promise(least: float, greatest: float) -> float:
            """The best score that a box may still add to some window."""
            return max((min(greatest, high) for (low, high), worst in zip(windows, kth, strict=True)
                        if greatest >= low and least <= high and min(greatest, high) >= worst), default=-INFINITE)

        queue = [(-INFINITE, len(self.lows) - 1, 0, -INFINITE, INFINITE)]  # the root is always opened
        while queue:
            hope, level, node, *interval = heapq.heappop(queue)
            if -hope < min(kth):
                break
            if promise(*interval) == -INFINITE:  # better rows have been found meanwhile
                continue
            start = node * self.fanout
            part = slice(start, start + self.fanout)
            if level:
                below = level - 1
                greatest = self.highs[below][part] @ up + self.lows[below][part] @ down
                least = self.lows[below][part] @ up + self.highs[below][part] @ down
                first, last = self.label_lows[below][part], self.label_highs[below][part]
                fits = (first <= label) & (label <= last) if same else (first != label) | (last != label)
                fits &= (greatest >= floor) & (least <= ceiling)
                for child in np.flatnonzero(fits).tolist():
                    interval = float(least[child]), float(greatest[child])
                    hope = promise(*interval)
                    if hope > -INFINITE:
                        heapq.heappush(queue, (-hope, below, start + child, *interval))
                continue
            self.opened += 1
            scores = self.vectors[part] @ query
            fits = (self.labels[part] == label) == same
            fits &= (scores >= floor) & (scores <= ceiling) & (scores >= min(kth))
            fits &= self.ids[part] != anchor
            for row in np.flatnonzero(fits).tolist():
                entry = (float(scores[row]), -int(self.ids[start + row]))
                for w, (low, high) in enumerate(windows):
                    if low <= entry[0] <= high:
                        if len(best[w]) < most:
                            heapq.heappush(best[w], entry)
                        elif entry > best[w][0]:
                            heapq.heapreplace(best[w], entry)
                        if len(best[w]) == most:
                            kth[w] = best[w][0][0]
        return [[(int(s), -i) for s, i in sorted(found, reverse=True)] for found in best]


@dataclass(frozen=True)
class Layout:
    """How rows and anchors are dealt out."""

    shards: int
    blocks: int

    @property
    def parts(self) -> int:
        return self.shards * self.blocks


def searched(rows: DataFrame, asked: DataFrame, layout: Layout, same: bool, most: int, fanout: int = FANOUT,
             windows: Callable[[list[int]], list[tuple[float, float]]] = lambda _: [(-INFINITE, INFINITE)]) -> DataFrame:
    """anchor_id, window, score and vec_id: the best of every shard for every window of every anchor in ``asked``.

    ``asked`` has vec_id, label, v and bounds (a list of longs that ``windows``
    turns into windows). A task holds one shard's tree, built once, while its
    block of anchors streams by.
    """
    shards, blocks = layout.shards, layout.blocks
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select(shard.alias("shard"), every(blocks).alias("block"), F.lit(0).alias("kind"), "vec_id", "label", "v",
                       F.array().cast("array<long>").alias("bounds"))
    right = asked.select(every(shards).alias("shard"), block.alias("block"), F.lit(1).alias("kind"), "vec_id", "label", "v", "bounds")

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, own, at = None, [], None
        for batch in batches:
            places = list(zip(batch.column("shard").to_pylist(), batch.column("block").to_pylist(),
                              batch.column("kind").to_pylist(), strict=True))
            out: list[tuple[int, int, int, int]] = []
            start = 0
            while start < len(places):
                stop = next((k for k in range(start + 1, len(places)) if places[k] != places[start]), len(places))
                part, (here, kind) = batch.slice(start, stop - start), (places[start][:2], places[start][2])
                if here != at:
                    tree, own, at = None, [], here
                if kind == 0:
                    own.append(part)
                else:
                    if tree is None and own:
                        tree, own = planted(own), []
                    if tree is not None:
                        out += answers(tree, part)
                start = stop
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
                ["anchor_id", "window", "score", "vec_id"])

    def planted(parts: list[pa.RecordBatch]) -> RTree:
        table = pa.Table.from_batches(parts)
        lists = table.column("v").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        vectors = np.zeros((len(sizes), max(1, int(sizes.max()))))
        vectors[np.arange(vectors.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
        return RTree(table.column("vec_id").to_numpy(), table.column("label").to_numpy(), vectors, fanout)

    def answers(tree: RTree, part: pa.RecordBatch):
        width = tree.vectors.shape[1]
        for anchor, label, v, bounds in zip(*(part.column(c).to_pylist() for c in ("vec_id", "label", "v", "bounds")), strict=True):
            query = np.zeros(width)
            query[:min(width, len(v))] = v[:width]
            for w, found in enumerate(tree.search(anchor, label, query, same, most, windows(bounds))):
                yield from ((anchor, w, s, i) for s, i in found)

    return (left.unionByName(right).repartition(layout.parts, "shard", "block")
            .sortWithinPartitions("shard", "block", "kind")
            .mapInArrow(answered, "anchor_id long, window int, score long, vec_id long"))


def firsts(found: DataFrame, most: int) -> DataFrame:
    """The best of all shards, with rank from 1."""
    order = Window.partitionBy("anchor_id", "window").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(embeddings: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH, shard_rows: int = SHARD_ROWS, block_anchors: int = BLOCK_ANCHORS,
         fanout: int = FANOUT) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Every row is indexed and every anchor asked. Rows with a NULL id, label or
    vector, or with a NULL or non-finite component, take no part. Repeated rows
    count once; of several rows with one id the one of the smallest label, then
    vector, counts. Shorter vectors are continued by zeros, the empty one
    scores 0. Ties go to the smaller id. Scores are exact as long as all
    sums stay below 2**53. A positive below zero has an empty window. An empty
    table gives no rows; further columns are ignored, whatever their names.
    """
    rows = settle(usable(embeddings))
    anchors = rows.where(F.col("vec_id") % every == 0)
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("a")).first()
    layout = Layout(max(1, -(-counts["n"] // shard_rows)), max(1, -(-counts["a"] // block_anchors)))
    asked = anchors.withColumn("bounds", F.array().cast("array<long>"))
    best = settle(firsts(searched(rows, asked, layout, True, positives, fanout), positives).select(
        "anchor_id", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score")))
    # an anchor has at most ``positives`` rows here, in order of their rank
    bounds = best.groupBy("anchor_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("window", "positive_score"))), lambda p: p["positive_score"]).alias("bounds"))
    asked = anchors.join(bounds.withColumnRenamed("anchor_id", "vec_id"), "vec_id")

    def windows(scores: list[int]) -> list[tuple[float, float]]:
        # whole scores s with low * p <= 100 * s <= high * p
        return [(-(-low * p // 100), high * p // 100) for p in scores]

    found = firsts(searched(rows, asked, layout, False, negatives, fanout, windows), negatives)
    return found.join(best, ["anchor_id", "window"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


#: The same for the table ``embeddings``; its rows have one id each and vectors of one length.
SQL = f"""
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    [floor(256 * x::double) for x in embedding] as v
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0),
pairs as (
  select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same, list_dot_product(a.v, r.v)::bigint as score
  from rows a join rows r on a.vec_id % {EVERY} = 0 and a.vec_id <> r.vec_id),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from pairs where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= {POSITIVES})
select anchor_id, positive_id,
  row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank,
  vec_id as negative_id, positive_score, score as negative_score
from positives join pairs using (anchor_id)
where not same and {LOW} * positive_score <= 100 * score and 100 * score <= {HIGH} * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= {NEGATIVES}"""
