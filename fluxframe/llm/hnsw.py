"""Nearest neighbours by one navigable small-world graph per shard.

Distinct vectors are dealt to shards of about ``SHARD_ROWS`` by hash. A task
builds the hierarchical graph of a shard and stores it as one row of flat arrays:
vectors, and per layer its nodes and their neighbours in rows of fixed width.
For a search every block of queries meets every shard; a task walks the graph
from the top layer down and the shards' results are merged, nearest first.

Equal vectors are one node with the smallest ids that have it, so a vector that
a third of all rows share neither fills a shard nor its neighbour lists.
Distances are recomputed in double precision before results leave a shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fluxframe.session import settle

SHARD_ROWS = 4096
QUERY_BLOCK = 256
#: Neighbours per node: twice as many on the bottom layer.
DEGREE = 12
#: Nodes kept in view while building and while searching.
BUILD_WIDTH = 64
SEARCH_WIDTH = 128
NEAREST = 10


@dataclass
class Graph:
    """``nodes[l]`` are the vectors on layer l, ``links[l]`` their neighbours, filled up with -1."""

    vectors: np.ndarray
    nodes: list[np.ndarray]
    links: list[np.ndarray]
    entry: int

    def walk(self, query: np.ndarray, width: int) -> list[tuple[float, int]]:
        """About the ``width`` nearest vectors, nearest first, with squared distances in single precision."""
        start = [(float(((self.vectors[self.entry] - query) ** 2).sum()), self.entry)]
        for layer in range(len(self.nodes) - 1, 0, -1):
            place = self._place(layer)
            start = _search(self.vectors, lambda n, p=place, k=self.links[layer]: k[p[n]], query, start, 1)
        return _search(self.vectors, lambda n: self.links[0][n], query, start, width)

    def _place(self, layer: int) -> dict[int, int]:
        if not hasattr(self, "_places"):
            self._places: dict[int, dict[int, int]] = {}
        if layer not in self._places:
            self._places[layer] = {n: i for i, n in enumerate(self.nodes[layer].tolist())}
        return self._places[layer]


def _search(vectors, neighbours, query, start, width: int) -> list[tuple[float, int]]:
    """Best first from ``start``, keeping the ``width`` nearest seen."""
    seen = {n for _, n in start}
    ahead = list(start)
    heapq.heapify(ahead)
    best = [(-d, -n) for d, n in start]
    heapq.heapify(best)
    while ahead:
        distance, node = heapq.heappop(ahead)
        if len(best) >= width and distance > -best[0][0]:
            break
        new = [n for n in neighbours(node).tolist() if n >= 0 and n not in seen]
        if not new:
            continue
        seen.update(new)
        away = vectors[new] - query
        for d, n in zip(np.einsum("ij,ij->i", away, away).tolist(), new, strict=True):
            if len(best) < width or d < -best[0][0]:
                heapq.heappush(ahead, (d, n))
                heapq.heappush(best, (-d, -n))
                if len(best) > width:
                    heapq.heappop(best)
    return sorted((-d, -n) for d, n in best)


def _spread(vectors: np.ndarray, near: list[tuple[float, int]], degree: int) -> list[int]:
    """Up to ``degree`` of the sorted candidates, first those nearer to the new node than to one taken before."""
    names = [n for _, n in near]
    own = vectors[names]
    squares = np.einsum("ij,ij->i", own, own)
    between = squares[:, None] + squares[None, :] - 2 * own @ own.T
    taken: list[int] = []
    left: list[int] = []
    for i, (d, _) in enumerate(near):
        if len(taken) == degree:
            break
        if taken and between[i, taken].min() < d:
            left.append(i)
        else:
            taken.append(i)
    return [names[i] for i in (taken + left)[:degree]]


def build(vectors: np.ndarray, degree: int = DEGREE, width: int = BUILD_WIDTH, seed: int = 1) -> Graph:
    """Insert the vectors one by one; a node's top layer is drawn with a fixed seed."""
    count = len(vectors)
    rng = np.random.default_rng(seed)
    tops = np.minimum((-np.log(1 - rng.random(count)) / np.log(degree)).astype(int), 8)
    depth = int(tops.max()) + 1
    nodes = [np.flatnonzero(tops >= layer) for layer in range(depth)]
    places = [np.full(count, -1, np.int64) for _ in range(depth)]
    for layer, own in enumerate(nodes):
        places[layer][own] = np.arange(len(own))
    links = [np.full((len(own), degree * (2 if layer == 0 else 1)), -1, np.int32) for layer, own in enumerate(nodes)]
    entry = 0
    for node in range(1, count):
        query = vectors[node]
        near = [(float(((vectors[entry] - query) ** 2).sum()), entry)]
        for layer in range(int(tops[entry]), -1, -1):
            place, table = places[layer], links[layer]
            if layer > tops[node]:
                near = _search(vectors, lambda n, p=place, k=table: k[p[n]], query, near, 1)
                continue
            near = _search(vectors, lambda n, p=place, k=table: k[p[n]], query, near, width)
            chosen = _spread(vectors, near, degree)
            table[place[node], :len(chosen)] = chosen
            for other in chosen:
                row = table[place[other]]
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = node
                    continue
                around = np.append(row, node)
                away = vectors[around] - vectors[other]
                order = np.einsum("ij,ij->i", away, away)
                rank = np.argsort(order, kind="stable")
                kept = _spread(vectors, list(zip(order[rank].tolist(), around[rank].tolist(), strict=True)), len(row))
                row[:] = -1
                row[:len(kept)] = kept
        if tops[node] > tops[entry]:
            entry = node
    return Graph(vectors, nodes, links, entry)


def usable(column: str) -> Column:
    """A vector without NULL, NaN or infinite components that is not all zeros."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col(column).isNotNull() & finite & F.exists(column, lambda x: x != 0)


def distinct_vectors(rows: DataFrame, ids_kept: int) -> DataFrame:
    """vector, ids: every distinct vector with the ``ids_kept`` smallest ids that have it.

    Ids beyond these can never be among a query's nearest. They are dropped in
    the map tasks already, so that a very common vector moves few rows.
    """
    first = Window.partitionBy("vector").orderBy("id")
    ranked = rows.select("id", "vector").distinct().withColumn("__rank", F.row_number().over(first))
    return (ranked.where(F.col("__rank") <= ids_kept).groupBy("vector")
            .agg(F.sort_array(F.collect_list("id")).alias("ids")))


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row of flat arrays per shard, written: dim, shard, vectors, ids, ends of ids, layer sizes, nodes, links, entry."""
    def built(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("h").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        lists = table.column("ids").to_pylist()
        dim = key[0].as_py()
        own = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        own = own.astype(np.float64).reshape(-1, dim)
        graph = build(own.astype(np.float32))
        values = {
            "dim": dim, "shard": key[1].as_py(), "vectors": own.tobytes(),
            "ids": np.array([i for x in lists for i in x], np.int64).tobytes(),
            "id_ends": np.cumsum([len(x) for x in lists]).astype(np.int64).tobytes(),
            "layers": np.array([len(n) for n in graph.nodes], np.int64).tobytes(),
            "nodes": b"".join(n.astype(np.int32).tobytes() for n in graph.nodes),
            "links": b"".join(k.tobytes() for k in graph.links), "entry": graph.entry,
        }
        kinds = {"dim": pa.int32(), "shard": pa.int64(), "entry": pa.int32()}
        return pa.table({n: pa.array([v], kinds.get(n, pa.binary())) for n, v in values.items()})

    sizes = settle(vectors.groupBy(F.size("vector").alias("dim")).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(shard_rows)).cast("long").alias("shards")))
    hashed = vectors.withColumns({"dim": F.size("vector"), "h": F.xxhash64("vector")})
    dealt = hashed.join(sizes, "dim").withColumn("shard", F.pmod("h", "shards"))
    graphs = by_shard(dealt, _tasks(sizes.select("shards"))).groupBy("dim", "shard").applyInArrow(
        built, "dim int, shard long, vectors binary, ids binary, id_ends binary, layers binary, nodes binary, "
               "links binary, entry int")
    return settle(graphs)


def _tasks(shards: DataFrame) -> int:
    """A task for each shard as far as that is sensible; only the number of tasks depends on it."""
    return int(min(shards.agg(F.coalesce(F.sum("shards"), F.lit(1))).first()[0], 10_000))


def by_shard(rows: DataFrame, tasks: int) -> DataFrame:
    """Deal rows out by shard. The number is given, since shards are small in bytes but long to work on."""
    return rows.repartition(tasks, "dim", "shard")


def _graph(row: dict, degree: int = DEGREE) -> tuple[Graph, np.ndarray, list[np.ndarray]]:
    exact = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
    sizes = np.frombuffer(row["layers"], np.int64).tolist()
    nodes = np.split(np.frombuffer(row["nodes"], np.int32), np.cumsum(sizes)[:-1])
    flat, links, at = np.frombuffer(row["links"], np.int32), [], 0
    for layer, n in enumerate(sizes):
        wide = degree * (2 if layer == 0 else 1)
        links.append(flat[at:at + n * wide].reshape(n, wide))
        at += n * wide
    ids = np.split(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["id_ends"], np.int64)[:-1])
    return Graph(exact.astype(np.float32), nodes, links, row["entry"]), exact, ids


def search(index: DataFrame, queries: DataFrame, k: int = NEAREST, width: int = SEARCH_WIDTH,
           block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every query row (id, vector).

    Queries meet only shards of their own dimension. A row's own id is no result
    of it, nor are other rows with that id.
    """
    parts = max(1, -(-queries.count() // block))
    blocks = (queries.groupBy(F.size("vector").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(parts)).alias("__block"))
              .agg(F.collect_list(F.struct("id", "vector")).alias("queries")).select("dim", "queries"))
    # every block of the stated queries goes to every shard of its dimension, by equal keys
    shards = index.select("dim", "shard")
    tasks = _tasks(shards.groupBy("dim").agg(F.count(F.lit(1)).alias("shards")))
    met = by_shard(index, tasks).join(by_shard(blocks.join(shards, "dim"), tasks), ["dim", "shard"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, None
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                if (row["dim"], row["shard"]) != at:
                    at, last = (row["dim"], row["shard"]), _graph(row)
                graph, exact, ids = last
                out: list[tuple] = []
                for q in row["queries"]:
                    out += _nearest(graph, exact, ids, q["id"], np.array(q["vector"], np.float64), k, width)
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out, strict=True),
                                                        (pa.int64(), pa.int64(), pa.float64()), strict=True)],
                        ["query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    rows = met.mapInArrow(found, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(
        F.min("score").alias("score"))
    return (rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _nearest(graph: Graph, exact: np.ndarray, ids, own: int, query: np.ndarray, k: int, width: int) -> list[tuple]:
    near = [n for _, n in graph.walk(query.astype(np.float32), max(width, k + 1))]
    distance = np.sqrt(((exact[near] - query) ** 2).sum(axis=1))
    out: list[tuple] = []
    for place in np.argsort(distance, kind="stable").tolist():
        if len(out) >= k and float(distance[place]) > out[k - 1][2]:
            break
        out += [(own, i, float(distance[place])) for i in ids[near[place]].tolist() if i != own]
    return sorted(out, key=lambda r: (r[2], r[1]))[:k]


def nearest(table: DataFrame, every: int = 100, k: int = NEAREST, vec_id: str = "vec_id",
            embedding: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows of each row whose id is divisible by ``every``.

    Rows with a NULL id or a vector that is NULL, zero, or holds NULL or
    non-finite components neither ask nor answer. Repeated rows count once; ties
    go to the smaller id. An empty table gives no rows.
    """
    rows = table.select(F.col(vec_id).cast("long").alias("id"),
                        F.col(embedding).cast("array<double>").alias("vector")).where(
        F.col("id").isNotNull() & usable("vector"))
    # a query's own id may be among those kept for its vector
    index = build_index(distinct_vectors(rows, k + 1))
    return search(index, rows.where(F.col("id") % every == 0).distinct(), k)
