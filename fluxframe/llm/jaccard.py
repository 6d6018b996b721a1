"""Exact Jaccard join of shingle sets by set relations.

Sets that are equal are one class. Each class is indexed under the shingles of
its prefix, rarest first by a fixed-size count of all shingles, then longest:
two sets that link share one of them. The classes under one shingle form a
family, named after one of its members, and meet in a task in which

* lists of the index are cut into blocks by position, and a block is skipped
  when no set in it can still share enough with the set at hand;
* a set that proves similar to the first set of a component takes over its
  answers: members of that component need no check, and the overlaps computed
  for that set bound those of all others.

Only one link per set and component leaves a task, never all pairs. Families of
many shingles are cut into blocks, every two of which meet in some task.

Before texts are moved, members of a family are compared by size and by a
histogram of their shingles, which bounds from above what two sets can share;
whoever has no possible partner left leaves the family.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from fluxframe.llm.common import by_bytes, documents, tasks
from fluxframe.llm.components import connected
from fluxframe.llm.shingles import Shingler
from fluxframe.operators.numbering import number_rows
from fluxframe.session import settle

PERCENT = 90
#: Words of a shingle.
WORDS = 3
#: Counters of shingles, a power of two: the table that goes to every task has one byte for each.
COUNTER_BITS = 20
#: Slices in which counters of all tasks are added.
SLICES = 32
#: Shingles that one task holds of a family, apart from a single larger set.
BLOCK_SHINGLES = 1 << 21
#: Positions in a block of an index list.
POSITIONS = 8
#: Bins of the histogram of a set.
BINS = 256
#: Counters from this level on, four times the usual count or more, are taken for long lists.
LONG_LIST = 4


def needed(n: int, m: int | np.ndarray, percent: int = PERCENT):
    """Least overlap of sets of n and m shingles that links them."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


class _Counters:
    """A task's counts of shingles by the first bits of their hash."""

    def __init__(self, bits: int):
        self.shift, self.counts = np.uint64(64 - bits), np.zeros(1 << bits, np.uint32)

    def add(self, shingles: np.ndarray):
        slots = (shingles >> self.shift).astype(np.int64)
        self.counts += np.bincount(slots, minlength=len(self.counts)).astype(np.uint32)


def histogram(shingles: np.ndarray) -> bytes:
    """How many shingles fall into each bin; bits of the hash that the counters don't use decide."""
    bins = np.bincount(((shingles >> np.uint64(8)) & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS)
    return zlib.compress(bins.astype(np.uint32).tobytes(), 1)


def describe(docs: DataFrame, bits: int = COUNTER_BITS, words: int = WORDS) -> DataFrame:
    """A row per document (size, digest and histogram of its set) and, with kind 1, one per task with its counters."""
    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counters = Shingler(words), _Counters(bits)
        for batch in by_bytes(batches, "text"):
            sets = [shingler(text)[0] for text in batch.column("text").to_pylist()]
            counters.add(np.concatenate(sets))
            halves = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * len(sets), pa.int32()), batch.column("doc_id"),
                 pa.array([len(s) for s in sets], pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]),
                 pa.array([histogram(s) for s in sets], pa.binary())], names)
        if counters.counts.any():
            packed = zlib.compress(counters.counts.tobytes(), 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([1], pa.int32()), *[pa.nulls(1, pa.int64())] * 4, pa.array([packed], pa.binary())], names)

    names = ["kind", "doc_id", "n", "a", "b", "counts"]
    return documents(docs).mapInArrow(described, "kind int, doc_id long, n long, a long, b long, counts binary")


def levels(described: DataFrame, bits: int = COUNTER_BITS) -> np.ndarray:
    """How far each counter stands out, in half powers of two; one byte per counter.

    A scan task cuts its sum into slices, and each slice is added in a task of
    its own, so what one task or the driver holds does not grow with the input.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                total += np.frombuffer(zlib.decompress(packed), np.uint32)
        parts = np.array_split(total, SLICES)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()),
                                          pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], ["slice", "counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for place, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = np.frombuffer(zlib.decompress(packed), np.int64)
                sums[place] = sums[place] + part if place in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in sums.values()], pa.binary())],
                ["slice", "counts"])

    schema = "slice int, counts binary"
    slices = described.where("kind = 1").select("counts").mapInArrow(cut, schema)
    sums = {r["slice"]: np.frombuffer(zlib.decompress(r["counts"]), np.int64)
            for r in slices.repartition(SLICES, "slice").mapInArrow(added, schema).collect()}
    total = np.concatenate([sums[n] for n in range(SLICES)]) if sums else np.zeros(1 << bits, np.int64)
    usual = total.mean()
    above = np.maximum(total - usual, 0) / (usual + 8)
    return np.minimum(np.round(2 * np.log2(above + 1)), 255).astype(np.uint8)


def ordered_prefix(shingles: np.ndarray, size: np.ndarray, level: np.ndarray,
                   percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles a set is indexed under and their levels: rare ones first, then long ones, then by hash."""
    bits = int(len(level)).bit_length() - 1
    how_common = level[(shingles >> np.uint64(64 - bits)).astype(np.int64)]
    # one number to order by: level, size and 48 bits of the hash
    short = np.uint64(255) - np.minimum(size, 255).astype(np.uint64)
    key = how_common.astype(np.uint64) << np.uint64(56) | short << np.uint64(48) | shingles >> np.uint64(16)
    length = prefix_length(len(shingles), percent)
    chosen = np.argpartition(key, length - 1)[:length]
    return shingles[chosen], how_common[chosen]


def prefixes(docs: DataFrame, level: np.ndarray, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """token, long_list, a, b: the index entries of every set, once per task that meets it."""
    shared = docs.sparkSession.sparkContext.broadcast(level)  # 2 ** COUNTER_BITS bytes, whatever the input

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(words), set()
        for batch in by_bytes(batches, "text"):
            tokens, long_list, digests, counts = [], [], [], []
            for text in batch.column("text").to_pylist():
                shingles, size = shingler(text)
                digest = xxhash.xxh3_128_digest(shingles.tobytes())
                if not len(shingles) or digest in seen:
                    continue
                seen.add(digest)
                own, common = ordered_prefix(shingles, size, shared.value, percent)
                tokens.append(own)
                long_list.append(common >= LONG_LIST)
                digests.append(digest)
                counts.append(len(own))
            if tokens:
                halves = np.repeat(np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2), counts, axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(long_list)),
                     pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["token", "long_list", "a", "b"])

    return docs.select("text").mapInArrow(indexed, "token long, long_list boolean, a long, b long")


def families(entries: DataFrame) -> DataFrame:
    """pa, pb, a, b: every set under the smallest set of each list it is in, itself included.

    Ordinary lists take one shuffle and a window. A list as long as the table
    would be one task there, so for shingles that stand out the smallest set is
    a minimum combined before the shuffle, and the join back splits the list.
    """
    own = F.struct("a", "b")
    lists = Window.partitionBy("token")
    short = (entries.where("not long_list").withColumns({"least": F.min(own).over(lists),
                                                         "most": F.max(own).over(lists)})
             .where("least != most").select(F.col("least.a").alias("pa"), F.col("least.b").alias("pb"), "a", "b"))
    standing_out = entries.where("long_list")
    ends = (standing_out.groupBy("token").agg(F.min(own).alias("least"), F.max(own).alias("most"))
            .where("least != most").select("token", F.col("least.a").alias("pa"), F.col("least.b").alias("pb")))
    long = standing_out.join(ends, "token").select("pa", "pb", "a", "b")
    return short.unionByName(long).distinct()


def comparable(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Members of families with another member of a size they could link with.

    Sizes fall into bands one of which is as wide as the threshold allows, so
    partners lie in the same or in neighbouring bands.
    """
    width = float(np.log(100 / percent))
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).cast("long")
    near = members.withColumn("__band", F.explode(F.array(band, band + 1)))
    # written, so that the join with it can split a family that holds most of the rows
    crowded = settle(near.groupBy("pa", "pb", "__band").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n"))
    stay = near.join(crowded, ["pa", "pb", "__band"], "left_semi").select("pa", "pb", "a", "b").distinct()
    return members.join(stay, ["pa", "pb", "a", "b"], "left_semi")


def possible(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Members that, by their histograms, may link with another one of their (pa, pb, block)."""
    def kept(table: pa.Table) -> pa.Table:
        bins = np.stack([np.frombuffer(zlib.decompress(h), np.uint32) for h in table.column("bins").to_pylist()])
        order = np.argsort(table.column("n").to_numpy(), kind="stable")
        bins, sizes = bins[order].astype(np.int32), table.column("n").to_numpy()[order]
        keep = np.zeros(len(order), bool)
        for r in range(1, len(order)):
            first = int(np.searchsorted(sizes[:r], -(-percent * int(sizes[r]) // 100)))
            for start in range(r, first, -512):  # nearest sizes first
                part = slice(max(first, start - 512), start)
                shared = np.minimum(bins[part], bins[r]).sum(axis=1)
                hit = shared >= needed(int(sizes[r]), sizes[part], percent)
                keep[part] |= hit
                keep[r] |= hit.any()
                if keep[first:r + 1].all():
                    break
        return table.take(pa.array(np.sort(order[keep]))).drop_columns(["n", "bins"])

    # dealt by block: rows that a join left dealt by family would keep a large family in one task
    dealt = rows.repartition(tasks(rows), "pa", "pb", "block")
    return dealt.groupBy("pa", "pb", "block").applyInArrow(kept, "pa long, pb long, block int, first long")


def link_sets(sets: list[np.ndarray], percent: int = PERCENT) -> list[int]:
    """For each set the first set of its component; sets come in rising size."""
    count = len(sets)
    parent = list(range(count))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    # local names of shingles, rarest first
    flat = np.concatenate(sets)
    _, inverse, often = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    flat = rank[inverse]
    sizes = np.array([len(s) for s in sets])
    edges = np.concatenate([[0], np.cumsum(sizes)])
    shared = often[np.argsort(often, kind="stable")] > 1
    index: dict[int, dict[int, list]] = {}  # shingle -> block of positions -> [greatest size, sets]
    overlaps: dict[int, np.ndarray] = {}  # upper bounds, of the first set of a component with all sets before it
    mark = np.zeros(len(often), bool)

    for r in range(count):
        n = int(sizes[r])
        own = np.sort(flat[edges[r]:edges[r + 1]])
        least = -(-percent * n // 100)
        found: set[int] = set()
        prefix = own[:prefix_length(n, percent)].tolist()
        for place, token in enumerate(prefix):
            for block, (largest, members) in index.get(token, {}).items():
                if largest - (block * POSITIONS - place) >= least:
                    found.update(members)
        if found:
            mark[own] = True
            _answers(r, n, least, found, sizes, edges, flat, mark, root, parent, overlaps, percent)
            mark[own] = False
        if root(r) == r:
            # it links with none before it, which is all that is known
            overlaps.setdefault(r, np.minimum(sizes[:r], needed(n, sizes[:r], percent) - 1).astype(np.int32))
        for place, token in enumerate(prefix):
            if shared[token]:
                block = index.setdefault(token, {}).setdefault(place // POSITIONS, [0, []])
                block[0] = n
                block[1].append(r)
    return [root(x) for x in range(count)]


def _answers(r, n, least, found, sizes, edges, flat, mark, root, parent, overlaps, percent):
    """Join r with the components it links to; keep its overlaps if it begins a component."""
    candidates = np.array(sorted(found))
    candidates = candidates[sizes[candidates] >= least]
    if not len(candidates):
        return
    known = np.full(r, n, np.int32)  # upper bounds of the overlap with r

    def count(which: np.ndarray) -> np.ndarray:
        """Exact overlaps of r with ``which``."""
        lengths = sizes[which]
        at = np.repeat(edges[which] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        return np.add.reduceat(mark[flat[at + np.arange(len(at))]].astype(np.int32),
                               np.concatenate([[0], np.cumsum(lengths)[:-1]]))

    # first sets of components stand for their answers
    firsts = np.unique([root(int(c)) for c in candidates])
    got = count(firsts)
    known[firsts] = got
    for first, overlap in zip(firsts.tolist(), got.tolist(), strict=True):
        if overlap >= needed(n, int(sizes[first]), percent):
            if first in overlaps and first:
                # what r shares with x: at most what its like shares with x, and what r has besides
                bound = overlaps[first] + (n - overlap)
                known[:first] = np.minimum(known[:first], bound)
            _union(first, r, root, parent)
    open_ = candidates[known[candidates] >= needed(n, sizes[candidates], percent)]
    mine = root(r)
    open_ = np.array([c for c in open_.tolist() if root(c) != mine], dtype=np.int64)
    for start in range(0, len(open_), 256):
        part = open_[start:start + 256]
        got = count(part)
        known[part] = got
        for c in part[got >= needed(n, sizes[part], percent)].tolist():
            _union(c, r, root, parent)
    if root(r) == r:
        overlaps[r] = known


def _union(x: int, y: int, root, parent):
    a, b = root(x), root(y)
    parent[max(a, b)] = min(a, b)


def family_links(rows: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """u, v: links that connect what is connected among the texts under one (pa, pb, block)."""
    def linked(table: pa.Table) -> pa.Table:
        shingler = Shingler(words)
        ids = table.column("doc_id").to_pylist()
        sets = [shingler(t)[0] for t in table.column("text").to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
        roots = link_sets([sets[i] for i in order], percent)
        pairs = [(ids[order[x]], ids[order[y]]) for x, y in enumerate(roots) if x != y]
        return pa.table({"u": pa.array([p[0] for p in pairs], pa.int64()),
                         "v": pa.array([p[1] for p in pairs], pa.int64())})

    return rows.groupBy("pa", "pb", "block").applyInArrow(linked, "u long, v long")


def blocks(members: DataFrame, limit: int = BLOCK_SHINGLES) -> DataFrame:
    """Add ``block``: families of more than ``limit`` shingles are cut, and every two parts meet in a block.

    A set counts for its shingles and 512 more, so that small sets are not too many for a task either.
    """
    weight = F.sum(F.col("n") + 512)
    sizes = settle(members.groupBy("pa", "pb").agg(
        F.when(weight <= limit, 1).otherwise(F.ceil(weight * 2 / F.lit(limit))).alias("__k")))
    k = F.col("__k").cast("int")
    part = F.pmod(F.xxhash64("a", "b"), F.col("__k")).cast("int")
    # of the parts i <= j, block i * k + j holds both
    meets = F.when(k == 1, F.array(F.lit(0))).otherwise(F.transform(
        F.sequence(F.lit(0), k - 1), lambda other: F.least(part, other) * k + F.greatest(part, other)))
    return members.join(sizes, ["pa", "pb"]).withColumn("block", F.explode(meets)).drop("__k")


def components(docs: DataFrame, percent: int = PERCENT, limit: int = BLOCK_SHINGLES,
               bits: int = COUNTER_BITS, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every document.

    Texts without a word have no shingles and link with nothing. A row without a
    doc_id joins nothing and has a NULL component. Repeated rows are equal sets
    and share a component; rows with one doc_id and several texts count as one
    document that has the links of all. An empty table gives no rows.
    """
    docs = documents(docs)
    described = settle(describe(docs, bits, words))
    level = levels(described, bits)
    sets = described.where("kind = 0").select("doc_id", "n", "a", "b", F.col("counts").alias("bins"))
    # written, so that joins with it can split a class that a third of all rows share
    classes = settle(sets.where("n > 0 and doc_id is not null").groupBy("a", "b")
                     .agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("bins").alias("bins")))
    entries = settle(prefixes(docs.where("doc_id is not null"), level, percent, words))
    members = settle(families(entries).join(classes, ["a", "b"]))
    near = blocks(settle(comparable(members, percent)), limit)
    wanted = settle(possible(near.select("pa", "pb", "block", "first", "n", "bins"), percent))
    # both sides are shuffled at every size: how many sets are in families has no bound
    texts = docs.join(wanted.withColumnRenamed("first", "doc_id").hint("merge"), "doc_id")
    links = settle(family_links(texts, percent, words))
    equal = sets.where("n > 0 and doc_id is not null").select("doc_id", "a", "b").join(
        classes.select("a", "b", "first"), ["a", "b"]).select(F.col("doc_id").alias("u"), F.col("first").alias("v"))
    roots = connected(links.unionByName(equal), "u", "v")
    return (sets.select("doc_id", F.col("n").alias("n_shingles"))
            .join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """The documents that are the smallest of their component; rows without doc_id stay.

    A document is a doc_id with a text: where one id comes with several texts,
    each stands for itself and none goes unless it is a copy. The text of the
    smallest hash stands for the id, the others count as larger than all ids. Of
    repeated rows, equal in id and text, the one of the smallest hash stays.
    """
    own = docs.withColumns({"__x": F.xxhash64("text"), "__y": F.xxhash64(F.lit(1), "text")})
    known, texts = own.where(F.col("doc_id").isNotNull()), F.struct("__x", "__y")
    # both sides are narrow: an id and two hashes
    ids = known.groupBy("doc_id").agg(F.min(texts).alias("low"), F.max(texts).alias("high"))
    several = settle(ids.where("low != high").select("doc_id", "low"))
    if several.isEmpty():
        named = known.withColumn("__id", F.col("doc_id").cast("long"))
    else:
        others = (known.join(several, "doc_id").where(texts != F.col("low")).select("doc_id", "__x", "__y").distinct())
        last = docs.agg(F.greatest(F.max(F.col("doc_id").cast("long")), F.lit(0))).first()[0]
        fresh = settle(number_rows(others, ["doc_id", "__x", "__y"], "__fresh", start=last + 1))
        named = known.join(fresh, ["doc_id", "__x", "__y"], "left").withColumn(
            "__id", F.coalesce("__fresh", F.col("doc_id").cast("long")))
    keep = components(named.select(F.col("__id").alias("doc_id"), "text"), percent, words=words).where(
        "doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    single = (named.join(keep, "__id", "left_semi").select("__id", row.alias("row"))
              .groupBy("__id").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row.*"))
    return single.unionByName(docs.where(F.col("doc_id").isNull()))
