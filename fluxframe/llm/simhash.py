"""SimHash near-duplicates: candidates by pigeonring chains, links by Hamming distance.

A fingerprint is cut into one segment more than bits may differ, laid out as a
ring. If two fingerprints differ in at most ``distance`` bits, then from some
segment on every chain of consecutive segments stays within its proportional
budget: the first l segments together differ in at most l * distance / segments
bits. The first budget is 0, so fingerprints meet under each of their segments;
in such a bucket the next segment may differ in one bit, and the chain is
followed segment by segment before the full distance is known.

A bucket gives no pairs but stars: whoever is reached from a fingerprint is
taken out of the bucket's lists, so a group of near copies is worked off in
about as many looks as it has members. Buckets of many fingerprints are cut into
parts, every two of which meet in some task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from fluxframe.llm.common import ASCII_LOWER, by_bytes, documents, runs, tasks
from fluxframe.llm.components import connected
from fluxframe.session import settle

BITS = 64
DISTANCE = 4
#: Words of a shingle, and the seed of its hash.
WORDS, SEED = 4, 42
#: Different fingerprints of a bucket that one task holds.
BLOCK = 1 << 14
#: Shingles hashed before their bits are counted; bounds what a long text takes.
AT_ONCE = 1 << 16
#: Lists from this length on are looked through by NumPy.
LONG = 24


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64 bits, each set if over half of the shingles' hashes have it; 0 without a word."""
    own = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    if not own:
        return 0
    width = min(words, len(own))
    joined = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    starts, ends = starts[:len(own) - width + 1].tolist(), ends[width - 1:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), AT_ONCE):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in
                           zip(starts[at:at + AT_ONCE], ends[at:at + AT_ONCE], strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fingerprint (its 64 bits as a long) of every row; one pass, no shuffle."""
    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            own = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own.view(np.int64))],
                                             ["doc_id", "fingerprint"])

    return documents(docs).mapInArrow(taken, "doc_id long, fingerprint long")


class Ring:
    """Segments of a fingerprint in a ring, and what chains of them may differ in."""

    def __init__(self, distance: int = DISTANCE):
        self.count = distance + 1
        edges = [BITS * k // self.count for k in range(self.count + 1)]
        self.shifts = edges[:-1]
        self.masks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
        self.widths = [b - a for a, b in zip(edges, edges[1:], strict=False)]
        #: Of the first l segments of a chain, l from 1 on.
        self.budgets = [length * distance // self.count for length in range(1, self.count + 1)]

    def chain(self, start: int) -> list[tuple[int, int]]:
        """Masks and budgets from the segment after ``start`` on, which itself is equal."""
        return [(self.masks[(start + k) % self.count], self.budgets[k]) for k in range(1, self.count)]


def stars(prints: np.ndarray, start: int, ring: Ring) -> tuple[list[int], list[int]]:
    """Positions (a, b): b was reached from a by links of which segment ``start`` is equal and the chain holds.

    Positions linked with each other, directly or by others here, get the same a.
    """
    chain = ring.chain(start)
    after = (start + 1) % ring.count
    values = ((prints & np.uint64(ring.masks[after])) >> np.uint64(ring.shifts[after])).tolist()
    flips = [0] + [1 << b for b in range(ring.widths[after])] if chain and chain[0][1] else [0]
    own, left = prints.tolist(), bytearray(b"\1") * len(prints)
    still = np.frombuffer(left, np.uint8)
    lists: dict[int, list | np.ndarray] = defaultdict(list)
    for place, value in enumerate(values):
        lists[value].append(place)
    for value, members in lists.items():
        if len(members) >= LONG:
            lists[value] = np.array(members)
    firsts, others = [], []
    for first in range(len(own)):
        if not left[first]:
            continue
        left[first], edge = 0, [first]
        while edge:
            at = edge.pop()
            for flip in flips:
                value = values[at] ^ flip
                if not len(members := lists.get(value, ())):
                    continue
                if isinstance(members, list):
                    members = [m for m in members if left[m]]
                    found = [m for m in members if _holds(own[at] ^ own[m], chain)]
                    lists[value] = [m for m in members if m not in found] if found else members
                else:
                    members = members[still[members] > 0]
                    close = _hold(prints[members] ^ prints[at], chain)
                    found = members[close].tolist()
                    lists[value] = members[~close]
                for m in found:
                    left[m] = 0
                firsts += [first] * len(found)
                others += found
                edge += found
    return firsts, others


def _holds(differs: int, chain: list[tuple[int, int]]) -> bool:
    total = 0
    for mask, budget in chain:
        total += (differs & mask).bit_count()
        if total > budget:
            return False
    return True


def _hold(differs: np.ndarray, chain: list[tuple[int, int]]) -> np.ndarray:
    alive, total = np.arange(len(differs)), np.zeros(len(differs), np.int64)
    for mask, budget in chain:
        total = total + np.bitwise_count(differs[alive] & np.uint64(mask))
        within = total <= budget
        alive, total = alive[within], total[within]
    close = np.zeros(len(differs), bool)
    close[alive] = True
    return close


def bucketed(classes: DataFrame, ring: Ring, limit: int = BLOCK) -> DataFrame:
    """first and fingerprint under (segment, bucket) of each segment.

    A bucket of more than ``limit`` fingerprints is cut into k parts by hash; its
    block i * k + j holds parts i and j.
    """
    own = F.array(*[F.struct(F.lit(n).alias("segment"),
                             F.shiftrightunsigned(F.col("fingerprint").bitwiseAND(_signed(mask)), shift).alias("value"))
                    for n, (mask, shift) in enumerate(zip(ring.masks, ring.shifts, strict=True))])
    met = classes.select("first", "fingerprint", F.inline(own))
    # as many rows as there are segments times values of one: 5 * 2**13 for a distance of 4, whatever the input
    sizes = met.groupBy("segment", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "segment", "value", F.when(F.col("n") <= limit, 1).otherwise(F.ceil(F.col("n") * 2 / limit)).cast("int").alias("k"))
    k = F.col("k")
    part = F.pmod(F.xxhash64("fingerprint"), k).cast("int")
    meets = F.when(k == 1, F.array(F.lit(0))).otherwise(F.transform(
        F.sequence(F.lit(0), k - 1), lambda other: F.least(part, other) * k + F.greatest(part, other)))
    cut = met.join(sizes.hint("broadcast") if max(ring.widths) <= 16 else sizes, ["segment", "value"])
    return cut.withColumn("block", F.explode(meets)).select(
        "first", "fingerprint", "segment", F.concat_ws(":", "segment", "value", "block").alias("bucket"))


def _signed(mask: int):
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def links(classes: DataFrame, distance: int = DISTANCE, limit: int = BLOCK) -> DataFrame:
    """u, v: firsts of fingerprints, connected just as links of at most ``distance`` bits connect them."""
    ring = Ring(distance)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "bucket"):
            prints = table.column("fingerprint").to_numpy().view(np.uint64)
            a, b = stars(prints, table.column("segment")[0].as_py(), ring)
            if a:
                first = table.column("first").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(first[a]), pa.array(first[b])], ["u", "v"])

    met = bucketed(classes, ring, limit)
    return met.repartition(tasks(met), "bucket").sortWithinPartitions("bucket").mapInArrow(linked, "u long, v long")


def components(docs: DataFrame, distance: int = DISTANCE, words: int = WORDS, limit: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable) of every row.

    Equal fingerprints are one class, so copies cost one comparison. NULL, empty
    and blank texts have fingerprint zero and link like any other; texts are
    taken whole, whatever their length. A row without a doc_id joins nothing and
    has a NULL component. Repeated rows share a component; rows with one doc_id
    and several texts count as one document that has the links of all. An empty
    table gives no rows; further columns are ignored, whatever their names.
    """
    prints = settle(fingerprints(docs, words))
    known = prints.where("doc_id is not null")
    # written, so that joins with it can split a class that a third of all rows share
    classes = settle(known.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    several = (known.groupBy("doc_id").agg(F.min("fingerprint").alias("low"), F.max("fingerprint").alias("high"))
               .where("low != high").select("doc_id"))
    named = known.join(several, "doc_id", "left_semi").join(classes, "fingerprint").select("doc_id", "first").distinct()
    least = named.groupBy("doc_id").agg(F.min("first").alias("v"))
    same_id = named.join(least, "doc_id").select(F.col("first").alias("u"), "v")
    roots = connected(links(classes, distance, limit).unionByName(same_id), "u", "v")
    placed = settle(classes.join(roots.withColumnRenamed("node", "first"), "first", "left")
                    .select("fingerprint", F.coalesce("root", "first").alias("component_id")))
    return prints.join(placed, "fingerprint", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
