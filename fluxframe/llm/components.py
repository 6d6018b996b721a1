"""Connected components by alternating star steps, every step a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fluxframe.session import settle


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node on an edge; the root is the smallest node reachable.

    In a large-star step every node hands its larger neighbours to the smallest
    node it knows, in a small-star step its smaller ones; both shrink every
    component towards a star, in about log(n) rounds. Sums over the edges tell
    when nothing moves. No node gathers its neighbours in one place: each step
    is a minimum per node, combined in the map tasks, and a join.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    edges, state = settle(edges), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u != v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        edges = settle(small.unionByName(least.withColumnRenamed("m", "v")).distinct())
        row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            break
        state = tuple(row)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
