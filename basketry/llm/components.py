"""Connected components by alternating large and small stars: every round is two joins over the edges left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import Stored


def digest(edges: DataFrame) -> tuple:
    """Number of edges and the sum of their hashes: equal for equal sets."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> Stored:
    """(node, component): the smallest node reachable over edges (u, v), for every node that has an edge.

    Each round links a node's neighbours to its smallest neighbour; the diameter shrinks by a constant factor a round and the
    number of edges does not grow. Edges are written after each round, so a lost executor costs one round at most.
    """
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = Stored(pairs, "star")
    before = digest(now.df)
    while True:
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: larger neighbours move to the smallest node of the neighbourhood
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours and the node itself move to the smallest neighbour
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        then = Stored(moved, "star")
        after = digest(then.df)
        now.drop()
        now = then
        if after == before:
            break
        before = after
    roots = now.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = Stored(now.df.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
    now.drop()
    return out
