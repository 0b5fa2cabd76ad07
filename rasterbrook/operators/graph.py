"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, settled


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over edges (a, b) of any orderable type, structs too.

    Nodes move to the least neighbour of theirs until nothing changes; a step is a grouped minimum,
    combined before its shuffle, joined back to the edges, so no node's neighbours are gathered. Each
    round is a written table, the one before it deleted. Nodes without an edge to another aren't returned.
    """
    pairs = settled(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    before = None
    while not pairs.isEmpty():
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        far = both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        least = far.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        near = far.join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = settled(near.unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b"))).where("a > b").distinct())
        discard(pairs)
        pairs = now
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
