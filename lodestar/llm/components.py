"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW_ROWS, merging, stored, together


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the smallest node of its component.

    Each step joins nodes with their smallest neighbour, which is an aggregate, so no task holds a node's neighbours; a
    component of n nodes takes about log n rounds. It ends when the edges no longer change: their number and hash. Few edges
    are kept in one partition.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    state, few = None, edges.count() <= FEW_ROWS
    for _ in range(max_rounds):
        edges = together(edges, few)
        both = together(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), few)
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(merging(low, few), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = together(large, few).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(merging(down, few), "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(down.select("a", F.col("m").alias("b")))
        edges = stored(together(small, few).distinct(), "cc-round")
        now = tuple(together(edges, few).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    roots = edges.groupBy("b").agg(F.lit(1).alias("one")).select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
