"""Connected components by alternating large and small stars, one table of edges an iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """id and component (the smallest id that links reach, its own included) of every end of an edge (a, b).

    Each half-step takes a minimum per node, summed before the shuffle, and joins it back; neither gathers a node's neighbours.
    Edges with a null end or equal ends are ignored. The number of steps is about the logarithm of the longest chain.
    """
    links = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(links)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = small.unionByName(lower.select("a", F.col("m").alias("b"))).distinct()
        links = saved(small, "edges")
        before, state = state, _state(links)
        if before == state:
            break
    ends = links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return ends.unionByName(roots)
