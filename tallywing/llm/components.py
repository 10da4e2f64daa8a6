"""Connected components of an edge table by alternating large and small stars, no node's edges in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywing.llm.common import Scratch

ROUNDS = 60


def _to_least(pairs: DataFrame) -> DataFrame:
    """(a, b, m): m is the least of a and of all b that a has. The minimum is combined before the shuffle, and the
    join back splits a node with very many edges.
    """
    return pairs.join(pairs.groupBy("a").agg(F.min("b").alias("least")), "a").select("a", "b", F.least("a", "least").alias("m"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every node that has an edge to another; component is the least id reachable.

    `edges` has long columns a and b; direction, repeated edges and loops don't matter.
    """
    edges = edges.where("a != b and a is not null and b is not null")
    now, path = scratch.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    was = None
    for _ in range(ROUNDS):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _to_least(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = _to_least(large.where("a != b").distinct())
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        new, new_path = scratch.write(small.where("a != b").distinct(), "edges")
        scratch.drop(path)
        now, path = new, new_path
        # Stars that no round changes any more are the result.
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == was:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
                now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            )
        was = state
    raise RuntimeError(f"components are still changing after {ROUNDS} rounds")
