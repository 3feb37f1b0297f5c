"""Connected components of an edge table by alternating star rewrites, as plain joins and min() aggregates.

Each step is combined before its shuffle and never gathers a node's neighbours, so a node may have any number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewatch.llm import words as W


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points at the smallest one."""
    both = _both(edges)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours point at the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def closer(edges: DataFrame, name: str = "components") -> tuple[DataFrame, dict[str, int]]:
    """One step: edges of the same components, nearer to stars, with the number of edges and a sum of their hashes."""
    state = {"edges": F.count(F.lit(1)), "hashes": F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))}
    return W.stored_with(_small_star(_large_star(edges)), name, **state)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b): each node of the edges (a, b), but the smallest of its component, with that smallest node."""
    current, state = closer(edges.where("a <> b").select("a", "b").distinct(), name)
    while state["edges"]:
        seen = state
        current, state = closer(current, name)
        if state == seen:
            break
    return current
