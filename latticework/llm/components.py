"""Connected components by alternating large-star and small-star steps. No node's neighbours are ever collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import joined_by, stored


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n"))
    met = joined_by(both.where("b > a"), least, "a", n, 2 * n)
    return met.select(F.col("b").alias("a"), F.col("found.m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = joined_by(down, least, "a", n, n).select(F.col("b").alias("a"), F.col("found.m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root, the smallest node that its links reach, of every node of edges (a, b); both ends of one type, without nulls."""
    edges = stored(edges.select("a", "b").where("a <> b").distinct(), "links")
    n, before = edges.count(), None
    for _ in range(most_rounds):
        edges = stored(_small_star(stored(_large_star(edges, n), "stars"), 2 * n), "stars")
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b")).distinct()
        before, n = state, state[0]
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
