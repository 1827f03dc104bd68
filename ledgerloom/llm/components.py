"""Connected components of a graph given as a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch, join_apart


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Every larger neighbour of a node goes to the smallest node around it."""
    both = _both(links)
    least = scratch.cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")))
    moved = join_apart(both.where("b > a"), least, "a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Every smaller neighbour of a node, and the node, go to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = scratch.cut(down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
    moved = join_apart(down, least, "a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _settled(links: DataFrame) -> bool:
    """Whether all links go from a node that has no other to one that has only such."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(links.select("b", F.lit(0)))
    per = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    return per.where("up > 1 or (up = 1 and n > 1)").isEmpty()


def components(links: DataFrame, scratch: Scratch, rounds: int = 100) -> DataFrame:
    """links: a, b long. Returns node, root: each linked node with the smallest node that it reaches.

    Each round moves nodes to smaller neighbours through two joins on keys, hubs apart, until only stars are left; nothing is
    collected but counts. The work is O(links) a round and
    the rounds grow with the logarithm of the longest path. Links of a node to itself are dropped."""
    now = scratch.cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        if _settled(now):
            break
        larger = scratch.cut(_large(now, scratch))
        after = scratch.cut(_small(larger, scratch))
        scratch.drop(larger)
        scratch.drop(now)
        now = after
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
