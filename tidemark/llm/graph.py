"""Connected components by alternating large-star and small-star steps, each a grouping and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch


def _directed(pairs: DataFrame) -> DataFrame:
    """Every link once, from its larger to its smaller node."""
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest node next to it (or the node itself)."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return _directed(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(links: DataFrame) -> DataFrame:
    """The smaller neighbours of a node, and the node, move to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _directed(moved.unionByName(least.select("u", F.col("m").alias("v"))))


def _is_stars(links: DataFrame) -> bool:
    """Whether every node has one link down, to a node without one."""
    ends = links.select("u", F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(links.select(F.col("v").alias("u"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("u").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down > 0 and up > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (u, v): root is the smallest node reachable. No links, no rows.

    Rounds grow with the logarithm of the longest chain. A node with many links is a hot key of a grouping with
    map-side combine and of a join, never one collected group. Each round is written to the shared folder, so a lost
    executor costs a re-read, and the round before is deleted.
    """
    scratch = Scratch(edges)
    links = scratch.table(_directed(edges), "links")
    while not _is_stars(links):
        before, links = links, scratch.table(_small_star(_large_star(links)), "links")
        scratch.drop(before)
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
