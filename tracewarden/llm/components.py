"""Connected components by alternating stars, for edges of any comparable key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _are_stars(edges: DataFrame) -> bool:
    """Does every node have one parent at most, and no parent a parent?"""
    sides = edges.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    wrong = sides.groupBy("x").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).where("c > 1 or (c > 0 and p > 0)")
    return wrong.limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, component) with the smallest reachable node as component, for all nodes of ``edges`` (u, v).

    Each round sends every node's larger neighbours, then its smaller ones, to its smallest neighbour; rounds grow with the
    logarithm of the longest path. The smallest neighbour is an aggregate with partial sums, so a hub costs no more than its rows.
    """
    work = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _are_stars(work):
        both = work.unionByName(work.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        work = stored(small.where("u <> v").distinct(), "edges")
    return work.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        work.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
