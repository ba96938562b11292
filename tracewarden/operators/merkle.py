"""Merkle roots and proofs over ordered leaves.

Leaves are rows ``idx`` (dense, from 0) and ``hash`` (hex). An odd last node is paired with itself.
Ten levels are folded inside one row per block of 1024 leaves, so a trillion leaves need four
shuffles, and no group is larger than a block.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_LEVELS = 10
EMPTY_ROOT = hashlib.sha256(b"").hexdigest()


def pair_hash(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.unhex(left), F.unhex(right)), 256)


def _next_level(nodes: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int")),
        lambda i: pair_hash(F.get(nodes, i * 2), F.coalesce(F.get(nodes, i * 2 + 1), F.get(nodes, i * 2))))


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.groupBy(F.floor(F.col("idx") / (1 << levels)).cast("bigint").alias("block")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda x: x["hash"]).alias("nodes"))


def _depth(n: int) -> int:
    return (n - 1).bit_length() if n > 1 else 0


def _node_levels(leaves: DataFrame, n: int):
    """Yield (first level, blocks with all levels up to the next round) bottom-up."""
    depth, base, nodes = _depth(n), 0, leaves.select("idx", "hash")
    while base < depth:
        levels = min(BLOCK_LEVELS, depth - base)
        stack = F.aggregate(
            F.sequence(F.lit(1), F.lit(levels)),
            F.array(F.col("nodes")),
            lambda acc, _: F.concat(acc, F.array(_next_level(F.element_at(acc, -1)))))
        blocks = _blocks(nodes, levels).withColumn("stack", stack)
        yield base, levels, blocks
        nodes = blocks.select(F.col("block").alias("idx"), F.get(F.element_at("stack", -1), F.lit(0)).alias("hash"))
        base += levels
    yield depth, 0, nodes


def merkle_root(leaves: DataFrame) -> DataFrame:
    """One row: ``leaf_count`` and ``merkle_root``."""
    n = leaves.count()
    spark = leaves.sparkSession
    if n == 0:
        return spark.range(1).select(F.lit(0).cast("bigint").alias("leaf_count"), F.lit(EMPTY_ROOT).alias("merkle_root"))
    *_, (_, _, top) = _node_levels(leaves, n)
    return top.select(F.lit(n).cast("bigint").alias("leaf_count"), F.col("hash").alias("merkle_root"))


def merkle_nodes(leaves: DataFrame) -> DataFrame:
    """Every node as (level, idx, hash); level 0 are the leaves."""
    n = leaves.count()
    out = None
    for base, levels, blocks in _node_levels(leaves, max(n, 1)):
        if levels == 0:
            part = blocks.select(F.lit(base).alias("level"), "idx", "hash")
        else:
            # the last level of a block is the first of the next round
            inner = F.slice(F.col("stack"), 1, levels)
            part = blocks.select("block", F.posexplode(inner).alias("k", "row")).select(
                (F.lit(base) + F.col("k")).alias("level"),
                F.col("block"), F.col("k"), F.posexplode("row").alias("i", "hash")).select(
                "level", F.expr(f"block * shiftleft(1L, {levels} - k) + i").alias("idx"), "hash")
        out = part if out is None else out.unionByName(part)
    return out


def _paths(blocks: DataFrame, base: int, levels: int, above: DataFrame | None, wanted: DataFrame | None) -> DataFrame:
    """(idx, leaf, path) of the nodes of one round: the steps inside the block, then the steps of the block's own root."""
    rows = blocks
    places = F.sequence(F.lit(0), F.size("nodes") - 1)
    if wanted is not None:
        block = F.floor(F.col("idx") / (1 << levels)).cast("bigint")
        asked = wanted.groupBy(block.alias("block")).agg(F.collect_set((F.col("idx") - block * (1 << levels)).cast("int")).alias("_asked"))
        rows = rows.join(asked.hint("shuffle_hash"), "block")
        places = F.filter("_asked", lambda i: (i >= 0) & (i < F.size("nodes")))
    if above is not None:  # neither side is ever broadcast: both grow with the leaves
        rows = rows.join(above.select(F.col("idx").alias("block"), F.col("path").alias("_above")).hint("shuffle_hash"), "block")

    def step(i: Column, k: Column) -> Column:
        own, row = F.call_function("shiftright", i, k), F.get("stack", k)
        return F.struct((F.lit(base) + k).alias("level"), F.coalesce(F.get(row, own.bitwiseXOR(F.lit(1))), F.get(row, own)).alias("sibling"),
                        (own % 2 == 0).alias("right"))

    def path(i: Column) -> Column:
        inside = F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda k: step(i, k))
        return inside if above is None else F.concat(inside, F.col("_above"))

    # outer: a plain explode adds a filter on its array, for which all paths would be built a second time
    found = rows.select(F.explode_outer(F.transform(places, lambda i: F.struct(
        (F.col("block") * (1 << levels) + i).alias("idx"), F.get("nodes", i).alias("leaf"), path(i).alias("path")))).alias("_p"))
    return found.where("_p is not null").select("_p.*")


def merkle_proof(leaves: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Audit path per wanted leaf (``idx``; all by default): array of (level, sibling, right).

    A missing right sibling is the node itself. Rounds go top-down: a block's row holds all siblings of its leaves, so the only
    rows that are joined are one path per block and round.
    """
    n = leaves.count()
    wanted = None if wanted is None else wanted.select(F.col("idx").cast("bigint").alias("idx")).distinct()
    if _depth(n) == 0:
        base = leaves if wanted is None else leaves.join(wanted, "idx", "left_semi")
        return base.select("idx", F.col("hash").alias("leaf"), F.array().cast("array<struct<level:int,sibling:string,right:boolean>>").alias("path"))
    *rounds, _ = _node_levels(leaves, n)
    asked = [wanted]
    for _, levels, _ in rounds[:-1]:
        asked.append(None if wanted is None else asked[-1].select(F.floor(F.col("idx") / (1 << levels)).cast("bigint").alias("idx")).distinct())
    above = None
    for (base, levels, blocks), some in zip(reversed(rounds), reversed(asked)):
        above = _paths(blocks, base, levels, above, some)
    return above


def verify_proofs(proofs: DataFrame, root: Column | str) -> DataFrame:
    """Add ``valid``: does the path lead from the leaf to the root?"""
    root = F.lit(root) if isinstance(root, str) else root
    climbed = F.aggregate("path", F.col("leaf"), lambda acc, step: F.when(
        step["right"], pair_hash(acc, step["sibling"])).otherwise(pair_hash(step["sibling"], acc)))
    return proofs.withColumn("valid", climbed == root)
