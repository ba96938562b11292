"""Ranks and weights as CASE expressions (stay inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Orders and weights used in scores.
SEVERITY_RANK = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
MODE_RANK = {"monitor": 0, "warn": 1, "block": 2}
SEVERITY_WEIGHT = {"critical": 4.0, "high": 3.0, "medium": 2.0, "low": 1.0}
PEER_WEIGHT = {"critical": 5.0, "high": 2.5, "medium": 1.0, "low": 0.25}
PEER_BLOCK_WEIGHT = 4.0


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def computed_once(c: Column) -> Column:
    """The same value, opaque to predicate pushdown and projection merging.

    A filter on a costly column would otherwise be rewritten to its whole expression below the projection,
    which then evaluates it again for every use. A condition that holds for every row but that the optimizer cannot
    fold keeps the column where it is.
    """
    return F.when(F.rand() >= 0.0, c)


def lookup(c: Column | str, table: dict, default) -> Column:
    """CASE c WHEN key THEN value ... ELSE default END."""
    c = as_col(c)
    out = None
    for key, value in table.items():
        out = F.when(c == key, F.lit(value)) if out is None else out.when(c == key, F.lit(value))
    return out.otherwise(F.lit(default))


def severity_rank(c: Column | str) -> Column:
    return lookup(c, SEVERITY_RANK, 0)


def mode_rank(c: Column | str) -> Column:
    return lookup(c, MODE_RANK, 0)


def severity_weight(c: Column | str) -> Column:
    return lookup(c, SEVERITY_WEIGHT, 0.0)


def peer_weight(severity: Column | str, action: Column | str) -> Column:
    """Increment of a peer's risk score for one observation."""
    return lookup(severity, PEER_WEIGHT, 0.0) + lookup(action, {"block": PEER_BLOCK_WEIGHT}, 0.0)


def severity_of_rank(rank: Column) -> Column:
    return lookup(rank, {v: k for k, v in SEVERITY_RANK.items()}, "info")


def mode_of_rank(rank: Column) -> Column:
    return lookup(rank, {v: k for k, v in MODE_RANK.items()}, "monitor")


def action_of_mode(mode: Column | str) -> Column:
    return lookup(mode, {"warn": "warn", "block": "block"}, "allow")
