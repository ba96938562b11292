"""Partial aggregates of the ledger: one row per tenant and time bucket, which add up to any longer window.

A rollup is made once per stretch of the ledger and merged with the rollups of other stretches; reports then read a few rows per bucket in place of
the events. Counts are exact. Distinct peers and runs are HLL sketches (relative standard error about 1.04 / sqrt(2^LG_K), 1.6 % at 12), latency
quantiles come from KLL sketches (rank error about 1.33 % at the default size). Equal stretches counted twice count twice: a stretch belongs to one rollup.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.operators.analytics import n_findings

#: size of the distinct sketches: 2^LG_K registers
LG_K = 12
ACTIONS = {"allow": "allowed", "warn": "warned", "block": "blocked"}
_COUNTS = ("total", *ACTIONS.values(), "findings")
_SKETCHES = {"peers": "counterparty", "runs": "agent_run_id"}


def rollup(ledger: DataFrame, bucket: dt.timedelta = dt.timedelta(minutes=1)) -> DataFrame:
    """One row per (tenant, bucket): counts and sketches of the events in it.

    Events without a time stand in a bucket that is null. Both steps are partial aggregates, so a hot tenant or bucket costs one row per map task.
    """
    width = bucket // dt.timedelta(microseconds=1)
    start = F.timestamp_micros(F.floor(F.unix_micros("ts") / F.lit(width)) * F.lit(width))
    return ledger.groupBy("tenant_id", start.alias("bucket_start")).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("action") == a).alias(n) for a, n in ACTIONS.items()],
        F.coalesce(F.sum(n_findings()), F.lit(0)).alias("findings"),
        *[F.hll_sketch_agg(F.when(F.col(c) != "", F.col(c)), LG_K).alias(n) for n, c in _SKETCHES.items()],
        F.kll_sketch_agg_bigint("latency_micros").alias("latency"))


def merge_rollups(*parts: DataFrame) -> DataFrame:
    """The rollup of all events behind ``parts``: equal to one made from those events at once, up to the sketches' error."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return _added(rows, "tenant_id", "bucket_start")


def _added(rows: DataFrame, *keys: Column | str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in _COUNTS],
        *[F.hll_union_agg(c).alias(c) for c in _SKETCHES],
        F.kll_merge_agg_bigint("latency").alias("latency"))


def rollup_report(rolled: DataFrame, since: dt.datetime | None = None, by: tuple[str, ...] = (), ps: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Totals of the buckets that start at ``since`` or later, per ``by``; distinct counts and quantiles are estimates, null where nothing was counted."""
    rows = rolled if since is None else rolled.where(F.col("bucket_start") >= F.lit(since))
    wanted = F.array(*[F.lit(float(p)) for p in ps])
    return _added(rows, *by).select(
        *by, *_COUNTS, *[F.hll_sketch_estimate(c).alias(f"unique_{c}") for c in _SKETCHES],
        F.when(F.kll_sketch_get_n_bigint("latency") > 0, F.kll_sketch_get_quantile_bigint("latency", wanted)).alias("latency"))
