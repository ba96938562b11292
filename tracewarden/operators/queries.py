"""Filters over the ledger."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.ranks import SEVERITY_RANK, as_col
from tracewarden.schema import GENESIS_HASH

DEFAULT_LIMIT = 50


def meets_min_severity(c: Column | str, minimum: str) -> Column:
    """An IN list of the levels from ``minimum`` up, which a scan can use; the lowest level lets everything pass."""
    least = SEVERITY_RANK.get(minimum, 0)
    return as_col(c).isin(*[k for k, rank in SEVERITY_RANK.items() if rank >= least]) if least else F.lit(True)


def checked_limit(limit: int | None) -> int | None:
    """``None`` means all rows; anything else must be a positive number."""
    if limit is not None and (not isinstance(limit, int) or limit <= 0):
        raise ValueError(f"limit must be a positive number or None, not {limit!r}")
    return limit


def query_events(ledger: DataFrame, action: str = "", method: str = "", severity: str = "",
                 min_severity: str = "", category: str = "", search: str = "", tenant: str = "",
                 since_seq: int = 0, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """Newest matching rows first, all of them with ``limit=None``. Every test is a plain predicate, so the scan can use it."""
    tests = []
    for name, value in (("tenant_id", tenant), ("action", action), ("method", method), ("severity", severity)):
        if value:
            tests.append(F.col(name) == value)
    if since_seq:
        tests.append(F.col("seq") > since_seq)
    if min_severity:
        tests.append(meets_min_severity("severity", min_severity))
    if category:
        tests.append(F.exists("findings", lambda f: f["category"] == category))
    if search:
        tests.append(F.col("raw").contains(search))
    out = ledger
    for test in tests:
        out = out.where(test)
    out = out.orderBy(F.desc("seq"))
    return out if checked_limit(limit) is None else out.limit(limit)


def timeline(ledger: DataFrame, agent_run_id: str, tenant: str = "") -> DataFrame:
    out = ledger.where(F.col("agent_run_id") == agent_run_id)
    if tenant:
        out = out.where(F.col("tenant_id") == tenant)
    return out.orderBy("seq")


def tenant_scope(df: DataFrame, tenant: str, forced: bool = False, write: bool = False) -> DataFrame:
    """Reads of a scoped caller see one tenant; a forced scope also stamps what it writes."""
    if write:
        return df.withColumn("tenant_id", F.lit(tenant)) if forced else df
    return df.where(F.col("tenant_id") == tenant) if tenant else df


def retain(ledger: DataFrame, cutoff: dt.datetime, ts: str = "ts") -> DataFrame:
    """Rows to keep after dropping everything ingested before ``cutoff``."""
    return ledger.where(F.col(ts) >= F.lit(cutoff))


def retention_summary(ledger: DataFrame, cutoff: dt.datetime, ts: str = "ts") -> DataFrame:
    """Kept and dropped counts and the prev_hash the surviving chain starts from, in one pass."""
    kept = F.col(ts) >= F.lit(cutoff)
    return ledger.agg(
        F.count_if(kept).alias("kept"),
        F.count_if(~kept | kept.isNull()).alias("dropped"),
        F.coalesce(F.min_by("prev_hash", F.when(kept, F.col("seq"))), F.lit(GENESIS_HASH)).alias("chain_start"),
    )
