"""Sensor fleet view from heartbeats."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_STALE_SECONDS = 60


def sensor_drift(heartbeats: DataFrame, as_of: dt.datetime, active_policy_version: int = 0,
                 active_content_version: str = "", max_stale: int = MAX_STALE_SECONDS) -> DataFrame:
    """Latest heartbeat per sensor with staleness and drift flags.

    A heartbeat without ``started_at`` inherits the last one that had it.
    """
    at = F.struct("last_seen_at", "seq") if "seq" in heartbeats.columns else F.col("last_seen_at")
    latest = (
        heartbeats.where(F.coalesce("sensor_id", F.lit("")) != "")
        .groupBy("sensor_id")
        .agg(
            F.max_by("tenant_id", at).alias("tenant_id"),
            F.max_by("policy_version", at).alias("policy_version"),
            F.max_by("content_version", at).alias("content_version"),
            F.max_by("started_at", F.when(F.col("started_at").isNotNull(), at)).alias("started_at"),
            F.max("last_seen_at").alias("last_seen_at"),
        )
    )
    age = F.floor((F.unix_micros(F.lit(as_of)) - F.unix_micros("last_seen_at")) / F.lit(1_000_000))
    return latest.withColumn("stale_seconds", age.cast("bigint")).select(
        "*",
        (F.col("stale_seconds") > max_stale).alias("is_stale"),
        (F.lit(active_policy_version != 0) & (F.col("policy_version") != active_policy_version)).alias("policy_drift"),
        (F.lit(active_content_version != "") & (F.col("content_version") != active_content_version))
        .alias("content_drift"),
    ).orderBy("sensor_id")
