"""Tool quarantine: flagged tool listings block later calls to the tool."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.asof import carry_last
from tracewarden.schema import FINDING

TTL = dt.timedelta(hours=24)


def quarantine_entries(events: DataFrame, ttl: dt.timedelta | None = TTL) -> DataFrame:
    """Entries from outbound tools/list events (``method, direction, result, findings, ts``).

    Any high or critical finding on ``result.tools.<i>`` puts tool i in quarantine until its TTL
    runs out (no TTL: for good).
    """
    serious = F.filter("findings", lambda f: f["severity"].isin("high", "critical")
                       & f["field"].rlike(r"\Aresult\.tools\.[0-9]"))
    flagged = (
        events
        .where((F.col("method") == "tools/list") & (F.col("direction") == "outbound"))
        .where(F.exists("findings", lambda f: f["severity"].isin("high", "critical")))
        .withColumn("_tools", F.from_json("result", "tools array<struct<name:string>>")["tools"])
        .select("ts", "_tools", F.posexplode(serious).alias("_pos", "_f"))
        .withColumn("_i", F.regexp_extract("_f.field", r"\Aresult\.tools\.([0-9]+)", 1).cast("int"))
        .withColumn("tool", F.get("_tools", F.col("_i"))["name"])
        .where(F.coalesce("tool", F.lit("")) != "")
    )
    expires = F.col("ts") + F.expr(f"INTERVAL '{int(ttl.total_seconds())}' SECOND") if ttl else F.lit(None).cast("timestamp")
    return flagged.select(
        "tool", F.col("_f.description").alias("reason"), F.col("_f.rule_id").alias("rule_id"),
        F.col("_f.severity").alias("severity"), F.col("ts").alias("added_at"), expires.alias("expires_at"),
        F.col("_pos").alias("pos"))


def apply_quarantine(calls: DataFrame, entries: DataFrame) -> DataFrame:
    """Calls (``msg_id, tool, ts``) that hit a live entry, with the finding that blocks them.

    A re-add replaces the entry, so the last one before the call decides. Entries and calls are
    merged into one ordered stream per tool; no call is ever paired with more than one entry.
    """
    stream = calls.where(F.coalesce("tool", F.lit("")) != "").select(
        "tool", "ts", F.lit(0).alias("_kind"), F.lit(0).alias("_pos"), "msg_id",
        F.lit(None).cast("struct<reason:string,rule_id:string,expires_at:timestamp>").alias("_entry")
    ).unionByName(entries.select(
        "tool", F.col("added_at").alias("ts"), F.lit(1).alias("_kind"), F.col("pos").cast("int").alias("_pos"),
        F.lit(None).cast(calls.schema["msg_id"].dataType).alias("msg_id"),
        F.struct("reason", "rule_id", "expires_at").alias("_entry")))
    known = carry_last(stream, ["tool"], ["ts", "_kind", "_pos"], {"_live": F.col("_entry")})
    live = F.col("_live").isNotNull() & (
        F.col("_live.expires_at").isNull() | (F.col("ts") <= F.col("_live.expires_at")))
    finding = F.struct(
        F.lit("quarantine.tool").alias("rule_id"), F.lit("tool-poisoning").alias("category"),
        F.lit("high").alias("severity"),
        F.concat(F.lit("tool is quarantined: "), F.coalesce("_live.reason", F.lit(""))).alias("description"),
        F.col("tool").alias("match"), F.lit("params.name").alias("field"), F.lit(1.0).alias("confidence"),
        F.create_map(F.lit("quarantine_rule"), F.coalesce("_live.rule_id", F.lit(""))).alias("metadata"),
    ).cast(FINDING)
    return known.where((F.col("_kind") == 0) & live).select("msg_id", "tool", "ts", finding.alias("finding"))
