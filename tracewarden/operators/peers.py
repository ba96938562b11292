"""Decaying risk score per peer.

After each observation: score = score * max(0, 1 - hours_since_last / 2) + weight. That is an
affine map per row, so it composes: inside an hour chunk the scores come from windowed products and
sums, whole chunks are folded from one summary row each, and the two are put together.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden.functions.asof import carry_last, chunk_of
from tracewarden.functions.ranks import peer_weight

# Decay per hour and alarm threshold.
DECAY_PER_HOUR = 0.5
THRESHOLD = 10.0

_FOLD = T.StructType([
    T.StructField("counterparty", T.StringType()),
    T.StructField("_chunk", T.LongType()),
    T.StructField("_start", T.DoubleType()),
])


def _fold_chunks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Score entering each chunk of one peer; one input row per chunk that has rows."""
    pdf = pdf.sort_values("_chunk")
    score, starts = 0.0, []
    for entry, product, total in zip(pdf["_entry"], pdf["_product"], pdf["_total"]):
        start = score * entry
        starts.append(start)
        score = product * (start + total)
    return pd.DataFrame({"counterparty": pdf["counterparty"], "_chunk": pdf["_chunk"], "_start": starts})


def peer_risk(obs: DataFrame) -> DataFrame:
    """Observations ``counterparty, findings, action, severity, ts, seq`` with score and alarm added."""
    obs = obs.where(F.coalesce("counterparty", F.lit("")) != "")
    rows = carry_last(obs, ["counterparty"], ["ts", "seq"], {"_prev": F.col("ts")})
    hours = (F.unix_micros("ts") - F.unix_micros("_prev")) / 3.6e9
    decay = F.when(F.col("_prev").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - DECAY_PER_HOUR * hours))
    chunk = chunk_of("ts")
    inside = Window.partitionBy("counterparty", "_chunk").orderBy("ts", "seq")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (
        rows.withColumn("_chunk", chunk)
        .withColumn("_decay", decay)
        .withColumn("_weight", peer_weight("severity", "action"))
        # the first row of a chunk decays the incoming score, later rows the score within the chunk
        .withColumn("_first", F.row_number().over(inside) == 1)
        .withColumn("_product", F.product(F.when(F.col("_first"), 1.0).otherwise(F.col("_decay"))).over(upto))
        .withColumn("_total", F.sum(F.col("_weight") / F.col("_product")).over(upto))
    )
    at = F.struct("ts", "seq")
    summary = rows.groupBy("counterparty", "_chunk").agg(
        F.min_by("_decay", at).alias("_entry"),
        F.max_by("_product", at).alias("_product"),
        F.max_by("_total", at).alias("_total"))
    starts = summary.groupBy("counterparty").applyInPandas(_fold_chunks, _FOLD)
    score = F.col("_product") * (F.col("_start") + F.col("_total"))
    return (
        rows.join(starts, ["counterparty", "_chunk"])
        .withColumn("risk_score", score)
        .withColumn("alarm", (F.col("risk_score") >= THRESHOLD) & (F.col("risk_score") - F.col("_weight") < THRESHOLD))
        .select(*obs.columns, "risk_score", "alarm")
    )


def peer_alarms(scored: DataFrame) -> DataFrame:
    """Threshold crossings as findings."""
    return scored.where("alarm").select(
        "counterparty", "ts", "seq",
        F.lit("counterparty.risk_threshold").alias("rule_id"),
        F.lit("high").alias("severity"),
        F.concat(F.lit("counterparty "), "counterparty", F.lit(" crossed risk threshold (10)")).alias("description"))


def peer_list(scored: DataFrame, limit: int = 0) -> DataFrame:
    """Latest entry per peer, riskiest first."""
    at = F.struct("ts", "seq")
    out = (
        scored.groupBy("counterparty")
        .agg(
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
            F.count("*").alias("requests"),
            F.sum("findings").cast("bigint").alias("findings"),
            F.count_if(F.col("action") == "warn").alias("warnings"),
            F.count_if(F.col("action") == "block").alias("blocks"),
            F.max_by("risk_score", at).alias("risk_score"),
            F.max_by("severity", F.when(F.col("severity") != "", at)).alias("last_severity"),
        )
        .orderBy(F.desc("risk_score"), F.asc("counterparty"))
    )
    return out.limit(limit) if limit > 0 else out
