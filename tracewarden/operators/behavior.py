"""Behavioural anomalies: new peers, rate spikes, finding-rate spikes, repeat suppression."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden.functions.ranks import severity_rank
from tracewarden.operators.analytics import n_findings
from tracewarden.schema import EVENT_SCHEMA_VERSION

# Defaults of the detector; history is six windows including the recent one.
WINDOW = dt.timedelta(minutes=5)
FACTOR = 3.0
MIN_OBSERVATIONS = 10
HISTORY_WINDOWS = 6


def bucket_key(counterparty: str = "counterparty", run: str = "agent_run_id", method: str = "method") -> Column:
    """peer, else run, else method; NULL when a row has none of them."""
    def tagged(prefix: str, c: str) -> Column:
        return F.when(F.col(c) != "", F.concat(F.lit(prefix), F.col(c)))

    return F.coalesce(tagged("peer:", counterparty), tagged("run:", run), tagged("method:", method))


def _history(ledger: DataFrame, as_of: dt.datetime, window: dt.timedelta) -> DataFrame:
    return ledger.where(F.col("ts") >= F.lit(as_of - HISTORY_WINDOWS * window))


def novel_peers(ledger: DataFrame, as_of: dt.datetime, seen: DataFrame | None = None,
                window: dt.timedelta = WINDOW, order: str = "newest") -> DataFrame:
    """Unseen peers whose first-read row in the history is high or critical.

    The ledger is read newest first, so by default the newest row decides; ``order="oldest"``
    takes the earliest. One row per peer is kept by partial aggregation, not by a sort.
    """
    pick = F.max_by if order == "newest" else F.min_by
    peers = (
        _history(ledger, as_of, window)
        .where(F.col("counterparty") != "")
        .groupBy("counterparty").agg(pick("severity", "seq").alias("peer_severity"))
    )
    if seen is not None:
        peers = peers.join(seen.select("counterparty").distinct(), "counterparty", "left_anti")
    return peers.where(severity_rank("peer_severity") >= 3).select(
        F.lit("behavior.novelty_high_severity").alias("rule_id"),
        F.col("counterparty").alias("match"),
        F.lit("high").alias("severity"),
        F.concat(F.lit("first event from this counterparty arrived at "), "peer_severity", F.lit(" severity"))
        .alias("description"),
        F.lit("counterparty").alias("field"),
        F.lit(0.85).alias("confidence"),
        F.lit(as_of).alias("ts"),
    )


def rate_spikes(ledger: DataFrame, as_of: dt.datetime, window: dt.timedelta = WINDOW, factor: float = FACTOR,
                min_obs: int = MIN_OBSERVATIONS) -> DataFrame:
    """Keys whose recent count is ``factor`` times the mean of the earlier five windows."""
    factor = factor if factor > 1 else FACTOR
    recent = F.col("ts") >= F.lit(as_of - window)
    per_key = (
        _history(ledger, as_of, window)
        .withColumn("bucket_key", bucket_key())
        .where(F.col("bucket_key").isNotNull())
        .groupBy("bucket_key")
        .agg(F.count("*").alias("hist"), F.count_if(recent).alias("recent"))
        .where((F.col("recent") > 0) & (F.col("hist") >= min_obs))
        .withColumn("baseline_mean", (F.col("hist") - F.col("recent")) / 5.0)
        .where(F.col("baseline_mean") > 0)
        .withColumn("ratio", F.col("recent") / F.col("baseline_mean"))
        .where(F.col("ratio") >= factor)
    )
    return per_key.select(
        F.lit("behavior.rate_spike").alias("rule_id"),
        F.col("bucket_key").alias("match"),
        F.lit("medium").alias("severity"),
        F.format_string("rate spike: %d events in window (baseline %.1f, %.1fx)", "recent", "baseline_mean", "ratio")
        .alias("description"),
        F.lit("bucket").alias("field"),
        F.least(F.lit(0.95), F.col("ratio") / 10).alias("confidence"),
        F.lit(as_of).alias("ts"),
        "recent", "baseline_mean", "ratio",
    )


def finding_rate_spikes(ledger: DataFrame, as_of: dt.datetime, window: dt.timedelta = WINDOW,
                        factor: float = FACTOR, min_obs: int = MIN_OBSERVATIONS) -> DataFrame:
    """Peers whose recent findings per event are ``factor`` times their history."""
    recent = F.col("ts") >= F.lit(as_of - window)
    per_peer = (
        _history(ledger, as_of, window)
        .where(F.col("counterparty") != "")
        .groupBy("counterparty")
        .agg(
            F.count_if(recent).alias("recent_events"),
            F.sum(F.when(recent, n_findings()).otherwise(0)).alias("recent_findings"),
            F.count("*").alias("hist_events"),
            F.sum(n_findings()).alias("hist_findings"),
        )
        .where((F.col("recent_events") >= min_obs) & (F.col("hist_findings") > 0))
        .withColumn("recent_rate", F.col("recent_findings") / F.col("recent_events"))
        .withColumn("historical_rate", F.col("hist_findings") / F.col("hist_events"))
        .where(F.col("recent_rate") >= F.col("historical_rate") * factor)
    )
    return per_peer.select(
        F.lit("behavior.findings_rate_spike").alias("rule_id"),
        F.col("counterparty").alias("match"),
        F.lit("high").alias("severity"),
        F.format_string("counterparty findings rate %.2f vs historical %.2f", "recent_rate", "historical_rate")
        .alias("description"),
        F.lit("counterparty").alias("field"),
        F.lit(0.9).alias("confidence"),
        F.lit(as_of).alias("ts"),
        "recent_rate", "historical_rate",
    )


def suppress_repeats(findings: DataFrame, window: dt.timedelta = WINDOW, keys: tuple = ("rule_id", "match"),
                     ts: str = "ts", seq: str = "seq", chunk_windows: int = 64) -> DataFrame:
    """Drop a finding that comes within one window of the last one emitted for its key.

    The emitted times of a key form a chain: from an emitted time, the next is the first time at
    least one window later. Times are cut into chunks of many windows. Each (key, chunk) task works
    out where a chain leaves the chunk for every time it could enter (only the first window of a
    chunk can be an entry), a short pass over these summaries finds the real entries, and each chunk
    then marks its emitted times. No task ever holds more of a key than one chunk.
    """
    width = int(window.total_seconds() * 1_000_000)
    chunk = width * chunk_windows
    keyed = findings.withColumn("_t", F.unix_micros(ts)).withColumn("_chunk", F.floor(F.col("_t") / chunk))
    # rows with the same key and time: only the first can be emitted
    times = keyed.groupBy(*keys, "_chunk", "_t").agg(F.min(seq).alias("_first_seq"))
    by_name = {f.name: f for f in times.schema.fields}
    key_fields = [by_name[k] for k in keys]

    exits = times.groupBy(*keys, "_chunk").applyInPandas(
        lambda k, pdf: _chunk_exits(k, pdf, width, chunk, keys),
        T.StructType(key_fields + [T.StructField("_chunk", T.LongType()), T.StructField("_enter", T.LongType()),
                                   T.StructField("_exit", T.LongType())]))
    entries = exits.groupBy(*keys).applyInPandas(
        lambda k, pdf: _chunk_entries(k, pdf, width, keys),
        T.StructType(key_fields + [T.StructField("_chunk", T.LongType()), T.StructField("_start", T.LongType())]))
    emitted = times.join(entries, [*keys, "_chunk"]).groupBy(*keys, "_chunk").applyInPandas(
        lambda k, pdf: _chunk_marks(k, pdf, width, keys),
        T.StructType(key_fields + [T.StructField("_t", T.LongType()), T.StructField("_first_seq", by_name["_first_seq"].dataType)]))
    return (
        keyed.join(emitted.withColumnRenamed("_first_seq", seq), [*keys, "_t", seq], "left_semi")
        .select(*findings.columns)
    )


def _jumps(t, width):
    import numpy as np

    return np.searchsorted(t, t + width, side="left")


def _chunk_exits(key, pdf, width, chunk, keys):
    """Last emitted time of the chunk for each time in its first window that can start the chain."""
    import numpy as np
    import pandas as pd

    t = np.sort(pdf["_t"].to_numpy())
    nxt = _jumps(t, width)
    last = np.arange(len(t))
    for i in range(len(t) - 1, -1, -1):
        if nxt[i] < len(t):
            last[i] = last[nxt[i]]
    # a chain enters at the first time >= (previous emission + window): the previous emission lies
    # before the chunk, so the entry is the first time overall or one in the chunk's first window,
    # or the first time after that window
    begin = int(key[-1]) * chunk
    enter = np.flatnonzero(t < begin + width)
    after = np.searchsorted(t, begin + width, side="left")
    enter = np.unique(np.concatenate([enter, [0], [after]]))
    enter = enter[enter < len(t)]
    out = {k: v for k, v in zip(keys, key)}
    return pd.DataFrame({**{k: [v] * len(enter) for k, v in out.items()}, "_chunk": int(key[-1]),
                         "_enter": t[enter], "_exit": t[last[enter]]})[[*keys, "_chunk", "_enter", "_exit"]]


def _chunk_entries(key, pdf, width, keys):
    """Walk the chunks of one key: which time starts the chain in each chunk, if any."""
    import numpy as np
    import pandas as pd

    pdf = pdf.sort_values(["_chunk", "_enter"])
    chunks, starts, emitted = [], [], None
    for chunk, part in pdf.groupby("_chunk", sort=True):
        enter = part["_enter"].to_numpy()
        i = 0 if emitted is None else int(np.searchsorted(enter, emitted + width, side="left"))
        if i < len(enter):
            chunks.append(chunk)
            starts.append(int(enter[i]))
            emitted = int(part["_exit"].to_numpy()[i])
    return pd.DataFrame({**{k: [v] * len(chunks) for k, v in zip(keys, key)}, "_chunk": chunks, "_start": starts})


def _chunk_marks(key, pdf, width, keys):
    import numpy as np

    pdf = pdf.sort_values("_t")
    t = pdf["_t"].to_numpy()
    nxt = _jumps(t, width)
    i = int(np.searchsorted(t, int(pdf["_start"].iloc[0]), side="left"))
    keep = []
    while i < len(t):
        keep.append(i)
        i = int(nxt[i])
    return pdf.iloc[keep][[*keys, "_t", "_first_seq"]]


def anomaly_events(findings: DataFrame, sensor_id: str = "control-plane") -> DataFrame:
    """Anomalies as ledger events, ready for ``unionByName`` with traffic."""
    peer = F.when(F.col("field") == "counterparty", F.col("match")).when(
        F.col("match").startswith("peer:") & (F.length("match") > 5), F.substring("match", 6, 1 << 30)).otherwise("")
    run = F.when((F.col("field") == "bucket") & F.col("match").startswith("run:") & (F.length("match") > 4),
                 F.substring("match", 5, 1 << 30)).otherwise("")
    finding = F.struct(
        "rule_id", F.lit("policy").alias("category"), "severity", "description", "match", "field", "confidence",
        F.create_map().cast("map<string,string>").alias("metadata"))
    return findings.select(
        F.lit(EVENT_SCHEMA_VERSION).alias("schema"),
        "ts",
        F.lit(sensor_id).alias("sensor_id"),
        F.lit("").alias("tenant_id"),
        run.alias("agent_run_id"),
        peer.alias("counterparty"),
        F.lit("behavior").alias("protocol"),
        F.lit("inbound").alias("direction"),
        F.lit("behavior.tick").alias("method"),
        F.array(finding).alias("findings"),
        F.lit("warn").alias("action"),
        "severity",
    )
