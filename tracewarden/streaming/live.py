"""Streaming twins of the batch operators.

State uses event time. Rows later than the watermark are not folded into state; the batch operators
over the stored traffic give the final answer for them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewarden.functions.ranks import peer_weight
from tracewarden.functions.text import canonical_views
from tracewarden.functions.winnow import anchors, windows_around
from tracewarden.operators.behavior import FACTOR, HISTORY_WINDOWS, MIN_OBSERVATIONS, WINDOW, bucket_key
from tracewarden.operators.analytics import n_findings
from tracewarden.operators.envelope import tool_name
from tracewarden.operators.peers import DECAY_PER_HOUR, THRESHOLD
from tracewarden.operators.quarantine import quarantine_entries
from tracewarden.operators.taint import MIN_CANDIDATE
from tracewarden.operators.tasks import LEGAL_MOVES, MAX_AGE, OPEN_STATES
from tracewarden.sources.exports import siem_payloads
from tracewarden.streaming.late import late_split

WATERMARK = "10 minutes"
#: event time after which a silent task is forgotten
FORGET = dt.timedelta(days=7)


def stream_feed(spark: SparkSession, path: str, schema: T.StructType, since_seq: int = 0, format: str = "json",
                max_files: int = 100) -> DataFrame:
    """Live ledger feed with backlog: every record after ``since_seq``, in files as they arrive."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    return reader.format(format).load(path).where(F.col("seq") > since_seq)


def batch_writer(path: str, fn: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that writes each micro-batch to its own folder, so a replay overwrites itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        fn(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def stream_evaluate(stream: DataFrame, out: str, evaluate: Callable[..., DataFrame], rules: Callable[[], object],
                    policies: Callable[[], DataFrame | None], late_out: str | None = None, watermark: str = WATERMARK, **options) -> DataStreamWriter:
    """Decide messages per micro-batch; rules and policies are read again for every batch (hot reload).

    With ``late_out`` the rows behind the watermark are not decided but kept there as they came (``late.late_split``).
    """
    def decide(batch: DataFrame) -> DataFrame:
        return evaluate(batch, rules(), policies(), **options)
    return stream.writeStream.foreachBatch(batch_writer(out, decide) if late_out is None else late_split(out, late_out, decide, watermark))


def _micros(ts) -> int:
    return int(pd.Timestamp(ts).value // 1000)


def _rows(frames: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    """All rows a key got in this micro-batch, in order."""
    got = list(frames)
    return pd.concat(got).sort_values(list(order), kind="stable") if got else pd.DataFrame()


def stream_quarantine(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Live quarantine. Input rows: ``tool, ts, kind`` (0 call, 1 entry), ``msg_id, reason, rule_id, expires_at``.

    One small state per tool; it is dropped when the entry expires.
    """
    schema = "tool string, msg_id string, ts timestamp, reason string, quarantine_rule string"
    state_schema = "reason string, rule_id string, expires bigint"

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        live = state.get if state.exists else None
        out = []
        for r in _rows(frames, "ts", "kind").itertuples():
            at = _micros(r.ts)
            if r.kind == 1:
                expires = -1 if pd.isna(r.expires_at) else _micros(r.expires_at)
                live = (r.reason, r.rule_id, expires)
            elif live is not None and (live[2] < 0 or at <= live[2]):
                out.append((key[0], r.msg_id, r.ts, live[0], live[1]))
        if live is not None and 0 <= live[2] and live[2] // 1000 <= state.getCurrentWatermarkMs():
            # no call that may still come can meet the entry
            if state.exists:
                state.remove()
        elif live is not None:
            state.update(live)
            if live[2] >= 0:
                state.setTimeoutTimestamp(live[2] // 1000 + 1)
        yield pd.DataFrame(out, columns=["tool", "msg_id", "ts", "reason", "quarantine_rule"])

    return events.withWatermark("ts", watermark).groupBy("tool").applyInPandasWithState(
        step, schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout)


def quarantine_feed(events: DataFrame) -> DataFrame:
    """Calls and quarantine entries of one message stream, as ``stream_quarantine`` takes them.

    Events need ``msg_id, ts, method, direction, params, result, findings``; both halves are per-row, so they work on streams.
    """
    none = lambda kind: F.lit(None).cast(kind)
    entries = quarantine_entries(events).select(
        "tool", F.col("added_at").alias("ts"), F.lit(1).alias("kind"), none("string").alias("msg_id"), "reason", "rule_id", "expires_at")
    calls = events.where((F.col("method") == "tools/call") & (F.col("direction") == "inbound")).select(
        tool_name("params").alias("tool"), "ts", F.lit(0).alias("kind"), F.col("msg_id").cast("string").alias("msg_id"),
        none("string").alias("reason"), none("string").alias("rule_id"), none("timestamp").alias("expires_at"))
    return calls.where(F.col("tool") != "").unionByName(entries)


def stream_taint(results: DataFrame, messages: DataFrame, ttl: str = "2 hours", watermark: str = WATERMARK) -> DataFrame:
    """(msg_id, field position, taint) rows of live leaks.

    Stream-stream join on (run, kept gram) inside the TTL, so the state holds one row in about seven bytes. Every tag of a window counts, with its own TTL, in
    whatever order tags arrive. Take the first row per ``msg_id`` in the sink (``first_leak``).
    """
    tagged = (
        results.withWatermark("ts", watermark)
        .select("agent_run_id", F.col("ts").alias("taint_ts"), "taint_id", F.explode(canonical_views(F.col("value"))).alias("_v"))
        .select("agent_run_id", "taint_ts", "taint_id", F.explode(anchors("_v")).alias("_t"))
    )
    sent = (
        messages.withWatermark("ts", watermark)
        .select("msg_id", "agent_run_id", "ts", F.posexplode("fields").alias("field_pos", "_f"))
        .where(F.octet_length(F.col("_f.value")) >= MIN_CANDIDATE)
        .select("msg_id", F.col("agent_run_id").alias("_run"), "ts", "field_pos", F.explode(canonical_views(F.col("_f.value"))).alias("_v"))
        .select("msg_id", "_run", "ts", "field_pos", F.explode(anchors("_v")).alias("_s"))
    )
    near = F.expr(f"ts > taint_ts AND ts <= taint_ts + INTERVAL {ttl}")
    # equal windows select equal grams; whether the bytes around a shared gram hold a shared window is tested in the join
    alike = F.arrays_overlap(windows_around("_s.around"), windows_around("_t.around"))
    return sent.join(tagged, (F.col("_run") == F.col("agent_run_id")) & (F.col("_s.gram") == F.col("_t.gram")) & near & alike).select(
        "msg_id", "agent_run_id", "ts", "field_pos", "taint_id", "taint_ts")


def first_leak(batch: DataFrame) -> DataFrame:
    """One row per message: first field, then earliest tagged value."""
    best = F.min(F.struct("field_pos", "taint_ts", "taint_id")).alias("_b")
    return batch.groupBy("msg_id", "agent_run_id").agg(best).select("msg_id", "agent_run_id", "_b.taint_id")


def stream_tasks(obs: DataFrame, max_age: dt.timedelta = MAX_AGE, watermark: str = WATERMARK,
                 forget: dt.timedelta = FORGET) -> DataFrame:
    """Live task checks: ``task_id, ts, seq, rule_id, description``, long-running tasks by timer.

    A task that was silent for ``forget`` of event time leaves the state; what comes later is a new task. What a result
    declares about its own history needs no state: ``declared_history_findings`` runs on a stream as it is.
    """
    schema = "task_id string, ts timestamp, seq bigint, rule_id string, description string"
    state_schema = "current string, peer string, first_fp string, created bigint, seen bigint, reported boolean"
    legal = LEGAL_MOVES
    age_ms, forget_ms = (int(x.total_seconds() * 1000) for x in (max_age, forget))

    def keep(state: GroupState, known: tuple) -> None:
        """The next timer: the age limit of an open task, else the end of its memory."""
        now, gone = state.getCurrentWatermarkMs(), known[4] // 1000 + forget_ms
        aged = known[3] // 1000 + age_ms
        due = min(aged, gone) if known[0] in OPEN_STATES and not known[5] and aged > now else gone
        if due <= now:
            if state.exists:
                state.remove()
            return
        state.update(known)
        state.setTimeoutTimestamp(due)

    def step(key, frames, state: GroupState):
        out = []
        if state.hasTimedOut:
            current, peer, fp, created, seen, reported = state.get
            if current in OPEN_STATES and not reported and created // 1000 + age_ms <= state.getCurrentWatermarkMs():
                out.append((key[0], pd.Timestamp(created + age_ms * 1000, unit="us"), -1, "task.long_running",
                            f"task still {current}"))
                reported = True
            keep(state, (current, peer, fp, created, seen, reported))
            yield pd.DataFrame(out, columns=["task_id", "ts", "seq", "rule_id", "description"])
            return
        known = state.get if state.exists else None
        for r in _rows(frames, "ts", "seq").itertuples():
            if known is None:
                known = (r.state or "submitted", r.counterparty or "", r.fingerprint or "", _micros(r.ts), _micros(r.ts), False)
                continue
            current, peer, fp, created, seen, reported = known
            found = []
            if r.counterparty and peer and r.counterparty != peer:
                found.append(("task.counterparty_changed",
                              f"task counterparty changed mid-flight (was {peer}, now {r.counterparty})"))
            peer = r.counterparty or peer
            if r.state and r.state != current:
                if r.state not in legal.get(current, ()):
                    found.append(("task.invalid_transition", f"invalid state transition {current} -> {r.state}"))
                current = r.state
            if r.fingerprint and fp and r.fingerprint != fp and current != "submitted":
                found.append(("task.scope_drift", "task message fingerprint differs from initial submission"))
            out.extend((key[0], r.ts, int(r.seq), *f) for f in found)
            known = (current, peer, fp, created, max(seen, _micros(r.ts)), reported)
        if known is not None:
            keep(state, known)
        yield pd.DataFrame(out, columns=["task_id", "ts", "seq", "rule_id", "description"])

    return obs.withWatermark("ts", watermark).groupBy("task_id").applyInPandasWithState(
        step, schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout)


def stream_peer_risk(obs: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Live peer scores: ``counterparty, seq, ts, risk_score, alarm``.

    State is one score and the latest time; it goes away when the score has decayed to nothing.
    """
    weighted = obs.where(F.col("counterparty") != "").withWatermark("ts", watermark).select(
        "counterparty", "ts", "seq", peer_weight("severity", "action").alias("weight"))

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        score, last = state.get if state.exists else (0.0, None)
        out = []
        for r in _rows(frames, "ts", "seq").itertuples():
            at = _micros(r.ts)
            if last is not None and at > last:
                score *= max(0.0, 1.0 - DECAY_PER_HOUR * (at - last) / 3.6e9)
            before, score, last = score, score + r.weight, at if last is None else max(last, at)
            out.append((key[0], int(r.seq), r.ts, score, bool(score >= THRESHOLD > before)))
        if last is not None:
            spent = last // 1000 + int(3_600_000 / DECAY_PER_HOUR) + 1
            if spent > state.getCurrentWatermarkMs():
                state.update((score, last))
                state.setTimeoutTimestamp(spent)
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=["counterparty", "seq", "ts", "risk_score", "alarm"])

    return weighted.groupBy("counterparty").applyInPandasWithState(
        step, "counterparty string, seq bigint, ts timestamp, risk_score double, alarm boolean",
        "score double, last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def stream_metrics(events: DataFrame, bucket: str = "10 seconds", watermark: str = WATERMARK) -> DataFrame:
    """Counts per tumbling bucket: totals by action, findings, distinct peers and runs (approximate)."""
    return (
        events.withWatermark("ts", watermark)
        .groupBy(F.window("ts", bucket).alias("w"))
        .agg(
            F.count("*").alias("total"),
            *[F.count_if(F.col("action") == a).alias(n) for a, n in (("allow", "allowed"), ("warn", "warned"), ("block", "blocked"))],
            F.sum(F.size("findings")).alias("findings"),
            F.approx_count_distinct(F.when(F.col("counterparty") != "", F.col("counterparty"))).alias("unique_peers"),
            F.approx_count_distinct(F.when(F.col("agent_run_id") != "", F.col("agent_run_id"))).alias("unique_runs"))
        .select(F.col("w.start").alias("bucket_start"), "total", "allowed", "warned", "blocked", "findings", "unique_peers", "unique_runs")
    )


def stream_spikes(events: DataFrame, window: dt.timedelta = WINDOW, factor: float = FACTOR,
                  min_obs: int = MIN_OBSERVATIONS, watermark: str = WATERMARK) -> DataFrame:
    """Rate spikes over sliding history windows that end at every multiple of ``window``."""
    seconds = int(window.total_seconds())
    history, slide = f"{seconds * HISTORY_WINDOWS} seconds", f"{seconds} seconds"
    keyed = events.withWatermark("ts", watermark).select("ts", bucket_key().alias("bucket_key")).where(F.col("bucket_key").isNotNull())
    sliding = keyed.select("bucket_key", "ts", F.window("ts", history, slide).alias("w"))
    recent = F.col("ts") >= F.col("w.end") - F.expr(f"INTERVAL {seconds} SECONDS")
    counts = sliding.groupBy("bucket_key", "w").agg(F.count("*").alias("hist"), F.count_if(recent).alias("recent"))
    baseline = (F.col("hist") - F.col("recent")) / 5.0
    return (
        counts.where((F.col("recent") > 0) & (F.col("hist") >= min_obs) & (F.col("hist") > F.col("recent")))
        .withColumn("baseline_mean", baseline)
        .withColumn("ratio", F.col("recent") / F.col("baseline_mean"))
        .where(F.col("ratio") >= factor)
        .select("bucket_key", F.col("w.end").alias("as_of"), "recent", "baseline_mean", "ratio")
    )


def stream_finding_spikes(events: DataFrame, window: dt.timedelta = WINDOW, factor: float = FACTOR,
                          min_obs: int = MIN_OBSERVATIONS, watermark: str = WATERMARK) -> DataFrame:
    """Peers whose recent findings per event are ``factor`` times their history, at every multiple of ``window``."""
    seconds = int(window.total_seconds())
    history, slide = f"{seconds * HISTORY_WINDOWS} seconds", f"{seconds} seconds"
    keyed = events.withWatermark("ts", watermark).where(F.col("counterparty") != "").select("counterparty", "ts", n_findings().alias("n"))
    sliding = keyed.select("counterparty", "ts", "n", F.window("ts", history, slide).alias("w"))
    recent = F.col("ts") >= F.col("w.end") - F.expr(f"INTERVAL {seconds} SECONDS")
    counts = sliding.groupBy("counterparty", "w").agg(
        F.count_if(recent).alias("recent_events"), F.sum(F.when(recent, F.col("n")).otherwise(0)).alias("recent_findings"),
        F.count("*").alias("hist_events"), F.sum("n").alias("hist_findings"))
    rates = counts.where((F.col("recent_events") >= min_obs) & (F.col("hist_findings") > 0)).select(
        "counterparty", F.col("w.end").alias("as_of"), (F.col("recent_findings") / F.col("recent_events")).alias("recent_rate"),
        (F.col("hist_findings") / F.col("hist_events")).alias("historical_rate"))
    return rates.where(F.col("recent_rate") >= F.col("historical_rate") * factor)


def stream_suppress(findings: DataFrame, window: dt.timedelta = WINDOW, watermark: str = WATERMARK) -> DataFrame:
    """Live repeat suppression; the state of a key goes away one window after its last emission."""
    width = int(window.total_seconds() * 1_000_000)

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for r in _rows(frames, "ts", "seq").itertuples():
            at = _micros(r.ts)
            if last is None or at - last >= width:
                last = at
                out.append((key[0], key[1], r.ts, int(r.seq)))
        if last is not None:
            state.update((last,))
            due = (last + width) // 1000 + 1
            if due > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(due)
        yield pd.DataFrame(out, columns=["rule_id", "match", "ts", "seq"])

    return findings.withWatermark("ts", watermark).groupBy("rule_id", "match").applyInPandasWithState(
        step, "rule_id string, match string, ts timestamp, seq bigint", "last bigint", "append",
        GroupStateTimeout.EventTimeTimeout)


def stream_siem(ledger: DataFrame, out: str, checkpoint: str, min_severity: str = "high", every: str = "2 seconds",
                **options) -> DataStreamWriter:
    """Payloads as text files, one batch per trigger."""
    rows = siem_payloads(ledger, min_severity, **options).select(F.col("body").alias("value"))
    return rows.writeStream.format("text").option("path", out).option("checkpointLocation", checkpoint).trigger(
        processingTime=every)
