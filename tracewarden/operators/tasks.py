"""Task lifecycle checks.

Input: observations ``task_id, counterparty, state, fingerprint, ts, seq`` (empty string = absent).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.asof import carry_first, carry_last

# Legal moves of the lifecycle; the last three states are terminal.
LEGAL_MOVES = {
    "": ("submitted", "working", "input-required", "completed", "canceled", "failed"),
    "submitted": ("working", "input-required", "canceled", "failed", "completed"),
    "working": ("input-required", "completed", "canceled", "failed"),
    "input-required": ("working", "canceled", "failed", "completed"),
    "completed": (),
    "canceled": (),
    "failed": (),
}
_LEGAL = [f"{a}>{b}" for a, targets in LEGAL_MOVES.items() for b in targets]
OPEN_STATES = ("working", "submitted", "input-required")
MAX_AGE = dt.timedelta(hours=2)


def legal_move(source: Column, target: Column) -> Column:
    return F.concat(source, F.lit(">"), target).isin(*_LEGAL)


def with_task_state(obs: DataFrame, chunk_seconds: float = 3600.0) -> DataFrame:
    """Add what the tracker knew before each observation and the state after it."""
    order = ["ts", "seq"]
    rows = carry_last(obs.where(F.coalesce("task_id", F.lit("")) != ""), ["task_id"], order, {
        "_state": F.when(F.col("state") != "", F.col("state")),
        "_peer": F.when(F.col("counterparty") != "", F.col("counterparty")),
    }, chunk_seconds)
    rows = carry_first(rows, ["task_id"], order, {"_fp": F.coalesce("fingerprint", F.lit(""))}, chunk_seconds)
    known = F.col("_fp").isNotNull()
    before = F.when(known, F.coalesce("_state", F.lit("submitted")))
    return rows.select(
        *obs.columns,
        known.alias("known"),
        before.alias("state_before"),
        F.when(F.col("state") != "", F.col("state")).otherwise(F.coalesce(before, F.lit("submitted")))
        .alias("state_after"),
        F.col("_peer").alias("peer_before"),
        F.col("_fp").alias("first_fingerprint"),
    )


def _transition() -> Column:
    return (F.col("known") & (F.col("state") != "") & (F.col("state") != F.col("state_before"))
            & ~legal_move(F.col("state_before"), F.col("state")))


def _drift() -> Column:
    return (F.col("known") & (F.col("fingerprint") != "") & (F.col("first_fingerprint") != "")
            & (F.col("fingerprint") != F.col("first_fingerprint")) & (F.col("state_after") != "submitted"))


def _peer_change() -> Column:
    return (F.col("known") & (F.col("counterparty") != "") & F.col("peer_before").isNotNull()
            & (F.col("counterparty") != F.col("peer_before")))


def task_transitions(obs: DataFrame) -> DataFrame:
    """Observations that move a task along an illegal edge."""
    return with_task_state(obs).where(_transition()).select(
        "task_id", "ts", "seq", F.lit("task.invalid_transition").alias("rule_id"), "state_before",
        F.col("state").alias("state_to"),
        F.concat(F.lit("invalid state transition "), "state_before", F.lit(" -> "), "state").alias("description"))


def task_scope_drift(obs: DataFrame) -> DataFrame:
    """Observations whose message differs from the first one after the task left ``submitted``."""
    return with_task_state(obs).where(_drift()).select(
        "task_id", "ts", "seq", F.lit("task.scope_drift").alias("rule_id"), "first_fingerprint", "fingerprint",
        F.lit("task message fingerprint differs from initial submission").alias("description"))


def task_peer_change(obs: DataFrame) -> DataFrame:
    return with_task_state(obs).where(_peer_change()).select(
        "task_id", "ts", "seq", F.lit("task.counterparty_changed").alias("rule_id"), "peer_before", "counterparty",
        F.concat(F.lit("task counterparty changed mid-flight (was "), "peer_before", F.lit(", now "),
                 "counterparty", F.lit(")")).alias("description"))


def task_findings(obs: DataFrame) -> DataFrame:
    """All live checks in one pass: peer change, then transition, then drift."""
    def code(test: Column, rule: str, text: Column) -> Column:
        return F.when(test, F.struct(F.lit(rule).alias("rule_id"), text.alias("description")))

    codes = F.array_compact(F.array(
        code(_peer_change(), "task.counterparty_changed",
             F.concat(F.lit("task counterparty changed mid-flight (was "), "peer_before", F.lit(", now "),
                      "counterparty", F.lit(")"))),
        code(_transition(), "task.invalid_transition",
             F.concat(F.lit("invalid state transition "), "state_before", F.lit(" -> "), "state")),
        code(_drift(), "task.scope_drift", F.lit("task message fingerprint differs from initial submission")),
    ))
    return (
        with_task_state(obs).withColumn("_codes", codes)
        .select("task_id", "ts", "seq", F.posexplode("_codes").alias("pos", "_c"))
        .select("task_id", "ts", "seq", "pos", "_c.rule_id", "_c.description")
    )


def declared_history(history: Column, responder: Column, contracted: Column) -> Column:
    """array<struct<rule_id, description>> for a self-declared history and its two parties."""
    h = F.coalesce(history, F.array().cast("array<string>"))
    skip = F.array_contains(h, "completed") & ~F.exists(h, lambda s: s.isin("working", "input-required"))
    pairs = F.when(F.size(h) > 1, F.sequence(F.lit(2), F.size(h))).otherwise(F.array().cast("array<int>"))
    bad = F.filter(pairs, lambda i: (F.get(h, i - 1) != F.get(h, i - 2))
                   & ~legal_move(F.get(h, i - 2), F.get(h, i - 1)))
    moves = F.transform(bad, lambda i: F.struct(
        F.lit("task.invalid_transition").alias("rule_id"),
        F.concat(F.lit("declared invalid state transition "), F.get(h, i - 2), F.lit(" -> "), F.get(h, i - 1))
        .alias("description")))
    one = lambda rule, text: F.array(F.struct(F.lit(rule).alias("rule_id"), text.alias("description")))
    none = F.array().cast("array<struct<rule_id:string,description:string>>")
    mismatch = (F.coalesce(responder, F.lit("")) != "") & (F.coalesce(contracted, F.lit("")) != "") & (
        responder != contracted)
    return F.concat(
        F.when(skip, one("task.state_skip", F.lit(
            "task reported completed without ever entering working (no work in between)"))).otherwise(none),
        moves,
        F.when(mismatch, one("task.counterparty_mismatch", F.concat(
            F.lit('responder "'), responder, F.lit('" is not the contracted peer "'), contracted, F.lit('"'))))
        .otherwise(none))


def declared_history_findings(results: DataFrame, block: bool = False) -> DataFrame:
    """Rows of ``msg_id, task_id, history, responder, contracted`` -> findings, in check order."""
    found = declared_history(F.col("history"), F.col("responder"), F.col("contracted"))
    return (
        results.where(F.coalesce("task_id", F.lit("")) != "")
        .select("msg_id", "task_id", F.posexplode_outer(found).alias("pos", "_c"))
        .where(F.col("_c").isNotNull())
        .select("msg_id", "task_id", "pos", "_c.rule_id", "_c.description", F.lit("high").alias("severity"),
                F.lit("block" if block else "").alias("forced_action"))
    )


def _snapshots(obs: DataFrame) -> DataFrame:
    """Created, updated and current state per task, by partial aggregation only."""
    at = F.struct("ts", "seq")
    return (
        obs.where(F.coalesce("task_id", F.lit("")) != "")
        .groupBy("task_id")
        .agg(
            F.min("ts").alias("created"),
            F.max("ts").alias("updated"),
            F.coalesce(F.max_by("state", F.when(F.col("state") != "", at)), F.lit("submitted")).alias("state"),
            F.coalesce(F.max_by("counterparty", F.when(F.col("counterparty") != "", at)), F.lit("")).alias("counterparty"),
            F.min_by("fingerprint", at).alias("first_fingerprint"),
            F.count("*").alias("observations"),
        )
    )


def long_running_tasks(obs: DataFrame, as_of: dt.datetime, max_age: dt.timedelta = MAX_AGE) -> DataFrame:
    return _snapshots(obs).where(
        F.col("state").isin(*OPEN_STATES) & (F.col("created") <= F.lit(as_of - max_age))
    ).orderBy("created", "task_id")


def task_list(obs: DataFrame, limit: int = 0) -> DataFrame:
    out = _snapshots(obs).orderBy(F.desc("updated"), F.asc("task_id"))
    return out.limit(limit) if limit > 0 else out
