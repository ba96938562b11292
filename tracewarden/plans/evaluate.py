"""Message evaluation: detectors, correlation, policy, decision.

Detection, mode and policy are row-local. Only correlation (quarantine, lineage, task state, peer
risk) looks at other rows; each of those works on slim key columns and is joined back by message id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.ranks import action_of_mode, computed_once, severity_rank
from tracewarden.operators.cards import card_trust, extract_card_fields, validate_card
from tracewarden.operators.classifier import classify_fields
from tracewarden.operators.envelope import TASK_METHODS, block_reason, server_name, task_signals, tool_name
from tracewarden.operators.peers import peer_alarms, peer_risk
from tracewarden.operators.policy import match_annotation, resolve_policy
from tracewarden.operators.quarantine import apply_quarantine
from tracewarden.operators.rules import detect_rules, highest_mode, highest_severity
from tracewarden.operators.taint import taint_leaks
from tracewarden.operators.tasks import declared_history, task_findings
from tracewarden.schema import FINDING
from tracewarden.sources.rules import collect_rules

_DETECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {}
_FINDINGS = f"array<{FINDING.simpleString()}>"


def register_detector(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """Add a detector: a function from messages to the same rows with an array column ``name``."""
    _DETECTORS[name] = fn


def unregister_detector(name: str) -> None:
    _DETECTORS.pop(name, None)


def _none() -> Column:
    return F.array().cast(_FINDINGS)


def detect(messages: DataFrame, rules: list[dict], classifier: bool = True) -> DataFrame:
    """Add ``findings`` from rules, classifier and registered detectors, in that order."""
    parts = ["_rules"]
    out = detect_rules(messages, rules, out="_rules")
    if classifier:
        out = classify_fields(out, out="_classifier")
        parts.append("_classifier")
    for name, fn in _DETECTORS.items():
        out = fn(out)
        parts.append(name)
    merged = F.concat(*[F.coalesce(F.col(p).cast(_FINDINGS), _none()) for p in parts])
    return out.withColumn("findings", computed_once(merged)).drop(*parts)


def _decide(messages: DataFrame, rules: list[dict], policies: DataFrame | None) -> DataFrame:
    out = messages.withColumn("server_name", server_name()).withColumn("_default", highest_mode("findings", rules))
    if policies is None:
        out = out.withColumn("mode", F.col("_default")).withColumn(
            "matched_policy", F.lit(None).cast("struct<id:string,version:bigint,mode:string,tenant_id:string,sensor_id:string,server_name:string>"))
    else:
        out = resolve_policy(out, policies, "_default")
    return out.withColumn("action", action_of_mode("mode")).drop("_default")


def _annotate(df: DataFrame) -> DataFrame:
    noted = F.when(F.col("matched_policy").isNotNull(), F.array(match_annotation(F.col("matched_policy")).cast(FINDING)))
    return df.withColumn("findings", F.concat("findings", F.coalesce(noted, _none())))


def _blocked(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumn("block_reason", F.when(F.col("action") == "block", block_reason("findings", prefix)))


def evaluate_mcp(messages: DataFrame, rules: DataFrame | list[dict], policies: DataFrame | None = None,
                 quarantine: DataFrame | None = None, classifier: bool = True, reason_prefix: str = "blocked") -> DataFrame:
    """Decide tool-protocol messages (``msg_id, ts, direction, method, params, fields`` and scope columns).

    A call to a quarantined tool is blocked whatever the policies say.
    """
    rules = collect_rules(rules)
    out = detect(messages, rules, classifier)
    if quarantine is not None:
        calls = messages.where((F.col("method") == "tools/call") & (F.col("direction") == "inbound")).select(
            "msg_id", tool_name("params").alias("tool"), "ts")
        hits = apply_quarantine(calls, quarantine).select("msg_id", F.col("finding").alias("_q"))
        out = out.join(hits, "msg_id", "left").withColumn(
            "findings", F.concat("findings", F.coalesce(F.when(F.col("_q").isNotNull(), F.array("_q")), _none())))
    out = _decide(out, rules, policies)
    if quarantine is not None:
        out = out.withColumn("action", F.when(F.col("_q").isNotNull(), "block").otherwise(F.col("action"))).drop("_q")
    out = out.withColumn("severity", highest_severity("findings"))
    return _annotate(_blocked(out, reason_prefix))


def _raise_to_high(df: DataFrame, test: Column) -> DataFrame:
    low = severity_rank("severity") < 3
    return df.withColumn("severity", F.when(test & low, "high").otherwise(F.col("severity")))


def _task_rows(messages: DataFrame) -> DataFrame:
    """Task observations: requests of the task methods, and responses that carry a state."""
    s = task_signals(messages)
    inbound = (F.col("direction") == "inbound") & F.col("method").isin(*TASK_METHODS)
    outbound = (F.col("direction") == "outbound") & (F.col("state") != "")
    state = F.when(inbound & (F.col("method") == "tasks/cancel"), "canceled").when(inbound, "").otherwise(F.col("state"))
    return s.where((F.col("task_id") != "") & (inbound | outbound)).select(
        "task_id", F.lit("").alias("counterparty"), state.alias("state"),
        F.when(inbound, F.col("fingerprint")).otherwise("").alias("fingerprint"), "ts", F.col("msg_id").alias("seq"))


def _policy_finding(rule: Column, text: Column, field: Column, match: Column, confidence: float) -> Column:
    return F.struct(
        rule.alias("rule_id"), F.lit("policy").alias("category"), F.lit("high").alias("severity"), text.alias("description"),
        match.alias("match"), field.alias("field"), F.lit(confidence).alias("confidence"),
        F.create_map().cast("map<string,string>").alias("metadata")).cast(FINDING)


def evaluate_a2a(messages: DataFrame, rules: DataFrame | list[dict], policies: DataFrame | None = None,
                 taints: DataFrame | None = None, allowed_peers: list[str] | DataFrame | None = None,
                 track_tasks: bool = True, track_peers: bool = True, block_drift: bool = False,
                 classifier: bool = True, reason_prefix: str = "blocked") -> DataFrame:
    """Decide peer-protocol messages: detection and policy, then task state, lineage and peer risk."""
    rules = collect_rules(rules)
    out = detect(messages, rules, classifier)
    out = _decide(out, rules, policies)
    out = out.withColumn("severity", highest_severity("findings"))
    out = _annotate(_blocked(out, reason_prefix))

    if track_tasks:
        signals = task_signals(messages)
        field = F.when(F.col("direction") == "inbound", "params.id").otherwise("result.id")
        live = task_findings(_task_rows(messages)).select(
            F.col("seq").alias("msg_id"), "pos", "rule_id", "description")
        declared = signals.where((F.col("direction") == "outbound") & (F.col("task_id") != "")).select(
            "msg_id", F.posexplode_outer(declared_history(F.col("history"), F.col("responder"), F.col("contracted"))).alias("pos", "_c")
        ).where(F.col("_c").isNotNull()).select("msg_id", (F.col("pos") + 100).alias("pos"), "_c.rule_id", "_c.description")
        ids = signals.select("msg_id", "task_id", field.alias("_field"))
        per_message = (
            live.unionByName(declared).join(ids, "msg_id")
            .groupBy("msg_id").agg(F.array_sort(F.collect_list(F.struct("pos", "rule_id", "description", "task_id", "_field"))).alias("_t"))
            .select("msg_id", F.transform("_t", lambda t: _policy_finding(
                t["rule_id"], t["description"], t["_field"], t["task_id"], 0.9)).alias("_task"))
        )
        out = out.join(per_message, "msg_id", "left")
        drifted = F.col("_task").isNotNull()
        out = _raise_to_high(out, drifted).withColumn("findings", F.concat("findings", F.coalesce("_task", _none())))
        if block_drift:
            outbound = drifted & (F.col("direction") == "outbound")
            out = out.withColumn("action", F.when(outbound, "block").otherwise(F.col("action"))).withColumn(
                "block_reason", F.coalesce("block_reason", F.when(outbound, F.lit("blocked: A2A task drift"))))
        out = out.drop("_task")

    if taints is not None:
        inbound = messages.where(F.col("direction") == "inbound")
        leaks = taint_leaks(inbound, taints, allowed_peers).select("msg_id", F.col("finding").alias("_leak"))
        leaked = F.col("_leak").isNotNull()
        out = out.join(leaks, "msg_id", "left")
        out = (
            out.withColumn("findings", F.concat("findings", F.coalesce(F.when(leaked, F.array("_leak")), _none())))
            .withColumn("action", F.when(leaked, "block").otherwise(F.col("action")))
            .withColumn("severity", F.when(leaked, "high").otherwise(F.col("severity")))
            .withColumn("block_reason", F.coalesce("block_reason", F.when(leaked, F.lit("blocked: cross-protocol taint leak"))))
            .drop("_leak"))

    if track_peers:
        # scores of peers and their alarms read every decision again: what is decided so far is kept, or each reader would detect anew
        out = out.persist(StorageLevel.DISK_ONLY)
        seen = out.select("counterparty", F.size("findings").alias("findings"), "action", "severity", "ts", F.col("msg_id").alias("seq"))
        alarms = peer_alarms(peer_risk(seen)).select(
            F.col("seq").alias("msg_id"), _policy_finding(
                F.col("rule_id"), F.col("description"), F.lit("counterparty"), F.col("counterparty"), 0.95).alias("_alarm"))
        out = out.join(alarms, "msg_id", "left").withColumn("findings", F.concat(
            "findings", F.coalesce(F.when(F.col("_alarm").isNotNull(), F.array("_alarm")), _none()))).drop("_alarm")
    return out


def evaluate_cards(cards: DataFrame, rules: DataFrame | list[dict], trust_store: DataFrame | None = None,
                   classifier: bool = True) -> DataFrame:
    """Decide agent cards (output of ``parse_card``): findings, checks, trust, action, delivery."""
    rules = collect_rules(rules)
    rows = validate_card(extract_card_fields(cards))
    rows = rows.withColumn("method", F.lit("agent.card")).withColumn("direction", F.lit("outbound"))
    out = detect(rows, rules, classifier)
    if trust_store is not None:
        out = card_trust(out, trust_store).withColumn("findings", F.concat("findings", F.array("trust_finding")))
    invalid = F.exists("findings", lambda f: f["rule_id"] == "card.signature_invalid")
    broken = F.size("errors") > 0
    return (
        out.withColumn("severity", highest_severity("findings"))
        .withColumn("action", F.when(broken | invalid, "block").otherwise("allow"))
        .withColumn("delivered", ~(broken | F.col("severity").isin("high", "critical")))
    )
