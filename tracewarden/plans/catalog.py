"""Named queries over the generic test tables, one or more per operator."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.functions import ranks, text
from tracewarden.functions.patterns import glob_match
from tracewarden.operators import analytics, behavior, cards, classifier, envelope, judge, ledger as chain
from tracewarden.operators import merkle, peers, policy, quarantine, queries as lookups, rules, scoring, sensors
from tracewarden.operators import taint, tasks
from tracewarden.plans import evaluate
from tracewarden.plans.projections import ledger, messages, raw_rpc, read_table, spread
from tracewarden.session import checkpoint_dir
from tracewarden.sources import exports, retention, traffic
from tracewarden.schema import GENESIS_HASH
from tracewarden.sources.rules import default_rule_list, default_rules, rule_content_hash

DAY = dt.timedelta(days=1)
HOUR = dt.timedelta(hours=1)

POLICIES = [
    {"id": "p-org", "name": "org", "mode": "warn", "min_severity": "high"},
    {"id": "p-tenant", "name": "tenant", "mode": "monitor", "tenant_id": "tenant-1"},
    {"id": "p-cat", "name": "cat", "mode": "block", "tenant_id": "tenant-1", "categories": ["pii-leakage"]},
    {"id": "p-sensor", "name": "sensor", "mode": "block", "sensor_id": "sensor-2", "methods": ["tools/call"],
     "min_severity": "medium"},
    {"id": "p-sensor-b", "name": "sensor b", "mode": "block", "sensor_id": "sensor-2", "rule_ids": ["rule-3", "rule-4"]},
    {"id": "p-off", "name": "off", "mode": "block", "enabled": False},
]
STATES = {"purchase": "submitted", "view": "working", "click": "input-required", "signup": "completed", "error": "failed"}


def prepare(spark: SparkSession) -> None:
    """Runtime settings the queries rely on; nothing that sizes the cluster."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.icu.caseMappings.enabled", "false")


def as_of(rows: DataFrame) -> dt.datetime:
    """Latest time of the table: one aggregate, used as a literal so that window filters reach the scan."""
    micros = rows.agg(F.max(F.unix_micros("ts"))).first()[0]
    return dt.datetime.fromtimestamp(0, dt.timezone.utc) + dt.timedelta(microseconds=micros)


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def _finding_rows(led: DataFrame) -> DataFrame:
    return led.select("ts", "seq", F.explode("findings").alias("f")).select("f.rule_id", "f.category", "ts", "seq")


def _task_obs(led: DataFrame) -> DataFrame:
    return led.select(
        F.col("agent_run_id").alias("task_id"), F.col("sensor_id").alias("counterparty"),
        ranks.lookup("event_type", STATES, "").alias("state"), F.col("method").alias("fingerprint"), "ts", "seq")


def _peer_obs(led: DataFrame) -> DataFrame:
    return led.select("counterparty", F.col("n_findings").alias("findings"), "action", "severity", "ts", "seq")


def _envelopes(spark: SparkSession, d: str) -> DataFrame:
    return envelope.parse_envelope(raw_rpc(spark, d))


def _field_messages(spark: SparkSession, d: str) -> DataFrame:
    return spread(messages(spark, d))


def _cards(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "conversations")
    skill = F.struct(
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("s"), F.col("turn").cast("string"))).alias("id"),
        F.lit("").alias("name"), F.col("role").alias("description"), F.array(F.col("role"), F.lit("t")).alias("tags"))
    doc = F.struct(
        F.concat(F.lit("agent-"), F.col("conv_id").cast("string")).alias("name"), F.col("text").alias("description"),
        F.when(F.col("conv_id") % 3 == 0, F.lit("ftp://x")).otherwise(F.lit("https://x")).alias("url"),
        F.struct(F.concat(F.lit("org-"), (F.col("conv_id") % 5).cast("string")).alias("organization")).alias("provider"),
        F.when(F.col("turn") > 0, F.lit("1")).alias("version"), F.array(skill).alias("skills"),
        F.when(F.col("turn") % 3 > 0, F.lit("sig")).alias("signature"))
    return cards.parse_card(c.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("msg_id"),
        (F.col("turn") % 2 == 1).alias("signature_ok"), F.to_json(doc).alias("raw")))


def _taints(spark: SparkSession, d: str) -> DataFrame:
    b = read_table(spark, d, "benchmark")
    results = b.select(
        F.format_string("%06d", "item_id").alias("msg_id"), F.lit("run").alias("agent_run_id"),
        F.timestamp_seconds("item_id").alias("ts"), F.lit("tools/call").alias("method"), F.lit("outbound").alias("direction"),
        F.array(F.struct(F.lit("result.text").alias("name"), F.col("text").alias("value"))).alias("fields"))
    return taint.taint_tags(results)


def _suspects(spark: SparkSession, d: str) -> DataFrame:
    """Documents as peer messages sent after every item was tagged."""
    docs = spread(read_table(spark, d, "documents").select("doc_id", "text"))
    return docs.select(
        F.col("doc_id").alias("msg_id"), F.lit("run").alias("agent_run_id"), F.timestamp_seconds(F.lit(10_000_000)).alias("ts"),
        F.concat(F.lit("peer-"), (F.col("doc_id") % 5).cast("string")).alias("counterparty"),
        F.array(F.struct(F.lit("params.message.text").alias("name"), F.col("text").alias("value"))).alias("fields"))


def _unchained(spark: SparkSession, d: str) -> DataFrame:
    return ledger(spark, d).select(
        F.concat(F.lit("segment-"), chain.segment_of("seq", 500).cast("string")).alias("chain_id"), "seq",
        chain.rfc3339("ts").alias("ingest_at"),
        F.concat(F.lit('{"action":"'), "action", F.lit('","severity":"'), "severity", F.lit('"}')).alias("event_json"))


def _chained(spark: SparkSession, d: str) -> DataFrame:
    return chain.chain_ledger(_unchained(spark, d), ["chain_id"])


def _appended(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The same ledger from three appends behind saved heads, and the heads after them."""
    rows = _unchained(spark, d)
    place = (F.col("seq") - 1) % 500
    # a segment's chain starts behind the numbers of the segments before it
    heads = rows.groupBy("chain_id").agg((F.min("seq") - 1).alias("first_seq")).select(
        "chain_id", "first_seq", F.col("first_seq").alias("last_seq"), F.lit(GENESIS_HASH).alias("head_hash"))
    parts = []
    for low, high in ((0, 170), (170, 171), (171, 500)):
        new = rows.where((place >= low) & (place < high)).withColumnRenamed("seq", "source_seq")
        parts.append(chain.append_ledger(new, ["chain_id"], ["source_seq"], heads).drop("source_seq"))
        heads = chain.merged_heads(heads, parts[-1], ["chain_id"])
    return parts[0].unionByName(parts[1]).unionByName(parts[2]), heads




def _change_log(led: DataFrame) -> DataFrame:
    """Policy changes derived from peer events: the peer is the policy, the event its new version."""
    return led.where(F.col("counterparty") != "").select(
        "seq", F.when(F.col("action") == "block", "delete").when(F.col("action") == "warn", "update").otherwise("create").alias("op"),
        F.col("counterparty").alias("id"), F.concat(F.lit("n-"), "counterparty").alias("name"), (F.col("seq") % 7).alias("version"),
        (F.col("seq") % 3 != 0).alias("enabled"), F.when(F.col("seq") % 2 == 0, F.col("tenant_id")).otherwise("").alias("tenant_id"),
        F.lit("").alias("sensor_id"), F.lit("").alias("server_name"), F.col("action").alias("mode"), F.lit("ops").alias("actor"), "ts")


def _heartbeats(led: DataFrame) -> DataFrame:
    return led.select(
        "sensor_id", "tenant_id", (F.col("seq") % 5).alias("policy_version"), F.concat(F.lit("v"), (F.col("seq") % 2).cast("string")).alias("content_version"),
        F.when(F.col("seq") % 11 == 0, F.col("ts")).alias("started_at"), F.col("ts").alias("last_seen_at"), "seq")


def _events_for_policy(led: DataFrame) -> DataFrame:
    return led.withColumn("server_name", F.lit(""))


Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Query] = {}


def _scratch(spark: SparkSession) -> str:
    """A new folder for tables a query writes and reads back: shared on a cluster, a local one only where nothing is shared."""
    base = checkpoint_dir(spark)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tracewarden-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def query(name: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        CATALOG[name] = run
        return fn
    return add


# ---- filters and lookups -------------------------------------------------------------------

@query("query_events")
def _(s, d):
    return lookups.query_events(ledger(s, d), min_severity="high", category="policy", tenant="tenant-1", search="1",
                                since_seq=100, limit=None).select("seq", "agent_run_id", "severity", "action", "method")


@query("timeline")
def _(s, d):
    return lookups.timeline(ledger(s, d), "run-5", "tenant-2").select("seq", "method", "action")


@query("tenant_scope")
def _(s, d):
    led = ledger(s, d)
    read = lookups.tenant_scope(led, "tenant-2").select("seq", "tenant_id", F.lit("read").alias("side"))
    write = lookups.tenant_scope(led, "tenant-0", forced=True, write=True).select("seq", "tenant_id", F.lit("write").alias("side"))
    return read.unionByName(write)


@query("retain")
def _(s, d):
    led = ledger(s, d)
    return lookups.retain(led, as_of(led) - 10 * DAY).select("seq", "tenant_id")


@query("retain_on_disk")
def _(s, d):
    """The ledger written by day, older days deleted, read back with its chains held against the saved starts."""
    led = chain.chain_ledger(_unchained(s, d).join(ledger(s, d).select("seq", "ts", "tenant_id"), "seq"), ["chain_id"])
    path = f"{_scratch(s)}/retained"
    retention.write_by_day(led, f"{path}/ledger")
    retention.drop_before(s, f"{path}/ledger", f"{path}/starts", as_of(ledger(s, d)) - 10 * DAY, ["chain_id"])
    left = s.read.parquet(f"{path}/ledger")
    checked = retention.verify_retained(left, ["chain_id"], retention.saved_starts(s, f"{path}/starts"))
    return left.join(checked.where("ok").select("chain_id"), "chain_id").select("seq", "tenant_id")


@query("retention_summary")
def _(s, d):
    led = ledger(s, d).withColumn("prev_hash", F.sha2(F.col("seq").cast("string"), 256))
    return lookups.retention_summary(led, as_of(led) - 10 * DAY)


# ---- aggregates ----------------------------------------------------------------------------

@query("tool_risk")
def _(s, d):
    return analytics.tool_risk(ledger(s, d)).withColumn("risk_score", r6("risk_score"))


@query("agent_activity")
def _(s, d):
    return analytics.agent_activity(ledger(s, d)).withColumn("severity_score", r6("severity_score")).withColumn(
        "categories", F.array_join("categories", ","))


@query("category_counts")
def _(s, d):
    return analytics.category_counts(ledger(s, d))


@query("counterparty_risk")
def _(s, d):
    return analytics.counterparty_risk(ledger(s, d)).withColumn("risk_score", r6("risk_score"))


@query("task_concerns")
def _(s, d):
    return analytics.task_concerns(ledger(s, d), 40, ("rule-1", "rule-7")).select("counterparty", "rule_id", "seq")


@query("action_histogram")
def _(s, d):
    led = ledger(s, d)
    return analytics.action_histogram(led, as_of(led), 10 * DAY, 6 * HOUR)


@query("window_metrics")
def _(s, d):
    led = ledger(s, d)
    return analytics.window_metrics(led, as_of(led), 10 * DAY, DAY).withColumn(
        "sparkline", F.array_join(F.transform("sparkline", lambda x: x.cast("string")), ","))


@query("event_counters")
def _(s, d):
    return analytics.event_counters(ledger(s, d))


@query("policy_change_counters")
def _(s, d):
    return analytics.policy_change_counters(_change_log(ledger(s, d)))


@query("ledger_stats")
def _(s, d):
    return analytics.ledger_stats(ledger(s, d).withColumn("hash", F.sha2(F.col("seq").cast("string"), 256)))


@query("export_window")
def _(s, d):
    return analytics.export_window(ledger(s, d).where(F.col("tenant_id") == "tenant-1"))


@query("latency_quantiles")
def _(s, d):
    return analytics.latency_quantiles(ledger(s, d), [0.5, 0.9, 0.99, 0.999])


@query("taint_stats")
def _(s, d):
    led = ledger(s, d).where(F.col("method") == "tools/call")
    return taint.taint_stats(led.select("agent_run_id"))


@query("sweep_taints")
def _(s, d):
    led = ledger(s, d).where(F.col("method") == "tools/call")
    return taint.sweep_taints(led.select("agent_run_id", "seq", "ts"), as_of(led), 4 * HOUR).select("agent_run_id", "seq")


# ---- behaviour -----------------------------------------------------------------------------

@query("bucket_key")
def _(s, d):
    return ledger(s, d).select("seq", behavior.bucket_key().alias("bucket_key"))


@query("novel_peers")
def _(s, d):
    led = ledger(s, d)
    seen = led.where(F.col("counterparty").isin("peer-1", "peer-2", "peer-3")).select("counterparty").distinct()
    return behavior.novel_peers(led, as_of(led), seen, 12 * HOUR).select("rule_id", "match", "severity", "description")


@query("rate_spikes")
def _(s, d):
    led = ledger(s, d)
    return behavior.rate_spikes(led, as_of(led), 2 * DAY, 1.3, 5).select(
        "match", "recent", r6("baseline_mean").alias("baseline_mean"), r6("ratio").alias("ratio"), r6("confidence").alias("confidence"))


@query("finding_rate_spikes")
def _(s, d):
    led = ledger(s, d)
    return behavior.finding_rate_spikes(led, as_of(led), 2 * DAY, 1.05, 3).select(
        "match", r6("recent_rate").alias("recent_rate"), r6("historical_rate").alias("historical_rate"))


@query("suppress_repeats")
def _(s, d):
    return behavior.suppress_repeats(_finding_rows(ledger(s, d)), 6 * HOUR, ("rule_id", "category")).select("rule_id", "category", "seq")


@query("anomaly_events")
def _(s, d):
    led = ledger(s, d)
    now = as_of(led)
    common = ["rule_id", "match", "severity", "description", "field", "confidence", "ts"]
    found = behavior.novel_peers(led, now, None, 12 * HOUR).select(*common).unionByName(
        behavior.rate_spikes(led, now, 2 * DAY, 1.3, 5).select(*common))
    return behavior.anomaly_events(found).select(
        "protocol", "direction", "method", "action", "severity", "counterparty", "agent_run_id",
        F.col("findings")[0]["rule_id"].alias("rule_id"))


# ---- tasks and peers -----------------------------------------------------------------------

@query("task_transitions")
def _(s, d):
    return tasks.task_transitions(_task_obs(ledger(s, d))).select("task_id", "seq", "state_before", "state_to", "description")


@query("task_scope_drift")
def _(s, d):
    return tasks.task_scope_drift(_task_obs(ledger(s, d))).select("task_id", "seq", "first_fingerprint", "fingerprint")


@query("task_peer_change")
def _(s, d):
    obs = _task_obs(ledger(s, d)).withColumn(
        "counterparty", F.when(F.col("seq") % 4 == 0, "").otherwise(F.concat(F.lit("peer-"), (F.col("seq") % 3).cast("string"))))
    return tasks.task_peer_change(obs).select("task_id", "seq", "peer_before", "counterparty")


@query("declared_history_findings")
def _(s, d):
    obs = _task_obs(ledger(s, d))
    rows = obs.groupBy(F.col("task_id"), F.floor(F.col("seq") / 1000).alias("g")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "state"))), lambda x: x["state"]).alias("history")).select(
        F.concat("task_id", F.lit("#"), F.col("g").cast("string")).alias("msg_id"), "task_id", "history",
        F.when(F.col("g") % 2 == 0, "a").otherwise("b").alias("responder"), F.lit("a").alias("contracted"))
    return tasks.declared_history_findings(rows).select("msg_id", "pos", "rule_id", "description")


@query("long_running_tasks")
def _(s, d):
    led = ledger(s, d)
    return tasks.long_running_tasks(_task_obs(led), as_of(led)).select("task_id", "state", F.unix_micros("created").alias("created_us"))


@query("task_list")
def _(s, d):
    return tasks.task_list(_task_obs(ledger(s, d)), 50).select(
        "task_id", "state", "observations", "first_fingerprint", F.unix_micros("updated").alias("updated_us"))


@query("peer_risk")
def _(s, d):
    return peers.peer_risk(_peer_obs(ledger(s, d))).select("counterparty", "seq", r6("risk_score").alias("risk_score"), "alarm")


@query("peer_list")
def _(s, d):
    return peers.peer_list(peers.peer_risk(_peer_obs(ledger(s, d))), 10).select(
        "counterparty", "requests", "findings", "warnings", "blocks", r6("risk_score").alias("risk_score"), "last_severity")


# ---- quarantine, sensors, scoring ----------------------------------------------------------

def _listings(led: DataFrame) -> DataFrame:
    name = lambda k: F.concat(F.lit("tool-"), ((F.col("seq") + k) % 20).cast("string"))
    result = F.to_json(F.struct(F.array(
        F.struct(name(0).alias("name")), F.struct(name(7).alias("name"))).alias("tools")))
    found = F.transform("findings", lambda f, i: f.withField(
        "field", F.concat(F.lit("result.tools."), i.cast("string"), F.lit(".description"))))
    return led.where((F.col("method") == "tools/list") & (F.col("direction") == "outbound")).select(
        "method", "direction", result.alias("result"), found.alias("findings"), "ts")


@query("quarantine_entries")
def _(s, d):
    return quarantine.quarantine_entries(_listings(ledger(s, d))).select(
        "tool", "rule_id", "severity", F.unix_micros("added_at").alias("added_us"), F.unix_micros("expires_at").alias("expires_us"))


@query("apply_quarantine")
def _(s, d):
    led = ledger(s, d)
    entries = quarantine.quarantine_entries(_listings(led), 2 * HOUR)
    calls = led.where((F.col("method") == "tools/call") & (F.col("direction") == "inbound")).select(
        F.col("seq").alias("msg_id"), "tool", "ts")
    return quarantine.apply_quarantine(calls, entries).select(
        "msg_id", "tool", F.col("finding.severity").alias("severity"), F.col("finding.metadata")["quarantine_rule"].alias("quarantine_rule"))


@query("sensor_drift")
def _(s, d):
    led = ledger(s, d)
    return sensors.sensor_drift(_heartbeats(led), as_of(led), 3, "v1").select(
        "sensor_id", "tenant_id", "policy_version", "content_version", F.unix_micros("started_at").alias("started_us"),
        "stale_seconds", "is_stale", "policy_drift", "content_drift")


@query("score_against_labels")
def _(s, d):
    docs = spread(read_table(s, d, "documents").select("doc_id", "text", "lang"))
    m = docs.select(F.col("doc_id").alias("msg_id"), F.lit("tools/call").alias("method"), F.lit("outbound").alias("direction"),
                    F.array(F.struct(F.lit("result.text").alias("name"), F.col("text").alias("value"))).alias("fields"))
    found = rules.apply_rules(m, default_rule_list()).select(F.col("msg_id").alias("doc_id"), "category", "pos")
    samples = read_table(s, d, "labels").join(docs.select("doc_id", "lang"), "doc_id").select(
        "doc_id", F.col("lang").alias("category"), F.when(F.col("toxic") == 1, "malicious").otherwise("benign").alias("label"))
    flagged = scoring.flag_samples(samples, found.withColumnRenamed("category", "category"), "doc_id")
    return scoring.score_against_labels(flagged).select(
        "category", "tp", "fp", "fn", "tn", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"))


# ---- policies ------------------------------------------------------------------------------

@query("resolve_policy")
def _(s, d):
    out = policy.resolve_policy(_events_for_policy(ledger(s, d)), policy.policies_table(s, POLICIES), "monitor")
    return out.select("seq", "mode", F.col("matched_policy.id").alias("policy_id"))


@query("resolve_policy_joined")
def _(s, d):
    """The same answer when no list is broadcast and the events arrive shuffled."""
    out = policy.resolve_policy(_events_for_policy(ledger(s, d)).repartition("seq"), policy.policies_table(s, POLICIES), "monitor", broadcast_bytes=-1)
    return out.select("seq", "mode", F.col("matched_policy.id").alias("policy_id"))


@query("resolve_policy_by_index")
def _(s, d):
    """The same answer by the index from scopes and selectors."""
    out = policy.resolve_policy(_events_for_policy(ledger(s, d)), policy.policies_table(s, POLICIES), "monitor", plan_policies=0)
    return out.select("seq", "mode", F.col("matched_policy.id").alias("policy_id"))


def _daily_versions(led: DataFrame) -> DataFrame:
    """A policy per tenant that changes each day with what the tenant's agents did on it."""
    blocks = F.count_if(F.col("action") == "block")
    days = led.groupBy("tenant_id", F.date_trunc("DAY", "ts").alias("ts")).agg(F.count("*").alias("n"), blocks.alias("b"), F.min("seq").alias("seq"))
    return days.select(
        F.concat(F.lit("p-"), "tenant_id").alias("id"), F.when(F.col("n") % 4 == 0, "delete").otherwise("update").alias("op"), "ts", "seq", "tenant_id",
        F.col("n").alias("version"), F.lit(True).alias("enabled"), F.when(F.col("b") % 2 == 0, "high").otherwise("low").alias("min_severity"),
        F.element_at(F.array(F.lit("monitor"), F.lit("warn"), F.lit("block")), (F.col("b") % 3 + 1).cast("int")).alias("mode"))


@query("resolve_policy_at_event_time")
def _(s, d):
    led = ledger(s, d)
    events = _events_for_policy(led)
    events = events if "ts" in events.columns else events.join(led.select("seq", "ts"), "seq")
    out = policy.resolve_policy(events, policy.policy_versions(_daily_versions(led)), "none")
    return out.select("seq", "mode", F.col("matched_policy.id").alias("policy_id"), F.col("matched_policy.version").alias("version"))


@query("selector_matches")
def _(s, d):
    led = ledger(s, d)
    table = policy.policies_table(s, POLICIES[2:3])
    one = F.from_json(F.lit(table.toJSON().first()), policy._POLICY_DDL)
    return led.select("seq", policy.selector_matches(one, F.col("method"), F.col("findings")).alias("matches"))


@query("policy_preview")
def _(s, d):
    return policy.policy_preview(ledger(s, d), POLICIES[3], None)


@query("policy_snapshot")
def _(s, d):
    return policy.policy_snapshot(_change_log(ledger(s, d)), "tenant-1").select("id", "version", "mode", "tenant_id", "set_version")


@query("policy_change_events")
def _(s, d):
    return policy.policy_change_events(_change_log(ledger(s, d))).select(
        "event_id", "tenant_id", "protocol", "direction", F.col("findings")[0]["rule_id"].alias("rule_id"),
        F.col("findings")[0]["description"].alias("description"))


# ---- envelopes -----------------------------------------------------------------------------

@query("parse_envelope")
def _(s, d):
    broken = F.when(F.col("ts") % 7 == 0, F.lit("")).when(F.col("ts") % 7 == 1, F.lit("not json")).when(
        F.col("ts") % 7 == 2, F.lit('{"jsonrpc":"1.0","id":"x"}')).otherwise(F.col("raw"))
    rows = raw_rpc(s, d).withColumn("ts", F.unix_seconds("ts")).withColumn("raw", broken)
    return envelope.parse_envelope(rows).select("msg_id", "status", "reason", "id", "method")


@query("explode_batch")
def _(s, d):
    rows = raw_rpc(s, d).groupBy("agent_run_id").agg(F.concat(
        F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "raw"))), lambda x: x["raw"]), ","), F.lit("]")).alias("raw"))
    singles = raw_rpc(s, d).where(F.col("direction") == "outbound").select(F.col("msg_id").alias("agent_run_id"), "raw")
    out = envelope.explode_batch(rows.unionByName(singles))
    return envelope.parse_envelope(out).select("agent_run_id", "is_batch", "batch_pos", "method", "id")


@query("message_kind")
def _(s, d):
    return _envelopes(s, d).select("msg_id", envelope.message_kind().alias("kind"))


@query("extract_fields")
def _(s, d):
    return envelope.extract_fields(_envelopes(s, d)).select("msg_id", F.posexplode("fields").alias("pos", "f")).select(
        "msg_id", "pos", "f.name", "f.value")


@query("tool_name")
def _(s, d):
    return ledger(s, d).select("seq", envelope.tool_name("params").alias("tool"))


@query("server_name")
def _(s, d):
    led = ledger(s, d).withColumn("source", F.when(F.col("seq") % 3 == 0, "").otherwise(F.col("sensor_id"))).withColumn(
        "destination", F.when(F.col("seq") % 4 == 0, "").otherwise(F.col("tenant_id")))
    return led.select("seq", envelope.server_name("live").alias("live"), envelope.server_name("preview").alias("preview"))


@query("block_reason")
def _(s, d):
    return ledger(s, d).select("seq", envelope.block_reason("findings").alias("reason"))


@query("task_signals")
def _(s, d):
    return envelope.task_signals(_envelopes(s, d)).select("msg_id", "task_id", "fingerprint", "state")


@query("stamp_method")
def _(s, d):
    return envelope.stamp_method(_envelopes(s, d)).select("msg_id", "method")


@query("malformed_findings")
def _(s, d):
    rows = raw_rpc(s, d).withColumn("raw", F.when(F.length("msg_id") % 2 == 0, F.lit("{oops")).otherwise(F.col("raw")))
    return envelope.malformed_findings(envelope.parse_envelope(rows), max_bytes=200).select(
        "msg_id", "action", "severity", F.col("finding.rule_id").alias("rule_id"))


@query("sse_events")
def _(s, d):
    talk = read_table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))),
        lambda x: F.concat(F.lit("event: m\ndata: "), x["role"], F.lit("\ndata: "), F.replace(x["text"], F.lit("\n"), F.lit("\ndata: ")), F.lit("\n\n: ping\n\n"))), "").alias("body"))
    return traffic.sse_events(talk).select("conv_id", "event_pos", F.sha2("raw", 256).alias("raw_sha256"))


# ---- text ----------------------------------------------------------------------------------

@query("normalize_text")
def _(s, d):
    docs = spread(read_table(s, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.sha2(text.normalize_text(F.concat(F.col("text"), F.lit("​x⁦"))), 256).alias("norm_hash"))


@query("base64_candidates")
def _(s, d):
    docs = spread(read_table(s, d, "documents").select("doc_id", "text"))
    wrapped = F.concat(F.lit("see "), F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\s", ""), F.lit(" and "), F.col("doc_id").cast("string"))
    found = docs.select("doc_id", F.explode_outer(text.base64_candidates(wrapped)).alias("decoded"))
    return found.select("doc_id", F.sha2("decoded", 256).alias("decoded_sha256"))


@query("base64_runs")
def _(s, d):
    docs = spread(read_table(s, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.explode(text.base64_runs(F.col("text"))).alias("run"))


@query("glob_match")
def _(s, d):
    paths = F.concat(F.lit("result."), "method", F.lit("."), F.col("tool"))
    led = ledger(s, d).select("seq", F.regexp_replace(paths, "/", ".").alias("path"))
    return led.select("seq", glob_match("result.*.call.**", F.col("path")).alias("a"), glob_match("result.**.tool-3", F.col("path")).alias("b"),
                      glob_match("result.tasks.*", F.col("path")).alias("c"), glob_match("result.**", F.col("path")).alias("d"))


@query("truncate_bytes")
def _(s, d):
    return read_table(s, d, "events").select("event_id", text.truncate_bytes(F.col("props"), 6).alias("cut"))


@query("severity_weights")
def _(s, d):
    return ledger(s, d).select(
        "seq", ranks.severity_rank("severity").alias("srank"), ranks.mode_rank(ranks.lookup("action", {"block": "block", "warn": "warn"}, "monitor")).alias("mrank"),
        ranks.severity_weight("severity").alias("sweight"), ranks.peer_weight("severity", "action").alias("pweight"))


@query("highest_severity")
def _(s, d):
    led = ledger(s, d)
    return led.select("seq", rules.highest_severity("findings").alias("severity"),
                      rules.highest_mode("findings", [{"id": "rule-1", "mode": "warn"}, {"id": "rule-5", "mode": "block"}]).alias("mode"))


# ---- detection -----------------------------------------------------------------------------

@query("apply_rules")
def _(s, d):
    found = rules.apply_rules(_field_messages(s, d), default_rule_list())
    return found.where(F.col("metadata")["encoding"].isNull()).select("msg_id", "rule_id", "category", "severity", "field", "match", "confidence")


@query("apply_rules_by_table")
def _(s, d):
    found = rules.apply_rules(_field_messages(s, d), default_rule_list(), plan_rules=0)
    return found.where(F.col("metadata")["encoding"].isNull()).select("msg_id", "rule_id", "category", "severity", "field", "match", "confidence")


@query("rule_scope_by_table")
def _(s, d):
    return rules.rule_scope(messages(s, d), default_rule_list(), plan_rules=0)


@query("apply_rules_base64")
def _(s, d):
    docs = spread(read_table(s, d, "documents").select("doc_id", "text"))
    hidden = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\s", "")
    m = docs.select(F.col("doc_id").alias("msg_id"), F.lit("tools/call").alias("method"), F.lit("outbound").alias("direction"),
                    F.array(F.struct(F.lit("result.text").alias("name"), F.concat(F.lit("see "), hidden).alias("value"))).alias("fields"))
    found = rules.apply_rules(m, default_rule_list()).select("msg_id", "rule_id", "match", F.col("metadata")["encoding"].alias("encoding"))
    return found.where("encoding = 'base64'")


@query("rule_scope")
def _(s, d):
    return rules.rule_scope(messages(s, d), default_rule_list())


@query("classifier_features")
def _(s, d):
    m = _field_messages(s, d).select("msg_id", F.col("fields")[0]["value"].alias("value"))
    f = m.select("msg_id", classifier.classifier_features("value").alias("f"))
    return f.select("msg_id", *[r6(F.col(f"f.{n}")).alias(n) for n in classifier.FEATURES])


@query("classify")
def _(s, d):
    return classifier.classify(_field_messages(s, d), threshold=0.3).select(
        "msg_id", "rule_id", "severity", r6("confidence").alias("confidence"), F.col("metadata")["contributors"].alias("contributors"))


@query("judge_candidates")
def _(s, d):
    m = _field_messages(s, d)
    rows = classifier.classify_fields(m, threshold=0.3, out="findings")
    return judge.judge_candidates(rows).select("msg_id", "field", F.sha2("content", 256).alias("content_sha256"))


@query("apply_judge_verdicts")
def _(s, d):
    m = messages(s, d).withColumn("findings", F.array().cast("array<struct<category:string,confidence:double>>"))
    candidates = judge.judge_candidates(m)
    c = F.length("msg_id") % 4
    answer = (F.when(c == 0, F.lit('```json\n{"verdict":"malicious","confidence":0.9,"rationale":"r"}\n```'))
              .when(c == 1, F.lit('{"verdict":"benign","confidence":0.9}'))
              .when(c == 2, F.lit('{"verdict":"malicious","category":"tool-poisoning","confidence":0.5}')))
    verdicts = candidates.select("msg_id", answer.alias("content"), F.when(c == 3, F.lit("timeout")).alias("error"))
    return judge.apply_judge_verdicts(candidates, verdicts).select("msg_id", "rule_id", "category", "severity", "field", "confidence")


# ---- cards ---------------------------------------------------------------------------------

@query("extract_card_fields")
def _(s, d):
    return cards.extract_card_fields(_cards(s, d)).select("msg_id", F.posexplode("fields").alias("pos", "f")).select(
        "msg_id", "pos", "f.name", F.length("f.value").alias("n"))


@query("validate_card")
def _(s, d):
    return cards.validate_card(_cards(s, d)).select("msg_id", F.array_join("errors", ";").alias("errors"), F.array_join("warnings", ";").alias("warnings"), "signature_present")


@query("card_trust")
def _(s, d):
    store = s.range(3).select(F.concat(F.lit("org-"), F.col("id").cast("string")).alias("issuer"))
    return cards.card_trust(cards.validate_card(_cards(s, d)), store).select(
        "msg_id", F.col("trust_finding.rule_id").alias("rule_id"), F.col("trust_finding.description").alias("description"))


# ---- lineage -------------------------------------------------------------------------------

@query("shingles")
def _(s, d):
    b = spread(read_table(s, d, "benchmark").select("item_id", "text"))
    return b.select("item_id", F.explode(text.shingles("text")).alias("fp"))


@query("taint_tags")
def _(s, d):
    return taint.numbered(_taints(s, d)).select("taint_id", "taint_no", "field", F.sha2("sample", 256).alias("sample_sha256"))


@query("taint_leaks")
def _(s, d):
    return taint.taint_leaks(_suspects(s, d), _taints(s, d), ["peer-4"]).select("msg_id", "counterparty", "taint_id", "action")


@query("taint_leaks_by_source")
def _(s, d):
    """Runs are document sources and times come from the rows: an item is tagged in one run, and reaches documents sent later there."""
    items = _taints(s, d).withColumn("agent_run_id", F.concat(F.lit("src"), (F.substring("taint_id", 3, 6).cast("int") % 20).cast("string")))
    sent = read_table(s, d, "documents").select(
        F.col("doc_id").alias("msg_id"), F.col("source").alias("agent_run_id"), F.timestamp_seconds("doc_id").alias("ts"), F.lit("peer-1").alias("counterparty"),
        F.array(F.struct(F.lit("params.message.text").alias("name"), F.col("text").alias("value"))).alias("fields"))
    return taint.taint_leaks(sent, items).select("msg_id", "agent_run_id", "taint_id", "action")


_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)), "".join(chr(c) for c in range(0x21, 0x7F))


@query("taint_leaks_disguised")
def _(s, d):
    """Document texts sent as base64 (even ids) or in full-width letters (odd ids) leak what the plain texts leak."""
    plain = _suspects(s, d)
    text_of = F.col("fields")[0]["value"]
    hidden = F.when(F.col("msg_id") % 2 == 0, F.concat(F.lit("see "), F.base64(F.encode(text_of, "UTF-8")), F.lit(" end"))).otherwise(
        F.translate(text_of, _WIDE[1], _WIDE[0]))
    hidden = F.regexp_replace(hidden, r"\r\n", "")
    sent = plain.withColumn("fields", F.array(F.struct(F.lit("params.message.text").alias("name"), hidden.alias("value"))))
    return taint.taint_leaks(sent, _taints(s, d)).select("msg_id", "taint_id", "action")


@query("match_fingerprints")
def _(s, d):
    m = _suspects(s, d).select("msg_id", "agent_run_id", "ts", F.array(text.shingles(F.col("fields")[0]["value"])).alias("fingerprints"))
    return taint.match_fingerprints(m, taint.register_fingerprints(_taints(s, d))).select("msg_id", "taint_id")


# ---- evaluation ----------------------------------------------------------------------------

def _policies(s: SparkSession) -> DataFrame:
    return policy.policies_table(s, [
        {"id": "p1", "name": "cards", "mode": "block", "rule_ids": ["pl.core.credit_card"]},
        {"id": "p2", "name": "inbound", "mode": "monitor", "tenant_id": "t1"}])


def _scoped(m: DataFrame) -> DataFrame:
    return m.select("*", F.lit("t0").alias("tenant_id"), F.lit("s0").alias("sensor_id"), F.lit("src").alias("source"), F.lit("dst").alias("destination"))


@query("evaluate_mcp")
def _(s, d):
    """Rules, classifier, quarantine and policies together; user turns call a tool, some of which are in quarantine."""
    turn = F.regexp_extract("msg_id", "^c[0-9]+-([0-9]+)$", 1).cast("int")
    calls = (F.col("method") == "tasks/send") & turn.isNotNull()
    rows = _field_messages(s, d).withColumn("ts", F.timestamp_seconds(F.coalesce(turn, F.lit(0)) * 3600)).withColumn(
        "params", F.when(calls, F.concat(F.lit('{"name":"tool-'), (turn % 3).cast("string"), F.lit('"}')))).withColumn(
        "method", F.when(calls, "tools/call").otherwise(F.col("method")))
    entry = lambda tool, added, expires: s.range(1).select(
        F.lit(tool).alias("tool"), F.lit("listed").alias("reason"), F.lit("r").alias("rule_id"), F.lit("high").alias("severity"),
        F.timestamp_seconds(F.lit(added)).alias("added_at"), F.timestamp_seconds(F.lit(expires)).alias("expires_at"), F.lit(0).alias("pos"))
    kept = entry("tool-0", 1800, 14400).unionByName(entry("tool-2", 5400, None))
    out = evaluate.evaluate_mcp(_scoped(rows), default_rule_list(), _policies(s), kept)
    return out.where(F.size("findings") > 0).select(
        "msg_id", "action", "severity", F.array_join(F.transform("findings", lambda f: f["rule_id"]), "|").alias("rule_ids"))


@query("evaluate_a2a")
def _(s, d):
    m = envelope.extract_fields(envelope.stamp_method(_envelopes(s, d)).withColumn("counterparty", F.lit("peer-1")))
    out = evaluate.evaluate_a2a(_scoped(m.drop("request_params")), default_rule_list(), None, track_peers=False)
    return out.select("msg_id", "action", "severity", F.array_join(F.transform("findings", lambda f: f["rule_id"]), "|").alias("rule_ids"))


@query("evaluate_a2a_full")
def _(s, d):
    """All stages at once: rules, classifier, policies, task state, lineage with an allow-list, and peer scores."""
    rpc = _envelopes(s, d).withColumn("counterparty", F.concat(F.lit("peer-"), (F.floor(F.unix_seconds("ts") / 100) % 5).cast("string")))
    m = envelope.extract_fields(envelope.stamp_method(rpc))
    turns = read_table(s, d, "conversations").where((F.col("role") == "user") & (F.col("turn") % 4 == 2))
    # what these turns say had come out of a tool in the same run, a second before
    tagged = taint.taint_tags(turns.select(
        F.concat(F.lit("t"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("msg_id"),
        F.concat(F.lit("run-"), F.col("conv_id").cast("string")).alias("agent_run_id"),
        F.timestamp_seconds(F.col("conv_id") * 100 + F.col("turn") - 1).alias("ts"), F.lit("tools/call").alias("method"), F.lit("outbound").alias("direction"),
        F.array(F.struct(F.lit("result.text").alias("name"), F.col("text").alias("value"))).alias("fields")))
    listed = policy.policies_table(s, [
        {"id": "q1", "name": "requests", "mode": "warn", "sensor_id": "s0", "methods": ["tasks/send"]},
        {"id": "q2", "name": "notices", "mode": "block", "tenant_id": "t0", "methods": ["notifications/message"]}])
    out = evaluate.evaluate_a2a(_scoped(m.drop("request_params")), default_rule_list(), listed, tagged, ["peer-4"])
    return out.select("msg_id", "action", "severity", F.array_join(F.transform("findings", lambda f: f["rule_id"]), "|").alias("rule_ids"))


@query("evaluate_cards")
def _(s, d):
    store = s.range(3).select(F.concat(F.lit("org-"), F.col("id").cast("string")).alias("issuer"))
    out = evaluate.evaluate_cards(_cards(s, d), default_rule_list(), store)
    return out.select("msg_id", "action", "delivered", "severity")


# ---- integrity and exports -----------------------------------------------------------------

@query("chain_ledger")
def _(s, d):
    return _chained(s, d).select("chain_id", "seq", "prev_hash", "hash")


@query("verify_chain")
def _(s, d):
    led = _chained(s, d)
    edited = led.withColumn("event_json", F.when(
        F.col("seq") % 997 == 0, F.concat("event_json", F.lit(" "))).otherwise(F.col("event_json")))
    return chain.verify_chain(edited, ["chain_id"])


@query("append_ledger")
def _(s, d):
    return _appended(s, d)[0].select("chain_id", "seq", "prev_hash", "hash")


@query("verify_saved_heads")
def _(s, d):
    led, heads = _appended(s, d)
    last = led.groupBy("chain_id").agg(F.max("seq").alias("last"))
    short = led.join(last, "chain_id").where(~F.col("chain_id").endswith("1") | (F.col("seq") <= F.col("last") - 3)).drop("last")
    return chain.verify_chain(short, ["chain_id"], saved_heads=heads)


@query("canonical_records")
def _(s, d):
    return chain.canonical_records(_chained(s, d)).select("chain_id", "seq", "leaf_hash")


def _leaves(s: SparkSession, d: str) -> DataFrame:
    led = ledger(s, d).select("seq", F.sha2(F.concat("action", F.lit(":"), F.col("seq").cast("string")), 256).alias("hash"))
    return chain.dense_index(led).select("idx", "hash")


@query("merkle_root")
def _(s, d):
    return merkle.merkle_root(_leaves(s, d))


@query("merkle_proof")
def _(s, d):
    leaves = _leaves(s, d)
    root = merkle.merkle_root(leaves).first()["merkle_root"]
    proofs = merkle.verify_proofs(merkle.merkle_proof(leaves), root)
    return proofs.select("idx", "leaf", "valid")


@query("export_csv")
def _(s, d):
    led = ledger(s, d).withColumn("ingest_at", chain.rfc3339("ts")).withColumn("event_id", F.concat(F.lit("ev-"), F.col("seq").cast("string")))
    return exports.csv_view(led)


@query("siem_payloads")
def _(s, d):
    led = ledger(s, d).select("seq", "ts", "severity", "action", "agent_run_id")
    hec = exports.siem_payloads(led, "high", "hec", index="main").select(
        "seq", F.get_json_object("body", "$.time").cast("bigint").alias("time"), F.get_json_object("body", "$.event.action").alias("action"))
    return hec


@query("verify_payloads")
def _(s, d):
    led = ledger(s, d).select("seq", "ts", "severity", "raw")
    signed = led.select("seq", F.col("raw").alias("body"), F.concat(F.lit("sha256="), exports.hmac_sha256(F.col("raw"), "k1")).alias("signature"))
    tampered = signed.withColumn("body", F.when(F.col("seq") % 10 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return exports.verify_payloads(tampered, "k1").select("seq", "verified", "signature")


@query("rule_content_hash")
def _(s, d):
    """All rules, with the number of fields each one looks at."""
    table = rule_content_hash(default_rules(s)).select("id", "content_hash")
    found = rules.rule_scope(messages(s, d), default_rule_list()).groupBy(F.col("rule_id").alias("id")).agg(F.count("*").alias("n"))
    return table.join(found, "id", "left").select("id", "content_hash", F.coalesce("n", F.lit(0)).alias("fields_in_scope"))
