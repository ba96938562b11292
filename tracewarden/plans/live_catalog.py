"""Queries for readers, writers and live operators: rows of the given tables are written, read back or streamed, and come out whole.

Streams run twice behind one checkpoint: the earlier half of the rows is taken in, the stream stops, the later half arrives, and the stream goes
on from its state. Nothing is late that way, so the answer is the batch operator's.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.operators import analytics, rollups
from tracewarden.plans import evaluate
from tracewarden.plans.catalog import DAY, HOUR, _chained, _finding_rows, _listings, _scratch, _task_obs, as_of, query, r6
from tracewarden.plans.projections import ledger, raw_rpc, read_table, spread
from tracewarden.schema import TRAFFIC
from tracewarden.sources import exports, traffic
from tracewarden.sources import ledger as ledger_files
from tracewarden.sources.rules import default_rule_list
from tracewarden.streaming import live

# Fixed value: the time stamp of exports made by queries.
EXPORTED_AT = "2024-01-01T00:00:00Z"


def _halves(rows: DataFrame) -> list[DataFrame]:
    """Rows before the middle of the covered time (those without a time among them), and the rest."""
    low, high = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    if low is None:
        return [rows]
    early = F.coalesce(F.unix_micros("ts") < (low + high) // 2, F.lit(True))
    return [rows.where(early), rows.where(~early)]


def _streamed(rows: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``build`` of a stream over ``rows`` puts out, with a stop and a restart between the halves."""
    spark = rows.sparkSession
    base = f"{_scratch(spark)}/live"
    for half in _halves(rows):
        half.write.mode("append").parquet(f"{base}/in")
        out = build(spark.readStream.schema(rows.schema).parquet(f"{base}/in"))
        out.writeStream.foreachBatch(live.batch_writer(f"{base}/out", lambda batch: batch)).option(
            "checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch_id")


# ---- readers and exports -------------------------------------------------------------------

@query("read_traffic")
def _(s: SparkSession, d: str) -> DataFrame:
    """Conversation turns as captured messages: written as JSON and Parquet, each half read by its reader."""
    rows = raw_rpc(s, d).select("msg_id", "agent_run_id", "ts", "direction").join(
        read_table(s, d, "conversations").select(
            F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("msg_id"), F.col("text").alias("raw")), "msg_id")
    full = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TRAFFIC])
    path = f"{_scratch(s)}/traffic"
    out = None
    for form, part in (("json", F.col("direction") == "inbound"), ("parquet", F.col("direction") != "inbound")):
        full.where(part).write.format(form).save(f"{path}/{form}")
        read = traffic.read_traffic(s, f"{path}/{form}", form)
        out = read if out is None else out.unionByName(read)
    return out.select("msg_id", "agent_run_id", F.unix_micros("ts").alias("ts_us"), "direction", F.sha2("raw", 256).alias("raw_sha256"))


@query("read_ledger")
def _(s, d):
    path = f"{_scratch(s)}/ledger"
    ledger_files.write_ledger(_chained(s, d), path)
    return ledger_files.read_ledger(s, path).select("seq", "ingest_at", "prev_hash", "hash", "event_json")


@query("export_ndjson")
def _(s, d):
    """High findings of one tenant as text lines, read back with their proof line."""
    led = ledger(s, d).withColumn("hash", F.sha2(F.col("seq").cast("string"), 256))
    head = analytics.ledger_stats(led).first()["head_hash"] or ""
    path = f"{_scratch(s)}/export"
    exports.export_ndjson(led, head, EXPORTED_AT, tenant="tenant-1", min_severity="high").write.text(path)
    line = F.from_json("value", "_type string, seq bigint, action string, raw string, findings array<struct<rule_id:string>>, record_count bigint, "
                                "seq_range array<bigint>, head_hash string")
    return s.read.text(path).select(line.alias("r")).select(
        F.coalesce("r._type", F.lit("record")).alias("kind"), "r.seq", "r.action", F.sha2("r.raw", 256).alias("raw_sha256"),
        F.array_join(F.transform("r.findings", lambda f: f["rule_id"]), "|").alias("rule_ids"), "r.record_count",
        F.get("r.seq_range", F.lit(0)).alias("seq_lo"), F.get("r.seq_range", F.lit(1)).alias("seq_hi"), "r.head_hash")


@query("audit_bundle")
def _(s, d):
    path = f"{_scratch(s)}/bundle"
    exports.audit_bundle(_chained(s, d), path, "head", EXPORTED_AT)
    written = s.read.json(f"{path}/manifest")
    return written.select("tenant", "chain_head", "merkle_root", F.col("record_count").cast("bigint").alias("record_count"))


@query("rollup_report")
def _(s, d):
    """Hourly rollups of two stretches of the ledger, written, merged and added up per tenant over ten days."""
    led = ledger(s, d)
    path = f"{_scratch(s)}/rollups"
    for half in _halves(led):
        rollups.rollup(half, HOUR).write.mode("append").parquet(path)
    merged = rollups.merge_rollups(s.read.parquet(path))
    return rollups.rollup_report(merged, as_of(led) - 10 * DAY, ("tenant_id",)).select("tenant_id", "total", "allowed", "warned", "blocked", "findings")


# ---- streams -------------------------------------------------------------------------------

@query("stream_feed")
def _(s, d):
    """The ledger behind record 100, from files that two writers left."""
    base = f"{_scratch(s)}/feed"
    rows = ledger(s, d).select("seq", "ts", "tenant_id", "action", "severity", "raw")
    for half in _halves(rows):
        half.write.mode("append").parquet(f"{base}/in")
    feed = live.stream_feed(s, f"{base}/in", rows.schema, since_seq=100, format="parquet")
    feed.writeStream.foreachBatch(live.batch_writer(f"{base}/out", lambda batch: batch)).option(
        "checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{base}/out").select("seq", F.unix_micros("ts").alias("ts_us"), "action", "raw")


@query("stream_siem")
def _(s, d):
    base = f"{_scratch(s)}/siem"
    rows = ledger(s, d).select("seq", "ts", "severity", "action", "agent_run_id")
    rows.write.parquet(f"{base}/in")
    feed = live.stream_feed(s, f"{base}/in", rows.schema, format="parquet")
    live.stream_siem(feed, f"{base}/out", f"{base}/state", "high", kind="hec", index="main").trigger(availableNow=True).start().awaitTermination()
    return s.read.text(f"{base}/out").select(
        F.get_json_object("value", "$.event.seq").cast("bigint").alias("seq"), F.get_json_object("value", "$.time").cast("bigint").alias("time"),
        F.get_json_object("value", "$.event.action").alias("action"))


@query("stream_evaluate")
def _(s, d):
    """Documents as tool results, decided batch by batch with all rules."""
    base = f"{_scratch(s)}/decided"
    docs = spread(read_table(s, d, "documents").select("doc_id", F.col("text").alias("value")))
    docs.write.parquet(f"{base}/in")
    sent = s.readStream.schema(docs.schema).parquet(f"{base}/in").select(
        F.col("doc_id").alias("msg_id"), F.lit("tools/call").alias("method"), F.lit("outbound").alias("direction"),
        F.array(F.struct(F.lit("result.text").alias("name"), "value")).alias("fields"), F.lit("a").alias("source"), F.lit("b").alias("destination"))
    live.stream_evaluate(sent, f"{base}/out", evaluate.evaluate_mcp, default_rule_list, lambda: None, classifier=False).option(
        "checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{base}/out").select("msg_id", F.explode("findings").alias("f")).select("msg_id", "f.rule_id", "f.category", "f.severity")


@query("stream_metrics")
def _(s, d):
    """Hours that ended ten minutes before the last event or earlier; the others are still open."""
    rows = ledger(s, d).select("ts", "action", "findings", "counterparty", "agent_run_id")
    return _streamed(rows, lambda events: live.stream_metrics(events, "1 hour")).select(
        F.unix_micros("bucket_start").alias("bucket_us"), "total", "allowed", "warned", "blocked", "findings")


@query("stream_spikes")
def _(s, d):
    rows = ledger(s, d).select("ts", "counterparty", "agent_run_id", "method")
    return _streamed(rows, lambda events: live.stream_spikes(events, DAY, 1.3, 5)).select(
        "bucket_key", F.unix_micros("as_of").alias("as_of_us"), "recent", r6("baseline_mean").alias("baseline_mean"), r6("ratio").alias("ratio"))


@query("stream_suppress")
def _(s, d):
    rows = _finding_rows(ledger(s, d)).select("rule_id", F.col("category").alias("match"), "ts", "seq")
    return _streamed(rows, lambda found: live.stream_suppress(found, 6 * HOUR)).select("rule_id", F.col("match").alias("category"), "seq")


@query("stream_tasks")
def _(s, d):
    """Illegal moves and changed fingerprints; tasks are kept for as long as the table lasts."""
    moves = ("task.invalid_transition", "task.scope_drift")
    found = _streamed(_task_obs(ledger(s, d)), lambda obs: live.stream_tasks(obs, forget=dt.timedelta(days=36500)))
    return found.where(F.col("rule_id").isin(*moves)).select("task_id", "seq", "rule_id")


@query("stream_peer_risk")
def _(s, d):
    rows = ledger(s, d).select("counterparty", "ts", "seq", "severity", "action")
    return _streamed(rows, live.stream_peer_risk).select("counterparty", "seq", r6("risk_score").alias("risk_score"), "alarm")


@query("stream_quarantine")
def _(s, d):
    """Listings and calls of the same ledger; an entry stays for a day."""
    led = ledger(s, d)
    calls = led.where((F.col("method") == "tools/call") & (F.col("direction") == "inbound")).select(
        F.col("seq").cast("string").alias("msg_id"), "ts", "method", "direction", "params")
    rows = calls.unionByName(_listings(led), allowMissingColumns=True)
    return _streamed(rows, lambda events: live.stream_quarantine(live.quarantine_feed(events))).select(
        F.col("msg_id").cast("bigint").alias("msg_id"), "tool", "quarantine_rule")
