"""Exports: NDJSON with a proof trailer, flat CSV, payloads for alerting systems, audit bundles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.text import truncate_bytes
from tracewarden.operators.analytics import export_window
from tracewarden.operators.ledger import canonical_records, dense_index, rfc3339
from tracewarden.operators.merkle import merkle_root
from tracewarden.operators.queries import meets_min_severity, query_events
from tracewarden.schema import EXPORT_SCHEMA_VERSION, RECORD_SCHEMA_VERSION

_HMAC_BLOCK = 64

# Column order of the flat view.
CSV_COLUMNS = [
    "seq", "ingest_at", "event_id", "timestamp", "protocol", "direction", "action", "severity", "agent_run_id",
    "counterparty", "method", "finding_count", "rule_ids", "categories", "highest_severity", "source", "destination",
    "raw",
]


def chain_proof(records: DataFrame, head_hash: str, exported_at: str) -> DataFrame:
    """One-row trailer that binds an export to a point of the ledger."""
    w = export_window(records)
    return w.select(
        F.lit("chain_proof").alias("_type"), F.lit(head_hash).alias("head_hash"), F.lit(exported_at).alias("exported_at"),
        "record_count", F.when(F.col("record_count") > 0, F.array("seq_lo", "seq_hi")).alias("seq_range"))


def export_ndjson(ledger: DataFrame, head_hash: str, exported_at: str, limit: int | None = None, **filters) -> DataFrame:
    """Text rows: matching records newest first, then the proof line. ``limit=None`` exports all."""
    records = query_events(ledger, limit=limit, **filters)
    body = records.select(F.lit(0).alias("_k"), (-F.col("seq")).alias("_o"), F.to_json(F.struct("*")).alias("value"))
    proof = chain_proof(records, head_hash, exported_at).select(
        F.lit(1).alias("_k"), F.lit(0).cast("bigint").alias("_o"), F.to_json(F.struct("*")).alias("value"))
    return body.unionByName(proof).orderBy("_k", "_o").select("value")


def csv_view(ledger: DataFrame, raw_bytes: int | None = None) -> DataFrame:
    """The 18 flat columns; rule ids in order, categories once each, raw text cut to ``raw_bytes`` on request."""
    rule_ids = F.array_join(F.transform("findings", lambda f: f["rule_id"]), "|")
    categories = F.array_join(F.array_distinct(F.filter(
        F.transform("findings", lambda f: f["category"]), lambda c: c != "")), "|")
    made = {
        "timestamp": rfc3339("ts"), "finding_count": F.size("findings").cast("bigint"), "rule_ids": rule_ids,
        "categories": categories, "highest_severity": F.col("severity"), "raw": F.col("raw") if raw_bytes is None else truncate_bytes(F.col("raw"), raw_bytes),
    }
    return ledger.select(*[made.get(c, F.col(c)).alias(c) for c in CSV_COLUMNS])


def export_csv(ledger: DataFrame, path: str, limit: int | None = None, raw_bytes: int | None = None, **filters) -> None:
    rows = query_events(ledger, limit=limit, **filters)
    csv_view(rows, raw_bytes).orderBy(F.desc("seq")).write.mode("overwrite").option("header", True).csv(path)


def hmac_sha256(body: Column, secret: str) -> Column:
    """Hex HMAC of a text with a constant key, in JVM functions."""
    key = secret.encode()
    if len(key) > _HMAC_BLOCK:
        import hashlib

        key = hashlib.sha256(key).digest()
    key = key.ljust(_HMAC_BLOCK, b"\0")
    inner = F.unhex(F.lit(bytes(b ^ 0x36 for b in key).hex()))
    outer = F.unhex(F.lit(bytes(b ^ 0x5C for b in key).hex()))
    digest = F.sha2(F.concat(inner, F.encode(body, "UTF-8")), 256)
    return F.sha2(F.concat(outer, F.unhex(digest)), 256)


def siem_payloads(records: DataFrame, min_severity: str = "", kind: str = "webhook", index: str = "",
                  sourcetype: str = "agent-traffic", secret: str = "") -> DataFrame:
    """Rows to ship: ``seq, body`` and, for webhooks, ``schema`` and ``signature``."""
    rows = records.where(meets_min_severity("severity", min_severity)) if min_severity else records
    record = F.struct(*[c for c in rows.columns])
    if kind == "hec":
        parts = [F.lit(sourcetype).alias("sourcetype"), record.alias("event")]
        if index:
            parts.append(F.lit(index).alias("index"))
        parts.append(F.unix_seconds("ts").alias("time"))
        return rows.select("seq", F.to_json(F.struct(*parts)).alias("body"))
    body = F.to_json(record)
    out = rows.select("seq", body.alias("body"), F.lit(RECORD_SCHEMA_VERSION).alias("schema"))
    return out.withColumn("signature", F.concat(F.lit("sha256="), hmac_sha256(F.col("body"), secret)) if secret
                          else F.lit(None).cast("string"))


def verify_payloads(payloads: DataFrame, secret: str) -> DataFrame:
    """Add ``verified``; an empty secret or a malformed header is never valid."""
    if not secret:
        return payloads.withColumn("verified", F.lit(False))
    good = F.lower("signature") == F.concat(F.lit("sha256="), hmac_sha256(F.col("body"), secret))
    return payloads.withColumn("verified", F.coalesce(good & F.col("signature").startswith("sha256="), F.lit(False)))


def audit_records(ledger: DataFrame, since: dt.datetime | None = None, until: dt.datetime | None = None,
                  tenant: str = "", ts: str = "ts") -> DataFrame:
    """Records of a window with canonical JSON, leaf hash and leaf index (ascending seq)."""
    rows = ledger
    if since is not None:
        rows = rows.where(F.col(ts) >= F.lit(since))
    if until is not None:
        rows = rows.where(F.col(ts) <= F.lit(until))
    if tenant:
        rows = rows.where(F.col("tenant_id") == tenant)
    return dense_index(canonical_records(rows))


def audit_bundle(ledger: DataFrame, out: str, head_hash: str, exported_at: str, tenant: str = "", **window) -> DataFrame:
    """Write canonical records below ``out`` and return the one-row manifest."""
    records = audit_records(ledger, tenant=tenant, **window)
    records.select("seq", "canonical", "leaf_hash", "hash", "ingest_at", "idx").write.mode("overwrite").json(out + "/records")
    written = ledger.sparkSession.read.schema(
        "seq bigint, canonical string, leaf_hash string, hash string, ingest_at string, idx bigint").json(out + "/records")
    manifest = merkle_root(written.select("idx", F.col("leaf_hash").alias("hash"))).select(
        F.lit(EXPORT_SCHEMA_VERSION).alias("schema"), F.lit(exported_at).alias("exported_at"), F.lit(tenant).alias("tenant"),
        F.lit(head_hash).alias("chain_head"), "merkle_root", F.col("leaf_count").alias("record_count"))
    manifest.write.mode("overwrite").json(out + "/manifest")
    return manifest
