"""Row types of the data model.

Events are kept flat (one column per attribute) so that parquet scans can prune
columns and push filters; only ``findings`` and ``fields`` are nested.
"""

from __future__ import annotations

from pyspark.sql import types as T

FINDING = T.StructType([
    T.StructField("rule_id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("match", T.StringType()),
    T.StructField("field", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])

FIELD = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("value", T.StringType()),
])

#: One captured JSON-RPC message as it is read from disk.
TRAFFIC = T.StructType([
    T.StructField("msg_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("direction", T.StringType()),
    T.StructField("tenant_id", T.StringType()),
    T.StructField("sensor_id", T.StringType()),
    T.StructField("agent_run_id", T.StringType()),
    T.StructField("counterparty", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("destination", T.StringType()),
    T.StructField("raw", T.StringType()),
])

#: One decided event (the unit the ledger chains).
EVENT = T.StructType([
    T.StructField("schema", T.StringType()),
    T.StructField("event_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("sensor_id", T.StringType()),
    T.StructField("tenant_id", T.StringType()),
    T.StructField("agent_run_id", T.StringType()),
    T.StructField("counterparty", T.StringType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("direction", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("destination", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("params", T.StringType()),
    T.StructField("raw", T.StringType()),
    T.StructField("findings", T.ArrayType(FINDING)),
    T.StructField("action", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("latency_micros", T.LongType()),
])

RULE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("targets", T.ArrayType(T.StringType())),
    T.StructField("directions", T.ArrayType(T.StringType())),
    T.StructField("fields", T.ArrayType(T.StringType())),
    T.StructField("patterns", T.ArrayType(T.StringType())),
    T.StructField("case_sensitive", T.BooleanType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("view", T.StringType()),
    T.StructField("pos", T.IntegerType()),
])

POLICY = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("version", T.LongType()),
    T.StructField("enabled", T.BooleanType()),
    T.StructField("tenant_id", T.StringType()),
    T.StructField("sensor_id", T.StringType()),
    T.StructField("server_name", T.StringType()),
    T.StructField("rule_ids", T.ArrayType(T.StringType())),
    T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("min_severity", T.StringType()),
    T.StructField("methods", T.ArrayType(T.StringType())),
    T.StructField("mode", T.StringType()),
    T.StructField("pos", T.IntegerType()),
])

# They appear on the wire or in hashed text and must not change.
EVENT_SCHEMA_VERSION = "event/v1"
RECORD_SCHEMA_VERSION = "record/v1"
EXPORT_SCHEMA_VERSION = "export/v1"
GENESIS_HASH = "0" * 64
PROTOCOLS = ("mcp", "a2a", "behavior", "control", "policy")
DIRECTIONS = ("inbound", "outbound", "synthetic", "change")
ACTIONS = ("allow", "warn", "block")
SEVERITIES = ("info", "low", "medium", "high", "critical")
MODES = ("monitor", "warn", "block")
