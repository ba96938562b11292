"""Traffic projections of generic tables: a ledger from events, messages from texts."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.schema import FINDING


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when the input has fewer splits than the cluster has cores (tiny inputs only).

    A table of many row groups already has more splits than cores and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, df.columns[0]) if df.rdd.getNumPartitions() < cores else df


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows (flat, with a ``findings`` array) from the events table."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    is_peer = F.col("event_type").isin("purchase", "signup")
    is_call = F.col("event_type").isin("click", "error")
    tool = F.concat(F.lit("tool-"), (k % 20).cast("string"))
    severity = (
        F.when(F.col("value") >= 80, "critical").when(F.col("value") >= 50, "high")
        .when(F.col("value") >= 30, "medium").when(F.col("value") >= 10, "low").otherwise("info"))
    base = read_table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("tenant-"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"),
        F.concat(F.lit("sensor-"), (F.col("user_id") % 4).cast("string")).alias("sensor_id"),
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("agent_run_id"),
        F.when(is_peer, F.concat(F.lit("peer-"), (F.col("user_id") % 25).cast("string"))).otherwise("").alias("counterparty"),
        F.when(is_peer, "a2a").otherwise("mcp").alias("protocol"),
        F.when(F.col("event_id") % 2 == 0, "inbound").otherwise("outbound").alias("direction"),
        F.when(is_call, "tools/call").when(F.col("event_type") == "view", "tools/list")
        .when(F.col("event_type") == "purchase", "tasks/send").otherwise("tasks/get").alias("method"),
        F.when(is_call, tool).otherwise("").alias("tool"),
        F.when(is_call, F.concat(F.lit('{"name":"'), tool, F.lit('"}'))).alias("params"),
        severity.alias("severity"),
        F.when(F.col("value") >= 80, "block").when(F.col("value") >= 30, "warn").otherwise("allow").alias("action"),
        (k % 4).alias("n_findings"),
        F.floor(F.col("value") * 10).cast("bigint").alias("latency_micros"),
        F.col("props").alias("raw"), "event_type", "user_id",
        F.lit("").alias("source"), F.lit("").alias("destination"),
    )
    return base.withColumn("findings", _findings())


def _findings() -> Column:
    """``n_findings`` findings whose rule and category follow from seq and position."""
    def one(i: Column) -> Column:
        n = F.col("seq") + i
        category = (F.when(n % 5 == 0, "prompt-injection").when(n % 5 == 1, "tool-poisoning")
                    .when(n % 5 == 2, "credential-exfiltration").when(n % 5 == 3, "pii-leakage").otherwise("policy"))
        return F.struct(
            F.concat(F.lit("rule-"), (n % 12).cast("string")).alias("rule_id"), category.alias("category"),
            F.col("severity").alias("severity"), F.lit("").alias("description"), F.lit("").alias("match"),
            F.lit("").alias("field"), F.lit(0.9).alias("confidence"),
            F.create_map().cast("map<string,string>").alias("metadata")).cast(FINDING)

    none = F.array().cast(f"array<{FINDING.simpleString()}>")
    return F.when(F.col("n_findings") > 0, F.transform(F.sequence(F.lit(0), F.col("n_findings") - 1), one)).otherwise(none)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with one inspectable field each, from documents, conversations and pages."""
    def rows(df: DataFrame, msg_id, run, method, direction, field, value) -> DataFrame:
        return df.select(msg_id.alias("msg_id"), run.alias("agent_run_id"), method.alias("method"),
                         direction.alias("direction"),
                         F.array(F.struct(field.alias("name"), value.alias("value"))).alias("fields"))

    role = F.col("role")
    docs = rows(
        read_table(spark, sf_dir, "documents"), F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.col("source"),
        F.lit("tools/call"), F.lit("outbound"), F.lit("result.content.0.text"), F.col("text"))
    talk = rows(
        read_table(spark, sf_dir, "conversations"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")),
        F.concat(F.lit("run-"), F.col("conv_id").cast("string")),
        F.when(role == "system", "tools/list").when(role == "assistant", "tools/call").otherwise("tasks/send"),
        F.when(role == "user", "inbound").otherwise("outbound"),
        F.when(role == "system", "result.tools.0.description").when(role == "assistant", "result.content.0.text")
        .otherwise("params.message.parts.0.text"), F.col("text"))
    pages = rows(
        read_table(spark, sf_dir, "pages"), F.concat(F.lit("p"), F.col("page_id").cast("string")), F.col("url"),
        F.lit("tools/call"), F.lit("outbound"), F.lit("result.content.0.html"), F.col("html"))
    return docs.unionByName(talk).unionByName(pages)


def raw_rpc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON-RPC bodies built from conversation turns; the timestamp orders a conversation."""
    c = read_table(spark, sf_dir, "conversations")
    role = F.col("role")
    user = F.to_json(F.struct(
        F.lit("2.0").alias("jsonrpc"), F.col("turn").cast("string").alias("id"), F.lit("tasks/send").alias("method"),
        F.struct(F.concat(F.lit("task-"), F.col("conv_id").cast("string")).alias("id"),
                 F.struct(F.col("text").alias("text")).alias("message")).alias("params")))
    system = F.to_json(F.struct(
        F.lit("2.0").alias("jsonrpc"), F.lit("notifications/message").alias("method"),
        F.struct(F.col("text").alias("data")).alias("params")))
    assistant = F.to_json(F.struct(
        F.lit("2.0").alias("jsonrpc"), (F.col("turn") - 1).cast("string").alias("id"),
        F.struct(F.concat(F.lit("task-"), F.col("conv_id").cast("string")).alias("id"),
                 F.struct(F.lit("working").alias("state")).alias("status"),
                 F.struct(F.col("text").alias("text")).alias("message")).alias("result")))
    return c.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("msg_id"),
        F.concat(F.lit("run-"), F.col("conv_id").cast("string")).alias("agent_run_id"),
        F.timestamp_seconds(F.col("conv_id") * 100 + F.col("turn")).alias("ts"),
        F.when(role == "assistant", "outbound").otherwise("inbound").alias("direction"),
        F.when(role == "user", user).when(role == "assistant", assistant).otherwise(system).alias("raw"))
