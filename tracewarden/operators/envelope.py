"""JSON-RPC envelopes: parsing, batches, kinds, fields and the columns derived from them."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tracewarden.functions.asof import carry_last
from tracewarden.functions.ranks import as_col
from tracewarden.schema import FIELD, FINDING

_ENVELOPE = "jsonrpc string, id string, method string, params string, result string, error string, _bad string"
TASK_METHODS = ("tasks/send", "tasks/sendSubscribe", "tasks/get", "tasks/cancel")


def _envelope(raw: Column) -> Column:
    return F.from_json(raw, _ENVELOPE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})


def parse_envelope(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``status`` (ok / malformed), ``reason`` and the envelope parts; never fails a row.

    Nested parts stay JSON text, so one pass over the body is enough for every later operator.
    """
    text = F.coalesce(F.col(raw), F.lit(""))
    e = F.col("_e")
    version = F.coalesce(e["jsonrpc"], F.lit(""))
    is_object = F.trim(text).startswith("{")
    reason = (
        F.when(F.octet_length(text) == 0, F.lit("empty body"))
        .when(~is_object | e.isNull() | e["_bad"].isNotNull(), F.lit("parse envelope"))
        .when((version != "") & (version != "2.0"),
              F.concat(F.lit('unsupported jsonrpc version "'), version, F.lit('"')))
    )
    ok = F.col("reason").isNull()

    def part(name: str, default: Column) -> Column:
        return F.when(ok, F.coalesce(e[name], default)).alias(name)

    null = F.lit(None).cast("string")
    return (
        df.withColumn("_e", _envelope(text))
        .withColumn("reason", reason)
        .select(
            *df.columns,
            F.when(ok, F.lit("ok")).otherwise(F.lit("malformed")).alias("status"), "reason",
            part("id", null), part("method", F.lit("")), part("params", null), part("result", null), part("error", null))
    )


def explode_batch(df: DataFrame, raw: str = "raw") -> DataFrame:
    """One row per message of a batch (``batch_pos`` from 0); single messages keep their row."""
    batched = F.ltrim(F.coalesce(F.col(raw), F.lit(""))).startswith("[")
    items = F.when(batched, F.from_json(raw, "array<string>")).otherwise(F.array(F.col(raw)))
    others = [c for c in df.columns if c != raw]
    return df.select(
        *others, batched.alias("is_batch"),
        F.posexplode_outer(F.coalesce(items, F.array(F.col(raw)))).alias("batch_pos", raw))


def message_kind(method: str = "method", rpc_id: str = "id") -> Column:
    """request, notification, response or other."""
    has_method = F.coalesce(F.col(method), F.lit("")) != ""
    has_id = F.col(rpc_id).isNotNull()
    return (
        F.when(has_method & (~has_id | F.col(method).startswith("notifications/")), F.lit("notification"))
        .when(has_method, F.lit("request"))
        .when(has_id, F.lit("response"))
        .otherwise(F.lit("other"))
    )


@F.arrow_udf(ArrayType(FIELD))
def _leaves(params: pa.Array, result: pa.Array, error: pa.Array) -> pa.Array:
    out = []
    for p, r, e in zip(params.to_pylist(), result.to_pylist(), error.to_pylist()):
        fields: list = []
        for root, text in (("params", p), ("result", r)):
            if text:
                try:
                    _walk(root, json.loads(text), fields)
                except ValueError:
                    pass
        fields.sort(key=lambda f: f["name"])
        message = _error_message(e)
        if message:
            fields.append({"name": "error.message", "value": message})
        out.append(fields)
    return pa.array(out, pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])))


def _walk(path: str, value, out: list) -> None:
    """String leaves below a JSON value, iteratively (nesting depth is the sender's choice)."""
    stack = [(path, value)]
    while stack:
        path, value = stack.pop()
        if isinstance(value, str):
            out.append({"name": path, "value": value.encode("utf-8", "replace").decode("utf-8")})
        elif isinstance(value, dict):
            stack.extend((f"{path}.{k}", v) for k, v in value.items())
        elif isinstance(value, list):
            stack.extend((f"{path}.{i}", v) for i, v in enumerate(value))


def _error_message(text: str | None) -> str | None:
    if not text:
        return None
    try:
        error = json.loads(text)
    except ValueError:
        return None
    message = error.get("message") if isinstance(error, dict) else None
    return message if isinstance(message, str) else None


def extract_fields(df: DataFrame) -> DataFrame:
    """Add ``fields``: every string leaf of params and result by dotted path, and error.message."""
    # non-deterministic for the optimizer only: the walk is then never copied into several places
    return df.withColumn("fields", _leaves.asNondeterministic()("params", "result", "error"))


def tool_name(params: Column | str = "params") -> Column:
    """``name`` of a params object when it is a string, else the empty string."""
    name = F.try_variant_get(F.try_parse_json(as_col(params)), "$.name", "variant")
    return F.when(F.schema_of_variant(name) == "STRING", F.coalesce(name.cast("string"), F.lit(""))).otherwise(F.lit(""))


def server_name(mode: str = "live", direction: str = "direction", source: str = "source",
                destination: str = "destination") -> Column:
    """Server an event concerns. live: by direction; preview: destination, else source."""
    src, dst = F.nullif(F.col(source), F.lit("")), F.nullif(F.col(destination), F.lit(""))
    to_server = F.coalesce(dst, src, F.lit(""))
    if mode == "preview":
        return to_server
    return F.when(F.col(direction) == "inbound", to_server).otherwise(F.coalesce(src, dst, F.lit("")))


def block_reason(findings: Column | str, prefix: str = "blocked") -> Column:
    """Text for the first high or critical finding, else a generic one."""
    findings = as_col(findings)
    first = F.get(F.filter(findings, lambda f: f["severity"].isin("critical", "high")), F.lit(0))
    text = F.concat(F.lit(prefix + ": "), first["rule_id"])
    described = F.concat(text, F.lit(" ("), first["description"], F.lit(")"))
    return (
        F.when(first.isNull(), F.lit(prefix + " by policy"))
        .when(F.coalesce(first["description"], F.lit("")) != "", described)
        .otherwise(text)
    )


def task_signals(df: DataFrame, params: str = "params", result: str = "result") -> DataFrame:
    """Add task id, message fingerprint, state, declared history and the two parties."""
    p, r = F.col(params), F.col(result)
    message = F.get_json_object(p, "$.message")
    # whole-number and nested values are re-serialized compactly by the JSON reader
    compact = F.to_json(F.from_json(p, "message variant")["message"])
    meta = F.from_json(
        r, "metadata struct<x_state_history:array<string>,x_responder:struct<name:string>,x_contracted:struct<name:string>>"
    )["metadata"]
    return df.select(
        "*",
        F.coalesce(F.get_json_object(p, "$.id"), F.get_json_object(r, "$.id"), F.lit("")).alias("task_id"),
        F.when(message.isNotNull(), F.left(F.sha2(F.coalesce(compact, message), 256), F.lit(16)))
        .otherwise(F.lit("")).alias("fingerprint"),
        F.coalesce(F.get_json_object(r, "$.status.state"), F.lit("")).alias("state"),
        meta["x_state_history"].alias("history"),
        F.coalesce(meta["x_responder"]["name"], F.lit("")).alias("responder"),
        F.coalesce(meta["x_contracted"]["name"], F.lit("")).alias("contracted"),
    )


def stamp_method(messages: DataFrame) -> DataFrame:
    """Give each response the method and params of the latest earlier request with its run and id.

    Adds ``request_params`` (so a response knows the tool it answers) and fills ``method``. Messages without an id answer
    nothing and go past the lookup, so they do not meet under one key.
    """
    is_request = F.coalesce("method", F.lit("")) != ""
    keyed = messages.where(F.col("id").isNotNull()).withColumn("_run", F.coalesce("agent_run_id", F.lit(""))).withColumn("_id", F.col("id"))
    linked = carry_last(keyed, ["_run", "_id"], ["ts", "msg_id"], {
        "_request": F.when(is_request, F.struct("method", "params"))})
    response = (F.coalesce("method", F.lit("")) == "") & F.col("_request").isNotNull()
    alone = messages.where(F.col("id").isNull()).withColumn("request_params", F.lit(None).cast(messages.schema["params"].dataType))
    return (
        linked
        .withColumn("request_params", F.when(response, F.col("_request.params")))
        .withColumn("method", F.when(response, F.col("_request.method")).otherwise(F.col("method")))
        .drop("_request", "_run", "_id")
        .unionByName(alone)
    )


def malformed_findings(df: DataFrame, protocol: str = "mcp", fail_open: bool = True,
                       max_bytes: int | None = None, raw: str = "raw") -> DataFrame:
    """Finding rows for bodies that do not parse, and for bodies above the inspection limit.

    Input is the output of ``parse_envelope``. Unparsed bodies pass when failing open, over-size
    bodies are always blocked.
    """
    title = {"mcp": "MCP envelope failed to parse: ", "a2a": "A2A task envelope failed to parse: ",
             "card": "agent card failed to parse: "}[protocol]
    rule = "card.malformed" if protocol == "card" else "envelope.malformed"
    too_big = F.octet_length(raw) > max_bytes if max_bytes else F.lit(False)
    reason = F.when(too_big, F.lit("request body exceeds inspection limit")).otherwise(F.col("reason"))
    finding = F.struct(
        F.lit(rule).alias("rule_id"), F.lit("policy").alias("category"), F.lit("low").alias("severity"),
        F.concat(F.lit(title), F.coalesce(reason, F.lit(""))).alias("description"), F.lit("").alias("match"),
        F.lit("").alias("field"), F.lit(0.0).alias("confidence"),
        F.create_map().cast("map<string,string>").alias("metadata")).cast(FINDING)
    action = F.when(too_big | F.lit(not fail_open), F.lit("block")).otherwise(F.lit("allow"))
    return df.where((F.col("status") != "ok") | too_big).select(
        "msg_id", action.alias("action"), F.lit("low").alias("severity"), finding.alias("finding"))
