"""Layered policies: scope and selector tests, resolution, preview, snapshots, change events."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewarden.functions.ranks import mode_rank, severity_rank
from tracewarden.operators.envelope import server_name
from tracewarden.operators.policy_index import given, listed, winners
from tracewarden.operators.queries import checked_limit
from tracewarden.schema import EVENT_SCHEMA_VERSION, POLICY

#: largest part of a policy table that is sent to all tasks
BROADCAST_BYTES = 16 << 20
#: longest policy list, and its largest size as JSON, that is walked per event; longer ones are looked up by an index
PLAN_POLICIES = 1000
PLAN_BYTES = 1 << 20
_POLICY_DDL = POLICY.simpleString()


def policies_table(spark: SparkSession, policies: list[dict]) -> DataFrame:
    """POLICY table from dictionaries; list order decides ties."""
    base = {f.name: None for f in POLICY}
    rows = []
    for i, p in enumerate(policies):
        row = {**base, "version": 1, "enabled": True, "mode": "monitor", **p, "pos": i}
        rows.append(tuple(row[f.name] for f in POLICY))
    return spark.createDataFrame(rows, POLICY)


def scope_matches(p: Column, tenant: Column, sensor: Column, server: Column) -> Column:
    return (
        (~given(p["tenant_id"]) | (p["tenant_id"] == tenant))
        & (~given(p["sensor_id"]) | (p["sensor_id"] == sensor))
        & (~given(p["server_name"]) | (p["server_name"] == server))
    )


def specificity(p: Column) -> Column:
    """Bits: tenant 1, sensor 2, server 4."""
    return (F.when(given(p["tenant_id"]), 1).otherwise(0) + F.when(given(p["sensor_id"]), 2).otherwise(0)
            + F.when(given(p["server_name"]), 4).otherwise(0))


def selector_matches(p: Column, method: Column, findings: Column) -> Column:
    """Method list, then any finding that meets every given constraint; without findings only an
    unconstrained selector matches."""
    constrained = listed(p["rule_ids"]) | listed(p["categories"]) | given(p["min_severity"])
    hit = F.exists(findings, lambda f: (
        (~listed(p["rule_ids"]) | F.array_contains(p["rule_ids"], f["rule_id"]))
        & (~listed(p["categories"]) | F.array_contains(p["categories"], f["category"]))
        & (~given(p["min_severity"]) | (severity_rank(f["severity"]) >= severity_rank(p["min_severity"])))))
    any_finding = F.coalesce(F.size(findings), F.lit(0)) > 0
    return (~listed(p["methods"]) | F.array_contains(p["methods"], method)) & F.when(
        any_finding, hit).otherwise(~constrained)


def _rank(p: Column) -> Column:
    return F.struct(specificity(p).alias("spec"), mode_rank(p["mode"]).alias("rank"), p["pos"].alias("pos"), p.alias("p"))



def policy_versions(changes: DataFrame) -> DataFrame:
    """The versions of a change log (``id, op, ts, seq`` and POLICY columns, missing ones are not given) with the time they are in force.

    ``valid_from`` is the time of the change, ``valid_to`` that of the policy's next one, null for the last. A deleted policy is in force no longer; of
    changes at one time the last by ``seq`` counts. Ties between policies go by ``pos``, or by ``seq`` where there is none.
    """
    order = Window.partitionBy("id").orderBy("ts", "seq")
    given = [F.col(f.name) if f.name in changes.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in POLICY if f.name != "pos"]
    pos = F.col("pos") if "pos" in changes.columns else F.col("seq").cast("int")
    timed = changes.withColumn("_to", F.lead("ts").over(order)).where("op <> 'delete'")
    return timed.select(*given, pos.alias("pos"), F.col("ts").alias("valid_from"), F.col("_to").alias("valid_to"))


def resolve_policy(events: DataFrame, policies: DataFrame, default_mode: Column | str = "monitor",
                   broadcast_bytes: int = BROADCAST_BYTES, plan_policies: int = PLAN_POLICIES) -> DataFrame:
    """Add ``mode`` and ``matched_policy`` (NULL when none matched).

    Most specific scope first, then the strongest mode, then the last in the list. Events need
    ``tenant_id, sensor_id, server_name, method, findings``. Of up to ``plan_policies`` policies and ``PLAN_BYTES``, those without a scope are one
    constant of the plan and the others are grouped by scope; for each kind of scope in use (seven at most) an event looks up the list of its own
    scope, by a broadcast where the list's size is below ``broadcast_bytes``, else by a shuffle join. Events are never joined
    with themselves, and a list is found once, so rows neither get lost nor doubled. More policies are found by an index from scopes and selectors
    (``policy_index``), joined to the distinct signatures of the events; both ways give the same rows.

    Policies with ``valid_from`` and ``valid_to`` (``policy_versions``) count only for events whose ``ts`` lies between, the first included: every event
    is resolved against the versions in force at its own time.
    """
    default = F.lit(default_mode) if isinstance(default_mode, str) and default_mode not in events.columns else (
        F.col(default_mode) if isinstance(default_mode, str) else default_mode)
    fields = [f.name for f in POLICY]
    timed = "valid_from" in policies.columns
    times = [F.unix_micros(c).alias(c) for c in ("valid_from", "valid_to")] if timed else []
    kinds = policies.where("enabled").select(*fields, *times, specificity(F.struct("*")).alias("_kind"))
    fields = [*fields, "valid_from", "valid_to"] if timed else fields
    head = [r.asDict(recursive=True) for r in kinds.limit(plan_policies + 1).collect()]
    sizes: dict[int, int] = {}
    for row in head:
        sizes[row["_kind"]] = sizes.get(row["_kind"], 0) + len(json.dumps(row).encode())
    if len(head) > plan_policies or sum(sizes.values()) > PLAN_BYTES:
        out = winners(events, kinds.select(*fields), _rank(F.struct(*fields)), timed)
    else:
        out = _winners_by_walk(events, kinds, head, sizes, fields, broadcast_bytes)
    return (
        out.withColumn("mode", F.coalesce("_winner.p.mode", default))
        .withColumn("matched_policy", F.when(F.col("_winner").isNotNull(), F.struct(*[F.col(f"_winner.p.{f.name}").alias(f.name) for f in POLICY])) if timed else F.col("_winner.p"))
        .select(*[c for c in events.columns if c not in ("mode", "matched_policy")], "mode", "matched_policy")
    )


def _winners_by_walk(events: DataFrame, kinds: DataFrame, head: list[dict], sizes: dict[int, int], fields: list[str], broadcast_bytes: int) -> DataFrame:
    """``events`` with ``_winner`` from short lists; ``head`` holds all policies."""
    timed = "valid_from" in fields
    ddl = _POLICY_DDL[:-1] + ",valid_from:bigint,valid_to:bigint>" if timed else _POLICY_DDL

    def applies(p: Column) -> Column:
        fits = selector_matches(p, F.col("method"), F.col("findings"))
        if not timed:
            return fits
        at = F.unix_micros("ts")
        return (p["valid_from"] <= at) & (p["valid_to"].isNull() | (p["valid_to"] > at)) & fits

    def best(found: Column) -> Column:
        return F.array_max(F.transform(F.filter(found, applies), _rank))

    found, out = [], events
    for kind in sorted(sizes):
        scope = [c for bit, c in ((1, "tenant_id"), (2, "sensor_id"), (4, "server_name")) if kind & bit]
        if not scope:
            rows = [{c: row[c] for c in fields} for row in head if row["_kind"] == kind]
            found.append(best(F.from_json(F.lit(json.dumps(rows)), f"array<{ddl}>")))
            continue
        lists = kinds.where(F.col("_kind") == kind).groupBy(*[F.col(c).alias(f"_on_{c}") for c in scope]).agg(
            F.collect_list(F.struct(*fields)).alias(f"_policies_{kind}"))
        on = [F.col(c) == F.col(f"_on_{c}") for c in scope]
        out = out.join(F.broadcast(lists) if sizes[kind] <= broadcast_bytes else lists, on, "left").drop(*[f"_on_{c}" for c in scope])
        found.append(best(F.col(f"_policies_{kind}")))
    winner = F.array_max(F.array(*found)) if found else F.lit(None).cast(f"struct<spec:int,rank:int,pos:int,p:{ddl}>")
    return out.withColumn("_winner", winner)


def policy_preview(ledger: DataFrame, candidate: dict, limit: int | None = 500, tenant: str = "") -> DataFrame:
    """What a candidate policy would have done to the newest ``limit`` recorded events, or with ``None`` to all."""
    rows = ledger.where(F.col("tenant_id") == tenant) if tenant else ledger
    if checked_limit(limit) is not None:
        rows = rows.orderBy(F.desc("seq")).limit(limit)
    policy = {**{f.name: None for f in POLICY}, "mode": "", **candidate}
    constant = F.from_json(F.lit(json.dumps(policy)), _POLICY_DDL)
    hit = scope_matches(constant, F.col("tenant_id"), F.col("sensor_id"), server_name("preview")) & selector_matches(
        constant, F.col("method"), F.col("findings"))
    mode = policy["mode"]
    known = mode in ("monitor", "warn", "block")
    matched = F.coalesce(F.count_if(hit), F.lit(0))
    out = {m: matched if mode == m else F.lit(0).cast("bigint") for m in ("monitor", "warn", "block")}
    return rows.agg(
        F.count("*").alias("records_considered"), matched.alias("records_matched"),
        *[c.alias(f"would_{m}") for m, c in out.items()],
        (F.count("*") - (matched if known else F.lit(0))).alias("would_none"))


def policy_snapshot(change_log: DataFrame, tenant: str = "") -> DataFrame:
    """Active policies after a change log (``seq, op, <policy columns>``).

    The latest row per id survives unless it is a delete; only enabled policies of the tenant, or
    of no tenant, are returned. ``set_version`` is the sum of all surviving versions.
    """
    columns = [c for c in change_log.columns if c not in ("seq", "op", "id")]
    latest = (
        change_log.groupBy("id")
        .agg(F.max_by(F.struct("op", *columns), "seq").alias("_l"))
        .where(F.col("_l.op") != "delete")
        .select("id", *[F.col(f"_l.{c}").alias(c) for c in columns])
    )
    version = latest.agg(F.coalesce(F.sum("version"), F.lit(0)).alias("set_version"))
    active = latest.where("enabled")
    if tenant:
        active = active.where((F.coalesce("tenant_id", F.lit("")) == "") | (F.col("tenant_id") == tenant))
    return active.withColumn("set_version", version.scalar())


def policy_change_events(change_log: DataFrame) -> DataFrame:
    """Each change (``op, actor, ts`` and the policy) as a ledger event."""
    actor = F.when(F.coalesce("actor", F.lit("")) == "", F.lit("unknown")).otherwise(F.col("actor"))
    scope = F.to_json(F.struct(*[F.when(given(F.col(c)), F.col(c)).alias(c)
                                 for c in ("tenant_id", "sensor_id", "server_name")]))
    finding = F.struct(
        F.concat(F.lit("policy.audit."), "op").alias("rule_id"),
        F.lit("policy_audit").alias("category"), F.lit("info").alias("severity"),
        F.concat(F.lit('policy "'), "name", F.lit('" ('), "id", F.lit(") "), "op", F.lit("d by "), actor).alias("description"),
        F.lit("").alias("match"), F.lit("").alias("field"), F.lit(0.0).alias("confidence"),
        F.create_map(
            F.lit("policy_id"), F.col("id"), F.lit("policy_version"), F.col("version").cast("string"),
            F.lit("actor"), actor, F.lit("scope"), scope, F.lit("disposition"), F.col("mode")).alias("metadata"))
    return change_log.select(
        F.lit(EVENT_SCHEMA_VERSION).alias("schema"),
        F.concat(F.lit("policy-"), "id", F.lit("-v"), F.col("version").cast("string")).alias("event_id"),
        "ts", F.lit("control-plane").alias("sensor_id"), F.coalesce("tenant_id", F.lit("")).alias("tenant_id"),
        F.lit("policy").alias("protocol"), F.lit("change").alias("direction"),
        F.array(finding).alias("findings"), F.lit("allow").alias("action"), F.lit("info").alias("severity"))


def match_annotation(matched: Column) -> Column:
    """The info finding that names the policy that decided an event."""
    version = matched["version"].cast("string")
    return F.struct(
        F.lit("policy.match").alias("rule_id"), F.lit("policy_audit").alias("category"), F.lit("info").alias("severity"),
        F.concat(F.lit("matched policy "), matched["id"], F.lit(" v"), version, F.lit(" ("), matched["mode"], F.lit(")"))
        .alias("description"),
        F.lit("").alias("match"), F.lit("").alias("field"), F.lit(0.0).alias("confidence"),
        F.create_map(
            F.lit("policy_id"), matched["id"], F.lit("policy_version"), version, F.lit("policy_mode"), matched["mode"],
            F.lit("policy_scope"), F.to_json(F.struct(*[
                F.when(given(matched[c]), matched[c]).alias(c) for c in ("tenant_id", "sensor_id", "server_name")])))
        .alias("metadata"))
