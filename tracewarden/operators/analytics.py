"""Aggregates and rankings over the whole ledger."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.ranks import severity_weight

# Rules that count as task concerns.
TASK_CONCERN_RULES = ("task.invalid_transition", "task.scope_drift", "task.counterparty_changed")
AUDIT_CATEGORIES = ("policy_audit",)


def n_findings(exclude_audit: bool = False) -> Column:
    if not exclude_audit:
        return F.coalesce(F.array_size("findings"), F.lit(0)).cast("bigint")
    kept = F.filter("findings", lambda f: ~f["category"].isin(*AUDIT_CATEGORIES))
    return F.coalesce(F.array_size(kept), F.lit(0)).cast("bigint")


def _scoped(ledger: DataFrame, tenant: str | None) -> DataFrame:
    return ledger.where(F.col("tenant_id") == tenant) if tenant else ledger


def _top(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    ranked = df.orderBy(*order)
    return ranked.limit(limit) if limit > 0 else ranked


def _action_sums(exclude_audit: bool) -> list[Column]:
    return [
        F.sum(n_findings(exclude_audit)).alias("findings"),
        F.count_if(F.col("action") == "warn").alias("warnings"),
        F.count_if(F.col("action") == "block").alias("blocks"),
    ]


def _weighted() -> Column:
    return F.col("blocks") * 5.0 + F.col("warnings") * 2.0 + F.col("findings")


def tool_risk(ledger: DataFrame, limit: int = 0, tenant: str | None = None,
              exclude_audit: bool = False) -> DataFrame:
    """Tools of tools/call traffic ranked by (5 blocks + 2 warnings + findings) per inbound call."""
    from tracewarden.operators.envelope import tool_name

    by_tool = (
        _scoped(ledger, tenant)
        .where(F.col("method") == "tools/call")
        .withColumn("tool", tool_name("params"))
        .where(F.col("tool") != "")
        .groupBy("tool")
        .agg(F.count_if(F.col("direction") == "inbound").alias("total_calls"), *_action_sums(exclude_audit))
    )
    idle = (F.col("total_calls") == 0) & (F.col("findings") == 0)
    scored = by_tool.withColumn(
        "risk_score", F.when(idle, F.lit(0.0)).otherwise(_weighted() / F.greatest("total_calls", F.lit(1))))
    return _top(scored, limit, F.desc("risk_score"), F.asc("tool"))


def agent_activity(ledger: DataFrame, limit: int = 0, tenant: str | None = None,
                   exclude_audit: bool = False) -> DataFrame:
    """Per agent run: volume, blocks, mean severity weight and the finding categories seen."""
    categories = F.array_distinct(F.filter(F.transform("findings", lambda f: f["category"]), lambda c: c != ""))
    per_run = (
        _scoped(ledger, tenant)
        .where(F.col("agent_run_id") != "")
        .withColumn("_cats", categories)
        .groupBy("agent_run_id")
        .agg(
            F.count("*").alias("events"),
            F.sum(n_findings(exclude_audit)).alias("findings"),
            F.count_if(F.col("action") == "block").alias("blocks"),
            F.avg(severity_weight("severity")).alias("severity_score"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("_cats")))).alias("categories"),
        )
    )
    return _top(per_run, limit, F.desc("severity_score"), F.asc("agent_run_id"))


def category_counts(ledger: DataFrame, tenant: str | None = None) -> DataFrame:
    return (
        _scoped(ledger, tenant)
        .select(F.explode(F.transform("findings", lambda f: f["category"])).alias("category"))
        .groupBy("category").agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), F.asc("category"))
    )


def counterparty_risk(ledger: DataFrame, limit: int = 0, tenant: str | None = None,
                      exclude_audit: bool = False) -> DataFrame:
    per_peer = (
        _scoped(ledger, tenant)
        .where(F.col("counterparty") != "")
        .groupBy("counterparty")
        .agg(F.count("*").alias("events"), *_action_sums(exclude_audit))
        .withColumn("risk_score", _weighted() / F.greatest("events", F.lit(1)))
    )
    return _top(per_peer, limit, F.desc("risk_score"), F.asc("counterparty"))


def task_concerns(ledger: DataFrame, limit: int = 0, rule_ids: tuple = TASK_CONCERN_RULES) -> DataFrame:
    """Findings of the task rules, newest first."""
    rows = (
        ledger
        .where(F.exists("findings", lambda f: f["rule_id"].isin(*rule_ids)))
        .select("seq", "counterparty", F.posexplode("findings").alias("pos", "f"))
        .where(F.col("f.rule_id").isin(*rule_ids))
        .select(F.col("f.match").alias("task_id"), "counterparty", F.col("f.rule_id").alias("rule_id"),
                F.col("f.description").alias("description"), "seq", "pos")
    )
    return _top(rows, limit, F.desc("seq"), F.asc("pos")).drop("pos")


def _window_rows(ledger: DataFrame, as_of: dt.datetime, window: dt.timedelta) -> DataFrame:
    return ledger.where(F.col("ts") >= F.lit(as_of - window))


def _cells(window: dt.timedelta, bucket: dt.timedelta) -> int:
    return max(1, window // bucket)


def _cell(as_of: dt.datetime, bucket: dt.timedelta, cells: int) -> Column:
    """Index of a row's cell: whole buckets of age, cut toward zero, counted from the right."""
    age = F.unix_micros(F.lit(as_of)) - F.unix_micros("ts")
    width = bucket // dt.timedelta(microseconds=1)
    whole = F.floor(F.abs(age) / F.lit(width)).cast("bigint")
    return F.lit(cells - 1) - F.when(age < 0, -whole).otherwise(whole)


def action_histogram(ledger: DataFrame, as_of: dt.datetime, window: dt.timedelta = dt.timedelta(minutes=5),
                     bucket: dt.timedelta = dt.timedelta(seconds=10)) -> DataFrame:
    """One row per cell (oldest first, zero-filled) with the counts of each action."""
    cells = _cells(window, bucket)
    counted = (
        _window_rows(ledger, as_of, window)
        .withColumn("cell", _cell(as_of, bucket, cells))
        .where((F.col("cell") >= 0) & (F.col("cell") < cells))
        .groupBy("cell")
        .agg(*[F.count_if(F.col("action") == a).alias(f"{a}_count") for a in ("allow", "warn", "block")])
    )
    grid = ledger.sparkSession.range(cells).withColumnRenamed("id", "cell")
    # both sides hold at most one row per cell
    return (
        grid.join(counted, "cell", "left")
        .na.fill(0, ["allow_count", "warn_count", "block_count"])
        .orderBy("cell")
    )


def histogram_arrays(histogram: DataFrame) -> DataFrame:
    """The histogram as three arrays in one row."""
    ordered = F.array_sort(F.collect_list(F.struct("cell", "allow_count", "warn_count", "block_count")))
    return histogram.agg(ordered.alias("h")).select(*[
        F.transform("h", lambda x, a=a: x[f"{a}_count"]).alias(a) for a in ("allow", "warn", "block")])


def window_metrics(ledger: DataFrame, as_of: dt.datetime, window: dt.timedelta = dt.timedelta(minutes=5),
                   bucket: dt.timedelta = dt.timedelta(seconds=10), approx: bool = False) -> DataFrame:
    """Totals, distinct peers and runs, and a sparkline of the window, in one row."""
    cells = _cells(window, bucket)
    distinct = F.approx_count_distinct if approx else F.count_distinct
    rows = _window_rows(ledger, as_of, window)
    totals = rows.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("action") == "allow").alias("allowed"),
        F.count_if(F.col("action") == "warn").alias("warned"),
        F.count_if(F.col("action") == "block").alias("blocked"),
        F.coalesce(F.sum(n_findings()), F.lit(0)).alias("findings"),
        distinct(F.when(F.col("counterparty") != "", F.col("counterparty"))).alias("unique_peers"),
        distinct(F.when(F.col("agent_run_id") != "", F.col("agent_run_id"))).alias("unique_runs"),
    )
    per_cell = (
        rows.withColumn("cell", _cell(as_of, bucket, cells))
        .where((F.col("cell") >= 0) & (F.col("cell") < cells))
        .groupBy("cell").agg(F.count("*").alias("n"))
        .agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("m"))
        .select(F.transform(
            F.sequence(F.lit(0), F.lit(cells - 1)),
            lambda i: F.coalesce(F.try_element_at("m", i.cast("bigint")), F.lit(0))).alias("sparkline"))
    )
    # two one-row tables
    return totals.join(per_cell).select(
        F.lit(int(window.total_seconds())).cast("bigint").alias("window_seconds"),
        F.lit(int(bucket.total_seconds())).cast("bigint").alias("bucket_seconds"), "*")


def event_counters(ledger: DataFrame) -> DataFrame:
    """Events by action and severity; empty labels count as unknown."""
    def label(c: str) -> Column:
        return F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit("unknown")).otherwise(F.col(c)).alias(c)

    return ledger.select(label("action"), label("severity")).groupBy("action", "severity").agg(
        F.count("*").alias("events"))


def policy_change_counters(change_log: DataFrame) -> DataFrame:
    tenant = F.when(F.coalesce("tenant_id", F.lit("")) == "", F.lit("_org_")).otherwise(F.col("tenant_id"))
    return change_log.select("op", tenant.alias("tenant")).groupBy("op", "tenant").agg(F.count("*").alias("changes"))


def ledger_stats(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("head_hash"))


def export_window(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("record_count"), F.min("seq").alias("seq_lo"), F.max("seq").alias("seq_hi"))


def latency_quantiles(events: DataFrame, ps: list[float], column: str = "latency_micros") -> DataFrame:
    """Value at index floor((n-1)*p) of the sorted list, for every p.

    Equal values are counted first, so the ranking works on one row per distinct value, and the
    cumulative counts are built per value range instead of over the whole table.
    """
    counts = events.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    bits = 2 ** 14
    ranged = counts.withColumn("_r", F.floor(F.col("v") / bits))
    per_range = ranged.groupBy("_r").agg(F.sum("n").alias("_n"))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # one row per value range
    offsets = per_range.select("_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_r").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.withColumn("_cum", F.sum("n").over(inside)).join(offsets, "_r")
        .select("v", (F.col("_off") + F.col("_cum") - F.col("n")).alias("lo"), (F.col("_off") + F.col("_cum")).alias("hi"))
    )
    total = counts.agg(F.sum("n").alias("total")).select("total")
    wanted = total.select(F.explode(F.array(*[F.struct(
        F.lit(float(p)).alias("p"), F.floor((F.col("total") - 1) * F.lit(float(p))).alias("idx")) for p in ps])).alias("w"))
    wanted = F.broadcast(wanted.select("w.p", "w.idx"))  # len(ps) rows
    return placed.join(wanted, (F.col("idx") >= F.col("lo")) & (F.col("idx") < F.col("hi"))).select(
        "p", F.col("v").alias("value"))
