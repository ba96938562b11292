"""Partial aggregates: exact counts, sketches inside their error, merging."""

import datetime as dt

from pyspark.sql import functions as F

from tracewarden.operators import rollups
from tracewarden.operators.analytics import n_findings
from tracewarden.plans.projections import ledger

SF = "/root/testdata/sf0.01"
COUNTS = ["total", "allowed", "warned", "blocked", "findings"]


def test_merged_equals_made_at_once(spark):
    led = ledger(spark, SF)
    part = F.col("seq") % 3
    merged = rollups.merge_rollups(*[rollups.rollup(led.where(part == i), dt.timedelta(hours=6)) for i in range(3)])
    whole = rollups.rollup(led, dt.timedelta(hours=6))
    key = lambda df: sorted(tuple(r) for r in df.select("tenant_id", "bucket_start", *COUNTS, F.hll_sketch_estimate("peers")).collect())
    assert key(merged) == key(whole)
    report = rollups.rollup_report(merged, by=("tenant_id",))
    exact = {r.tenant_id: r for r in led.groupBy("tenant_id").agg(
        F.count("*").alias("total"), F.count_distinct("agent_run_id").alias("runs"), F.sum("n_findings").alias("findings")).collect()}
    lat = {t: sorted(r.latency_micros for r in led.where(F.col("tenant_id") == t).select("latency_micros").collect()) for t in exact}
    for r in report.collect():
        want = exact[r.tenant_id]
        assert (r.total, r.findings) == (want.total, want.findings)
        assert abs(r.unique_runs - want.runs) <= 0.05 * want.runs + 1
        for p, value in zip((0.5, 0.9, 0.99), r.latency):
            values = lat[r.tenant_id]
            below, upto = sum(v < value for v in values), sum(v <= value for v in values)
            assert below - 0.03 * len(values) <= p * len(values) <= upto + 0.03 * len(values)


def test_nulls_and_empty(spark):
    led = ledger(spark, SF).limit(4).withColumn("ts", F.lit(None).cast("timestamp")).withColumn("latency_micros", F.lit(None).cast("bigint")).withColumn(
        "findings", F.lit(None).cast(ledger(spark, SF).schema["findings"].dataType))
    rows = rollups.merge_rollups(rollups.rollup(led), rollups.rollup(led.where("false"))).collect()
    assert sum(r.total for r in rows) == 4 and all(r.bucket_start is None and r.findings == 0 for r in rows)
    assert all(r.latency is None for r in rollups.rollup_report(rollups.rollup(led), by=("tenant_id",)).collect())
    assert rollups.rollup_report(rollups.rollup(led.where("false"))).first().total == 0


def test_no_findings_column_counts_as_none(spark):
    """Null findings are none, not minus one, with and without audit findings."""
    led = ledger(spark, SF).limit(3)
    led = led.withColumn("findings", F.lit(None).cast(led.schema["findings"].dataType))
    for exclude in (False, True):
        assert {r[0] for r in led.select(n_findings(exclude)).collect()} == {0}
