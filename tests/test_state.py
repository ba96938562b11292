import datetime as dt
import random

from pyspark.sql import functions as F

from tracewarden.operators import behavior, peers, quarantine, taint, tasks
from tracewarden.streaming import live

T0 = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


def _peer_rows(n=400, seed=3):
    rnd, t, rows = random.Random(seed), T0, []
    for i in range(n):
        t += dt.timedelta(seconds=rnd.choice([0, 30, 900, 4000, 9000]))
        rows.append((rnd.choice(["p1", "p1", "p2"]), 1, rnd.choice(["allow", "warn", "block"]), rnd.choice(["info", "low", "high", "critical"]), t, i))
    return rows


def _fold(rows):
    weight = {"critical": 5.0, "high": 2.5, "medium": 1.0, "low": 0.25}
    state, out = {}, {}
    for peer, _, action, sev, t, i in sorted(rows, key=lambda r: (r[4], r[5])):
        score, last = state.get(peer, (0.0, None))
        if last is not None and t > last:
            score *= max(0.0, 1 - 0.5 * (t - last).total_seconds() / 3600)
        w = weight.get(sev, 0.0) + (4.0 if action == "block" else 0.0)
        out[i] = (score + w, score + w >= 10 > score)
        state[peer] = (score + w, t)
    return out


def test_peer_risk_equals_plain_fold(spark):
    rows = _peer_rows()
    df = spark.createDataFrame(rows, "counterparty string, findings int, action string, severity string, ts timestamp, seq bigint")
    got = {r.seq: (r.risk_score, r.alarm) for r in peers.peer_risk(df).collect()}
    want = _fold(rows)
    assert set(got) == set(want)
    for i, (score, alarm) in want.items():
        assert abs(got[i][0] - score) < 1e-9 and got[i][1] == alarm


def _suppressed(rows, window):
    last, keep = {}, set()
    for rule, match, t, i in sorted(rows, key=lambda r: (r[2], r[3])):
        key = (rule, match)
        if key not in last or t - last[key] >= window:
            last[key] = t
            keep.add(i)
    return keep


def _finding_rows(n=600, seed=5):
    rnd, t, rows = random.Random(seed), T0, []
    for i in range(n):
        t += dt.timedelta(seconds=rnd.choice([0, 1, 20, 100, 299, 300, 2500, 30000]))
        rows.append((rnd.choice(["r1", "r2"]), rnd.choice(["a", "a", "b"]), t, i))
    return rows


def test_suppress_equals_plain_fold(spark):
    rows = _finding_rows()
    df = spark.createDataFrame(rows, "rule_id string, match string, ts timestamp, seq bigint")
    got = {r.seq for r in behavior.suppress_repeats(df).collect()}
    assert got == _suppressed(rows, behavior.WINDOW)


def _obs(n=300, seed=7):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        rows.append((rnd.choice(["t1", "t2", "t3"]), rnd.choice(["", "a", "b"]), rnd.choice(["", "submitted", "working", "input-required", "completed"]),
                     rnd.choice(["", "f1", "f2"]), T0 + dt.timedelta(minutes=7 * i), i))
    return rows


_OBS = "task_id string, counterparty string, state string, fingerprint string, ts timestamp, seq bigint"


def _task_fold(rows):
    known, out = {}, []
    for task, peer, state, fp, _, i in rows:
        if task not in known:
            known[task] = [state or "submitted", peer, fp]
            continue
        cur, p, first = known[task]
        if peer and p and peer != p:
            out.append((i, "task.counterparty_changed"))
        if state and state != cur:
            if state not in tasks.LEGAL_MOVES[cur]:
                out.append((i, "task.invalid_transition"))
            cur = state
        if fp and first and fp != first and cur != "submitted":
            out.append((i, "task.scope_drift"))
        known[task] = [cur, peer or p, first]
    return out


def test_task_checks_equal_plain_fold(spark):
    rows = _obs()
    got = sorted((r.seq, r.pos, r.rule_id) for r in tasks.task_findings(spark.createDataFrame(rows, _OBS)).collect())
    assert [(s, r) for s, _, r in got] == _task_fold(rows)


def test_declared_history(spark):
    rows = [("m1", "t", ["submitted", "completed"], "x", "x"), ("m2", "t", ["completed", "working"], "a", "b"), ("m3", "t", ["submitted", "working", "completed"], "", "b")]
    df = spark.createDataFrame(rows, "msg_id string, task_id string, history array<string>, responder string, contracted string")
    got = sorted((r.msg_id, r.pos, r.rule_id) for r in tasks.declared_history_findings(df).collect())
    assert got == [("m1", 0, "task.state_skip"), ("m2", 0, "task.invalid_transition"), ("m2", 1, "task.counterparty_mismatch")]


def test_quarantine_refresh_and_expiry(spark):
    finding = {"severity": "high", "field": "result.tools.1.description", "description": "d", "rule_id": "r"}
    events = spark.createDataFrame([("tools/list", "outbound", '{"tools":[{"name":"a"},{"name":"b"}]}', [finding], T0 + k * HOUR) for k in (0, 10)],
                                   "method string, direction string, result string, findings array<struct<severity:string,field:string,description:string,rule_id:string>>, ts timestamp")
    entries = quarantine.quarantine_entries(events)
    calls = spark.createDataFrame([(str(h), tool, T0 + h * HOUR) for h in (0, 1, 30, 35) for tool in ("a", "b")], "msg_id string, tool string, ts timestamp")
    assert {(r.msg_id, r.tool) for r in quarantine.apply_quarantine(calls, entries).collect()} == {("1", "b"), ("30", "b")}


def _tags(spark, rows):
    df = spark.createDataFrame(rows, "msg_id string, agent_run_id string, ts timestamp, value string")
    return taint.taint_tags(df.select("msg_id", "agent_run_id", "ts", F.lit("tools/call").alias("method"), F.lit("outbound").alias("direction"),
                                      F.array(F.struct(F.lit("result.text").alias("name"), F.col("value").alias("value"))).alias("fields")))


def _sent(spark, rows):
    df = spark.createDataFrame(rows, "msg_id string, agent_run_id string, ts timestamp, counterparty string, value string")
    return df.select("msg_id", "agent_run_id", "ts", "counterparty", F.array(F.struct(F.lit("params.text").alias("name"), F.col("value").alias("value"))).alias("fields"))


def test_taint_cap_order_and_runs(spark):
    """Every value is tagged; only the last ``cap`` before a message count, the earliest of them wins."""
    common = "common preamble that every result repeats "
    rows = [(f"{i:03d}", "run", T0 + dt.timedelta(minutes=i), common + f"value number {i:03d} of the run") for i in range(40)]
    tags = _tags(spark, rows)
    sent = _sent(spark, [
        ("a", "run", T0 + dt.timedelta(minutes=20, seconds=1), "peer", common), ("b", "other", T0 + HOUR, "peer", common),
        ("c", "run", T0 + dt.timedelta(minutes=39, seconds=1), "peer", "leak: value number 035 of the run"),
        ("d", "run", T0 + dt.timedelta(minutes=39, seconds=1), "peer", "leak: value number 002 of the run"), ("e", "run", T0, "peer", common)])
    got = {r.msg_id: r.taint_id for r in taint.taint_leaks(sent, tags, max_per_run=8).collect()}
    # a: 21 values were tagged, the last eight are 013..020; at c and d they are 032..039
    assert got["a"].startswith("t-013") and "b" not in got and "e" not in got
    assert got["c"].startswith("t-035") and "d" not in got
    unlimited = {r.msg_id: r.taint_id for r in taint.taint_leaks(sent, tags, max_per_run=None).collect()}
    assert unlimited["a"].startswith("t-000") and unlimited["d"].startswith("t-002") and set(unlimited) == {"a", "c", "d"}
    assert not taint.taint_leaks(sent, tags, allowed_peers=["peer"]).collect()


def test_taint_ttl_and_fingerprints(spark):
    secret = "account number 998877 belongs to the alpha team"
    tags = _tags(spark, [("x", "run", T0, secret)])
    sent = _sent(spark, [("near", "run", T0 + HOUR, "p", "note " + secret), ("late", "run", T0 + 5 * HOUR, "p", "note " + secret)])
    assert {r.msg_id for r in taint.taint_leaks(sent, tags, ttl=2 * HOUR).collect()} == {"near"}
    from tracewarden.functions.text import shingles

    prints = sent.select("msg_id", "agent_run_id", "ts", F.array(shingles(F.col("fields")[0]["value"])).alias("fingerprints"))
    got = {r.msg_id for r in taint.match_fingerprints(prints, taint.register_fingerprints(tags)).collect()}
    assert got == {"near", "late"}


def _stream(spark, tmp_path, df, name, transform, batches=3):
    """Feed rows in time order as several files, run to the end, return the output rows."""
    src = str(tmp_path / name)
    rows = sorted(df.collect(), key=lambda r: (r.ts, r.seq) if "seq" in df.columns else r.ts)
    step = -(-len(rows) // batches)
    for i in range(batches):
        part = spark.createDataFrame(rows[i * step:(i + 1) * step], df.schema)
        part.coalesce(1).write.mode("append").parquet(f"{src}/{i}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(src)
    q = (transform(stream).writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", str(tmp_path / (name + "_cp"))).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.table(name).collect()


def test_stream_peer_risk_equals_batch(spark, tmp_path):
    rows = _peer_rows(120)
    df = spark.createDataFrame(rows, "counterparty string, findings int, action string, severity string, ts timestamp, seq bigint")
    got = {r.seq: round(r.risk_score, 9) for r in _stream(spark, tmp_path, df, "s_peers", live.stream_peer_risk)}
    assert got == {i: round(s, 9) for i, (s, _) in _fold(rows).items()}


def test_stream_tasks_equals_batch(spark, tmp_path):
    rows = _obs(120)
    got = _stream(spark, tmp_path, spark.createDataFrame(rows, _OBS), "s_tasks", live.stream_tasks)
    assert sorted((r.seq, r.rule_id) for r in got if r.seq >= 0) == sorted(_task_fold(rows))


def test_stream_suppress_equals_batch(spark, tmp_path):
    rows = _finding_rows(150)
    df = spark.createDataFrame(rows, "rule_id string, match string, ts timestamp, seq bigint")
    got = {r.seq for r in _stream(spark, tmp_path, df, "s_suppress", live.stream_suppress)}
    assert got == _suppressed(rows, behavior.WINDOW)


def test_stream_quarantine(spark, tmp_path):
    rows = [("b", T0, 1, None, "bad", "r", T0 + 2 * HOUR, 0), ("b", T0 + HOUR, 0, "m1", None, None, None, 1), ("a", T0 + HOUR, 0, "m2", None, None, None, 2), ("b", T0 + 3 * HOUR, 0, "m3", None, None, None, 3)]
    df = spark.createDataFrame(rows, "tool string, ts timestamp, kind int, msg_id string, reason string, rule_id string, expires_at timestamp, seq bigint")
    assert {r.msg_id for r in _stream(spark, tmp_path, df, "s_quarantine", live.stream_quarantine, 2)} == {"m1"}


def test_quarantine_feed_takes_entries_from_listings(spark, tmp_path):
    found = [("r1", "listed badly", "high", "result.tools.1.description")]
    rows = [("l1", T0, "tools/list", "outbound", None, '{"tools":[{"name":"a"},{"name":"b"}]}', found, 0),
            ("m1", T0 + HOUR, "tools/call", "inbound", '{"name":"b"}', None, [], 1), ("m2", T0 + HOUR, "tools/call", "inbound", '{"name":"a"}', None, [], 2)]
    df = spark.createDataFrame(rows, "msg_id string, ts timestamp, method string, direction string, params string, result string, "
                               "findings array<struct<rule_id:string,description:string,severity:string,field:string>>, seq bigint")
    got = _stream(spark, tmp_path, df, "s_feed", lambda s: live.stream_quarantine(live.quarantine_feed(s)), 1)
    assert [(r.tool, r.msg_id, r.reason) for r in got] == [("b", "m1", "listed badly")]


def test_stream_peer_clock_never_runs_back(spark, tmp_path):
    """A late row adds its weight without undoing decay: the gap after it is not counted twice."""
    rows = [("p", 1, "block", "high", T0, 1), ("p", 1, "block", "high", T0 + HOUR, 2), ("p", 1, "allow", "high", T0 + HOUR / 2, 3), ("p", 1, "allow", "low", T0 + HOUR, 4)]
    df = spark.createDataFrame(rows, "counterparty string, findings int, action string, severity string, ts timestamp, seq bigint")
    path = str(tmp_path / "late")
    for i, part in enumerate((rows[:2], rows[2:3], rows[3:])):
        spark.createDataFrame(part, df.schema).coalesce(1).write.parquet(f"{path}/{i}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
    q = live.stream_peer_risk(stream, "2 hours").writeStream.format("memory").queryName("s_late").option(
        "checkpointLocation", str(tmp_path / "late_cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.seq: r.risk_score for r in spark.table("s_late").collect()}
    assert abs(got[4] - got[3] - 0.25) < 1e-9


def test_stream_finding_spikes(spark, tmp_path):
    rows = [(i, T0 + dt.timedelta(seconds=60 * i), "peer", ["r"] if i % 10 == 0 else []) for i in range(100)] + [
        (1000 + i, T0 + dt.timedelta(seconds=60 * 60 + i), "peer", ["r", "r"]) for i in range(60)]
    df = spark.createDataFrame(rows, "seq bigint, ts timestamp, counterparty string, findings array<string>")
    got = _stream(spark, tmp_path, df, "s_find", lambda s: live.stream_finding_spikes(s, factor=1.3))
    assert got and all(r.counterparty == "peer" and r.recent_rate >= 1.3 * r.historical_rate for r in got)


def test_stream_metrics_and_spikes(spark, tmp_path):
    rows = [(i, T0 + dt.timedelta(seconds=60 * i), "allow", "peer", "run", "m") for i in range(100)] + [
        (1000 + i, T0 + dt.timedelta(seconds=60 * 60 + i), "block", "peer", "run", "m") for i in range(60)]
    df = spark.createDataFrame(rows, "seq bigint, ts timestamp, action string, counterparty string, agent_run_id string, method string").withColumn(
        "findings", F.expr("array(named_struct('rule_id', 'r'))"))
    got = _stream(spark, tmp_path, df, "s_metrics", lambda s: live.stream_metrics(s, "10 minutes"))
    assert got and all(r.total == r.allowed + r.warned + r.blocked for r in got)
    spikes = _stream(spark, tmp_path, df, "s_spikes", live.stream_spikes)
    assert any(r.bucket_key == "peer:peer" and r.ratio >= 3 for r in spikes)
