import datetime as dt
import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from tracewarden.operators import cards, envelope, judge, ledger, merkle, policy
from tracewarden.operators import queries as lookups
from tracewarden.sources import exports, traffic
from tracewarden.sources.ledger import read_ledger, write_ledger

T0 = dt.datetime(2024, 1, 1)


def _chain(spark, n=40):
    rows = spark.range(1, n + 1).select(F.col("id").alias("seq"), F.lit("c").alias("chain_id"), F.lit("2024-01-01T00:00:00Z").alias("ingest_at"),
                                        F.concat(F.lit('{"n":'), F.col("id").cast("string"), F.lit("}")).alias("event_json"))
    return ledger.chain_ledger(rows, ["chain_id"])


def test_chain_matches_plain_hashing_and_round_trips(spark, tmp_path):
    led = _chain(spark)
    prev = "0" * 64
    for r in led.orderBy("seq").collect():
        assert r.prev_hash == prev
        prev = hashlib.sha256(f"{r.seq}\n{r.ingest_at}\n{prev}\n{r.event_json}".encode()).hexdigest()
        assert r.hash == prev
    write_ledger(led, str(tmp_path / "l"))
    back = read_ledger(spark, str(tmp_path / "l")).withColumn("chain_id", F.lit("c"))
    assert ledger.verify_chain(back, ["chain_id"]).first().ok


@pytest.mark.parametrize("seq", [1, 17, 40])
def test_any_edit_is_found(spark, seq):
    led = _chain(spark)
    edited = led.withColumn("event_json", F.when(F.col("seq") == seq, F.lit('{"n":0}')).otherwise(F.col("event_json")))
    row = ledger.verify_chain(edited, ["chain_id"]).first()
    assert (row.ok, row.bad_seq, row.reason) == (False, seq, "record hash mismatch")


def test_cut_and_gap(spark):
    led = _chain(spark)
    heads = ledger.chain_heads(led, ["chain_id"])
    tail = ledger.verify_chain(led.where("seq < 38"), ["chain_id"], saved_heads=heads).first()
    assert (tail.ok, tail.bad_seq) == (False, 38)
    gap = ledger.verify_chain(led.where("seq <> 20"), ["chain_id"]).first()
    assert (gap.bad_seq, gap.reason) == (21, "hash chain broken")
    kept = led.where("seq >= 10")
    assert ledger.verify_chain(kept, ["chain_id"], start_hash=None).first().ok


def test_corrupt_lines(spark, tmp_path):
    (tmp_path / "x.ndjson").write_text('{"seq":1,"ingest_at":"t","prev_hash":"p","hash":"h","event":{"a": 1}}\n\nnot a record\n')
    assert read_ledger(spark, str(tmp_path), "skip").first().event_json == '{"a": 1}'
    with pytest.raises(Exception, match="corrupt ledger record"):
        read_ledger(spark, str(tmp_path)).collect()


def _tree(leaves):
    level = [bytes.fromhex(x) for x in leaves]
    while len(level) > 1:
        if len(level) % 2:
            level.append(level[-1])
        level = [hashlib.sha256(level[i] + level[i + 1]).digest() for i in range(0, len(level), 2)]
    return level[0].hex()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 1024, 1025, 2500])
def test_merkle_root(spark, n):
    leaves = spark.range(n).select(F.col("id").alias("idx"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    want = _tree([hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)])
    assert merkle.merkle_root(leaves).first().merkle_root == want


def test_merkle_proofs(spark):
    leaves = spark.range(1500).select(F.col("id").alias("idx"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    root = merkle.merkle_root(leaves).first().merkle_root
    wanted = leaves.where("idx in (0, 1, 1023, 1024, 1499)")
    proofs = merkle.verify_proofs(merkle.merkle_proof(leaves, wanted), root).collect()
    assert len(proofs) == 5 and all(p.valid for p in proofs)
    bad = merkle.verify_proofs(merkle.merkle_proof(leaves, wanted).withColumn("leaf", F.sha2(F.lit("x"), 256)), root)
    assert not bad.where("valid").count()
    assert merkle.merkle_root(leaves.where("idx < 0")).first().merkle_root == hashlib.sha256(b"").hexdigest()


def test_merkle_proofs_of_all_leaves_join_paths_only(spark):
    """Three rounds' worth of shapes: full blocks, a short last block and an odd node; no join holds leaves, so none can be broadcast."""
    leaves = spark.range(2051).select(F.col("id").alias("idx"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    root = merkle.merkle_root(leaves).first().merkle_root
    proofs = merkle.merkle_proof(leaves)
    plan = proofs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "strategy=shuffle_hash" in plan
    found = merkle.verify_proofs(proofs, root).collect()
    assert sorted(p.idx for p in found) == list(range(2051)) and all(p.valid for p in found)
    assert all([x.level for x in p.path] == list(range(12)) for p in found)
    assert {p.idx for p in merkle.merkle_proof(leaves, spark.createDataFrame([(5,), (5,), (2050,), (9999,)], "idx int")).collect()} == {5, 2050}


def test_hmac_and_payloads(spark):
    df = spark.createDataFrame([(1, T0, "high", "x"), (2, T0, "low", "y")], "seq bigint, ts timestamp, severity string, raw string")
    out = exports.siem_payloads(df, "medium", secret="s" * 70).collect()
    assert len(out) == 1
    assert out[0].signature == "sha256=" + hmac.new(b"s" * 70, out[0].body.encode(), "sha256").hexdigest()
    signed = exports.siem_payloads(df, secret="k")
    assert exports.verify_payloads(signed, "k").where("verified").count() == 2
    assert exports.verify_payloads(signed, "").where("verified").count() == 0
    assert exports.verify_payloads(signed.withColumn("body", F.lit("z")), "k").where("verified").count() == 0


def test_ndjson_and_audit_bundle(spark, tmp_path):
    led = _chain(spark).withColumn("ts", F.lit(T0)).withColumn("severity", F.lit("low")).withColumn("tenant_id", F.lit("t"))
    lines = [json.loads(r.value) for r in exports.export_ndjson(led, "head", "now", limit=5).collect()]
    assert [x["seq"] for x in lines[:-1]] == [40, 39, 38, 37, 36] and lines[-1]["record_count"] == 5 and lines[-1]["seq_range"] == [36, 40]
    manifest = exports.audit_bundle(led, str(tmp_path / "b"), "head", "now").first()
    canon = [f'{{"event":{r.event_json},"ingest_at":"{r.ingest_at}","prev_hash":"{r.prev_hash}","seq":{r.seq}}}' for r in led.orderBy("seq").collect()]
    assert manifest.record_count == 40 and manifest.merkle_root == _tree([hashlib.sha256(c.encode()).hexdigest() for c in canon])


def test_envelopes(spark):
    raws = ["", "nope", '{"jsonrpc":"1.0","id":1}', '{"jsonrpc":"2.0","id":7,"method":"tools/call","params":{"name":"t","arguments":{"a":["x",{"b":"y"}],"n":3}}}',
            '{"id":"a","result":{"ok":true,"text":"z"}}', '{"id":1,"error":{"code":-1,"message":"boom"}}', '{"method":"notifications/x","id":3}']
    df = envelope.parse_envelope(spark.createDataFrame([(str(i), r) for i, r in enumerate(raws)], "msg_id string, raw string"))
    rows = envelope.extract_fields(df).withColumn("kind", envelope.message_kind()).withColumn("tool", envelope.tool_name("params")).orderBy("msg_id").collect()
    assert [r.status for r in rows] == ["malformed"] * 3 + ["ok"] * 4
    assert [(f.name, f.value) for f in rows[3].fields] == [("params.arguments.a.0", "x"), ("params.arguments.a.1.b", "y"), ("params.name", "t")]
    assert rows[3].tool == "t" and [r.kind for r in rows[3:]] == ["request", "response", "response", "notification"]
    assert [(f.name, f.value) for f in rows[5].fields] == [("error.message", "boom")]


def test_event_stream_text(spark):
    body = "event: a\ndata: one\ndata: two\n\n: ping\n\nid: 1\r\ndata:three\r\n\r\nretry: 5\n"
    got = traffic.sse_events(spark.createDataFrame([(1, body)], "id int, body string")).collect()
    assert [r.raw for r in got] == ["one\ntwo", "three"]


def test_cards(spark):
    raws = ['{"name":"n","url":"ftp://x","skills":[{"tags":["a",""]}],"provider":{"organization":"o"},"signature":"s"}', '{"description":"d"}', '{"name":" ","version":"1","skills":[{"id":"i"}]}']
    df = cards.validate_card(cards.extract_card_fields(cards.parse_card(spark.createDataFrame([(str(i), r) for i, r in enumerate(raws)], "msg_id string, raw string"))))
    a, b, c = df.orderBy("msg_id").collect()
    assert a.warnings == ["url is not http(s)", "version is empty", "skill[0] has neither id nor name"] and a.signature_present
    assert [f.name for f in a.fields] == ["card.name", "card.url", "card.provider.organization", "card.skills.0.tags.0", "card.skills.0.tags.1"]
    assert (b.status, b.reason) == ("malformed", "card missing name") and c.errors == ["name is empty"]


def test_judge(spark):
    msgs = spark.createDataFrame([("a", [("f1", "x" * 70), ("f2", "y" * 90)], []), ("b", [("f", "z" * 80)], [("c", 0.8)]), ("c", [("f", "short")], [])],
                                 "msg_id string, fields array<struct<name:string,value:string>>, findings array<struct<category:string,confidence:double>>")
    cand = judge.judge_candidates(msgs)
    assert [(r.msg_id, r.field) for r in cand.collect()] == [("a", "f2")]
    assert judge.judge_candidates(msgs, categories=["other"]).count() == 2
    answers = [('```json\n{"verdict":"malicious","confidence":0.9}\n```', None, "judge.layer3"), ('{"verdict":"benign"}', None, None), (None, "timeout", "judge.transport_error"), ("what?", None, "judge.transport_error")]
    for content, error, want in answers:
        v = spark.createDataFrame([("a", content, error)], "msg_id string, content string, error string")
        got = [r.rule_id for r in judge.apply_judge_verdicts(cand, v).collect()]
        assert got == ([want] if want else [])


def test_policy_ties_and_specificity(spark):
    pols = policy.policies_table(spark, [{"id": "a", "mode": "block"}, {"id": "b", "mode": "block"}, {"id": "t", "mode": "warn", "tenant_id": "x"},
                                         {"id": "s", "mode": "monitor", "server_name": "srv", "min_severity": "high"}])
    rows = [(1, "", "", "", "m", []), (2, "x", "", "", "m", []), (3, "x", "", "srv", "m", [("r", "c", "high")]), (4, "x", "", "srv", "m", [("r", "c", "low")])]
    df = spark.createDataFrame(rows, "seq int, tenant_id string, sensor_id string, server_name string, method string, findings array<struct<rule_id:string,category:string,severity:string>>")
    want = [(1, "b"), (2, "t"), (3, "s"), (4, "t")]
    for limit in (1 << 20, -1):
        got = policy.resolve_policy(df.repartition(7, "seq"), pols, "warn", broadcast_bytes=limit).orderBy("seq").collect()
        assert [(r.seq, r.matched_policy.id) for r in got] == want


def test_many_policies_and_shuffled_events(spark):
    """More than a thousand policies over all kinds of scope: broadcast and joined lists agree, row by row."""
    many = [{"id": f"p{i}", "mode": ("monitor", "warn", "block")[i % 3], **({"tenant_id": f"t{i % 5}"} if i & 1 else {}),
             **({"sensor_id": f"s{i % 7}"} if i & 2 else {}), **({"server_name": f"v{i % 3}"} if i & 4 else {}), "enabled": i % 11 > 0,
             **({"methods": ["m"]} if i % 13 == 0 else {}), **({"min_severity": "high"} if i % 4 == 0 else {})} for i in range(1200)]
    pols = policy.policies_table(spark, many)
    rows = [(i, f"t{i % 6}", f"s{i % 8}", f"v{i % 4}", "m" if i % 2 else "n", [("r", "c", ("low", "high")[i % 2])] if i % 3 else []) for i in range(400)]
    df = spark.createDataFrame(rows, "seq int, tenant_id string, sensor_id string, server_name string, method string, findings array<struct<rule_id:string,category:string,severity:string>>")
    answers = [[(r.seq, r.mode, r.matched_policy and r.matched_policy.id) for r in policy.resolve_policy(
        df.repartition(n, "tenant_id"), pols, broadcast_bytes=limit, plan_policies=plan).orderBy("seq").collect()]
        for n, limit, plan in ((1, 1 << 24, 2000), (5, -1, 2000), (3, 1 << 24, 1000))]
    assert answers[0] == answers[1] == answers[2] and len(answers[0]) == 400


def test_limits(spark):
    led = spark.createDataFrame([(i, "x", [], "allow", "m", "t") for i in range(200)], "seq long, severity string, findings array<struct<rule_id:string,category:string,severity:string>>, action string, method string, tenant_id string")
    assert lookups.query_events(led, limit=None).count() == 200 and lookups.query_events(led).count() == 50
    for bad in (0, -1, "5"):
        with pytest.raises(ValueError):
            lookups.query_events(led, limit=bad)


def test_tool_name_is_the_top_level_string(spark):
    docs = ['{"name":"a"}', '{"name":3,"arguments":{"name":"b"}}', '{"arguments":{}}', None, "[1]", "broken"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, params string")
    assert [r[1] for r in df.select("i", envelope.tool_name("params")).orderBy("i").collect()] == ["a", "", "", "", "", ""]


def test_read_traffic_text_keeps_repeated_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text('{"id":1}\n{"id":1}\n\n{"id":2}\n')
    rows = traffic.read_traffic(spark, str(tmp_path), "text").collect()
    assert len(rows) == 3 and len({r.msg_id for r in rows}) == 3


def test_appends_continue_every_chain(spark):
    """Three appends, one of them without rows for a chain and one with a new chain, equal one build."""
    rows = [(c, f"2024-01-01T00:00:{i:02d}Z", f'{{"n":{i},"of":"{c}"}}', i) for i in range(30) for c in ("a", "b", None)]
    df = spark.createDataFrame(rows, "chain_id string, ingest_at string, event_json string, n int")
    whole = ledger.append_ledger(df, ["chain_id"], ["n"])
    heads, parts = None, []
    for low, high, only in ((0, 7, ["a", None]), (7, 8, ["a", None]), (8, 30, ["a", None]), (0, 30, ["b"])):
        new = df.where((F.col("n") >= low) & (F.col("n") < high) & (F.col("chain_id").isin(*[x for x in only if x]) | (F.col("chain_id").isNull() if None in only else F.lit(False))))
        parts.append(ledger.append_ledger(new, ["chain_id"], ["n"], heads))
        heads = ledger.merged_heads(heads, parts[-1], ["chain_id"])
    got = [r for p in parts for r in p.collect()]
    key = lambda r: (r["chain_id"] or "", r["seq"], r["prev_hash"], r["hash"], r["n"])
    assert sorted(map(key, got)) == sorted(map(key, whole.collect()))
    assert sorted(map(str, heads.collect())) == sorted(map(str, ledger.chain_heads(whole, ["chain_id"]).collect()))
    again = ledger.append_ledger(df.where("n < 3"), ["chain_id"], ["n"], heads).select("chain_id", "seq", "prev_hash").where("seq = 31")
    ends = {(r["chain_id"], r["head_hash"]) for r in heads.collect()}
    assert {(r["chain_id"], r["prev_hash"]) for r in again.collect()} == ends
    assert ledger.chain_ledger(whole.where("seq > 10").drop("prev_hash", "hash"), ["chain_id"], heads=ledger.chain_heads(whole.where("seq <= 10"), ["chain_id"])).join(
        whole.select("hash"), "hash").count() == 60


def test_policies_in_force_at_event_time(spark):
    from tracewarden.operators import policy

    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    changes = spark.createDataFrame([
        ("p", "create", at(10), 1, "", "warn", True), ("p", "update", at(20), 2, "t", "block", True), ("p", "update", at(30), 3, "t", "monitor", False),
        ("p", "delete", at(40), 4, "t", "block", True), ("q", "create", at(15), 5, "t", "warn", True), ("q", "update", at(15), 6, "t", "monitor", True)],
        "id string, op string, ts timestamp, seq long, tenant_id string, mode string, enabled boolean")
    versions = policy.policy_versions(changes)
    assert {(r["id"], r["valid_from"], r["valid_to"]) for r in versions.collect()} == {
        ("p", at(10), at(20)), ("p", at(20), at(30)), ("p", at(30), at(40)), ("q", at(15), at(15)), ("q", at(15), None)}
    events = spark.createDataFrame([(m, at(m)) for m in (5, 10, 14, 15, 19, 20, 29, 30, 45)], "m int, ts timestamp").select(
        "*", F.lit("t").alias("tenant_id"), F.lit("").alias("sensor_id"), F.lit("").alias("server_name"), F.lit("x").alias("method"),
        F.array().cast("array<struct<rule_id:string,category:string,severity:string>>").alias("findings"))
    for limit, plan in ((policy.BROADCAST_BYTES, 1000), (-1, 1000), (policy.BROADCAST_BYTES, 0)):
        got = {r["m"]: (r["mode"], r["matched_policy"] and r["matched_policy"]["id"]) for r in policy.resolve_policy(events, versions, "none", limit, plan).collect()}
        assert got == {5: ("none", None), 10: ("warn", "p"), 14: ("warn", "p"), 15: ("monitor", "q"), 19: ("monitor", "q"), 20: ("block", "p"), 29: ("block", "p"),
                       30: ("monitor", "q"), 45: ("monitor", "q")}
