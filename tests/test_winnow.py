"""Kept grams: equal windows keep equal grams, and lineage by them equals lineage by all windows."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewarden.functions import winnow
from tracewarden.functions.text import SHINGLE_WIDTH, byte_windows, canonical_views, shingles
from tracewarden.operators import taint

T0 = dt.datetime(2024, 1, 1)


def windows(b):
    return {b} if 0 < len(b) <= SHINGLE_WIDTH else {b[i:i + SHINGLE_WIDTH] for i in range(len(b) - SHINGLE_WIDTH + 1)} if b else set()


def around(b, p):
    return b if len(b) < SHINGLE_WIDTH else b[max(p - winnow.REACH + 1, 0):p + SHINGLE_WIDTH]


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=80), st.binary(max_size=80), st.binary(min_size=20, max_size=60), st.integers(1, 5))
def test_shared_windows_keep_a_shared_gram(left, right, common, alphabet):
    a, b = (bytes(c % alphabet for c in x) for x in (left + common + right, right + common))
    ka, kb = winnow.kept_positions([a, b])
    seen = lambda t, k: {(t[p:p + winnow.GRAM] if len(t) >= SHINGLE_WIDTH else t): around(t, p) for p in k}
    grams_a, grams_b = {}, {}
    for grams, t, k in ((grams_a, a, ka), (grams_b, b, kb)):
        for p in k:
            grams.setdefault(t[p:p + winnow.GRAM] if len(t) >= SHINGLE_WIDTH else t, set()).update(windows(around(t, p)))
    found = {w for g in grams_a.keys() & grams_b.keys() for w in grams_a[g] & grams_b[g]}
    assert found == windows(a) & windows(b)
    assert set(seen(a, ka)) == set(grams_a)


def test_few_grams_are_kept_and_pieces_do_not_matter(monkeypatch):
    rng = random.Random(1)
    texts = [bytes(rng.randrange(97, 123) for _ in range(n)) for n in (0, 1, 23, 24, 25, 5000, 200_000)]
    whole = winnow.kept_positions(texts)
    assert sum(map(len, whole)) < 0.16 * sum(map(len, texts)) and [len(x) for x in whole[:4]] == [0, 1, 1, 1]
    monkeypatch.setattr(winnow, "PIECE", 100)
    assert all(np.array_equal(a, b) for a, b in zip(whole, winnow.kept_positions(texts)))


def brute_leaks(spark, sent, tags):
    """The first (field, value) by all windows, compared pair by pair."""
    views = lambda df, value, *keep: df.select(*keep, F.explode(canonical_views(F.col(value))).alias("v")).select(*keep, F.explode(byte_windows("v")).alias("w")).collect()
    left = views(sent.select("msg_id", "agent_run_id", "ts", F.posexplode("fields").alias("pos", "f")).select("msg_id", "agent_run_id", "ts", "pos", "f.value").where(
        F.octet_length("value") >= taint.MIN_CANDIDATE), "value", "msg_id", "agent_run_id", "ts", "pos")
    right = views(tags, "value", "agent_run_id", "ts", "taint_id")
    by = {}
    for r in right:
        by.setdefault((r.agent_run_id, r.w), set()).add((r.ts, r.taint_id))
    best = {}
    for r in left:
        for ts, i in by.get((r.agent_run_id, r.w), ()):
            if ts < r.ts:
                best[r.msg_id] = min(best.get(r.msg_id, (r.pos, ts, i)), (r.pos, ts, i))
    return {m: i for m, (_, _, i) in best.items()}


@pytest.fixture(scope="module")
def traffic(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "délta", "ab", "   ", "x" * 30, "the same old line", "日本語"])
    text = lambda n: " ".join(word() for _ in range(n))
    values = [text(rng.randrange(1, 12)) for _ in range(60)] + ["short", "exactly twenty-four bytes", "a" * 24, "", "  ", "a" * 400]
    tags = spark.createDataFrame([(f"r{k % 3}", T0 + dt.timedelta(minutes=k), f"t{k:03d}", "mcp", "tools/call", "tool", "f", v, v) for k, v in enumerate(values)],
                                 "agent_run_id string, ts timestamp, taint_id string, protocol string, method string, tool string, field string, value string, sample string")
    sent = [(f"m{k}", f"r{k % 3}", T0 + dt.timedelta(minutes=k * 2), [(f"p{j}", rng.choice(values) + text(3) if rng.random() < 0.3 else text(6)) for j in range(2)]) for k in range(60)]
    sent += [(f"s{k}", f"r{k % 3}", T0 + dt.timedelta(days=1), [("p", v)]) for k, v in enumerate(values)]
    messages = spark.createDataFrame(sent, "msg_id string, agent_run_id string, ts timestamp, fields array<struct<name:string,value:string>>")
    return messages, tags


def test_lineage_by_grams_is_lineage_by_windows(spark, traffic, monkeypatch):
    messages, tags = traffic
    want = brute_leaks(spark, messages, tags)
    for limit in (taint.PREFILTER_BYTES, 0):
        monkeypatch.setattr(taint, "PREFILTER_BYTES", limit)
        got = {r.msg_id: r.taint_id for r in taint.leak_hits(messages, tags).collect()}
        assert got == want and len(got) > 20


def test_rows_are_a_fifth_at_most(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.lit("r").alias("agent_run_id"), "text").where("text is not null")
    views = docs.select("agent_run_id", F.explode(canonical_views("text")).alias("v"))
    before = views.select(F.sum(F.size(byte_windows("v")))).first()[0]
    assert taint._anchored(docs, "text", "agent_run_id").count() <= before / 5


def nodes_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_payloads_are_decoded_once_and_fingerprints_made_once(spark):
    """Decoding a value and hashing its windows is the costly part: no filter or second reader may repeat it."""
    values = spark.createDataFrame([("r", "a" * 40, T0, "t1")], "agent_run_id string, value string, ts timestamp, taint_id string").repartition(2)
    assert nodes_of(taint._anchored(values, "value", "agent_run_id")).count("unbase64") == 1
    sent = values.select(F.lit("m").alias("msg_id"), "agent_run_id", (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"), F.array(shingles("value")).alias("fingerprints"))
    tags = values.select("*", *[F.lit("").alias(c) for c in ("protocol", "method", "tool", "field", "sample")])
    found = taint.match_fingerprints(sent, taint.register_fingerprints(tags))
    assert nodes_of(found).count("size(array_distinct") == 0 and nodes_of(found).count("nfkc_array_udf") == nodes_of(sent).count("nfkc_array_udf") * 2
    assert [(r.msg_id, r.taint_id) for r in found.collect()] == [("m", "t1")]


def test_fingerprints_are_those_of_the_distinct_windows(spark):
    rows = [("",), ("  short \u2003",), ("ab" * 40,), ("x" * 24,), (" padded on both ends, and é in between\u00a0\n",), (None,)]
    df = spark.createDataFrame(rows, "v string")
    windows_of = F.flatten(F.transform(canonical_views("v"), lambda v: byte_windows(v)))
    for r in df.select("v", shingles("v").alias("f"), F.transform(windows_of, lambda w: F.left(F.sha2(w, 256), F.lit(32))).alias("w")).collect():
        assert r.f == r.w
