import datetime as dt
import json

from pyspark.sql import functions as F

from tracewarden.plans.evaluate import evaluate_mcp
from tracewarden.sources.rules import complete_rules
from tracewarden.streaming import live

T0 = dt.datetime(2024, 1, 1)
SECRET = "account number 998877 belongs to the alpha team"


def test_stream_taint(spark, tmp_path):
    results = spark.createDataFrame([("run", T0, "t1", SECRET), ("run", T0 + dt.timedelta(minutes=1), "t2", SECRET)],
                                    "agent_run_id string, ts timestamp, taint_id string, value string")
    sent = spark.createDataFrame([("m1", "run", T0 + dt.timedelta(minutes=5), "x " + SECRET), ("m2", "other", T0 + dt.timedelta(minutes=5), SECRET),
                                  ("m3", "run", T0 + dt.timedelta(hours=9), SECRET)], "msg_id string, agent_run_id string, ts timestamp, value string")
    sent = sent.select("msg_id", "agent_run_id", "ts", F.array(F.struct(F.lit("params.text").alias("name"), F.col("value").alias("value"))).alias("fields"))
    for df, name in ((results, "r"), (sent, "s")):
        df.coalesce(1).write.parquet(str(tmp_path / name))
    read = lambda df, name: spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
    hits = live.stream_taint(read(results, "r"), read(sent, "s"))
    q = hits.writeStream.foreachBatch(live.batch_writer(str(tmp_path / "out"), live.first_leak)).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.msg_id, r.taint_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("m1", "t1")}


def test_every_tag_has_its_own_ttl(spark, tmp_path):
    """A value tagged at 0:00 and 0:09 still leaks at 2:05, also when the later tag arrives first."""
    rows = [("run", T0 + dt.timedelta(minutes=9), "t2", SECRET), ("run", T0, "t1", SECRET)]
    results = spark.createDataFrame(rows, "agent_run_id string, ts timestamp, taint_id string, value string")
    sent = spark.createDataFrame([("m1", "run", T0 + dt.timedelta(minutes=125), SECRET)], "msg_id string, agent_run_id string, ts timestamp, value string")
    sent = sent.select("msg_id", "agent_run_id", "ts", F.array(F.struct(F.lit("params.text").alias("name"), F.col("value").alias("value"))).alias("fields"))
    for df, name in ((results, "r"), (sent, "s")):
        df.coalesce(1).write.parquet(str(tmp_path / name))
    read = lambda df, name: spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
    q = live.stream_taint(read(results, "r"), read(sent, "s")).writeStream.foreachBatch(
        live.batch_writer(str(tmp_path / "out"), live.first_leak)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.msg_id, r.taint_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("m1", "t2")}


def test_stream_evaluate_feed_and_siem(spark, tmp_path):
    rows = [{"seq": i, "msg_id": str(i), "method": "tools/call", "direction": "outbound", "severity": "high" if i % 2 else "low", "ts": "2024-01-01T00:00:00Z",
             "fields": [{"name": "result.text", "value": "bad" if i % 3 == 0 else "fine"}], "source": "a", "destination": "b"} for i in range(1, 10)]
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text("\n".join(map(json.dumps, rows)))
    schema = ("seq bigint, msg_id string, method string, direction string, severity string, ts timestamp, fields array<struct<name:string,value:string>>, "
              "source string, destination string")
    from pyspark.sql.types import StructType

    feed = live.stream_feed(spark, str(src), StructType.fromDDL(schema), since_seq=3)
    rules = complete_rules([{"id": "x", "patterns": ["bad"], "mode": "block", "severity": "high"}])
    q = live.stream_evaluate(feed, str(tmp_path / "out"), evaluate_mcp, lambda: rules, lambda: None, classifier=False).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.seq: r.action for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {i: "block" if i % 3 == 0 else "allow" for i in range(4, 10)}
    q = live.stream_siem(feed, str(tmp_path / "siem"), str(tmp_path / "cp2"), "high", kind="hec").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {json.loads(r.value)["event"]["seq"] for r in spark.read.text(str(tmp_path / "siem")).collect()} == {5, 7, 9}
