import datetime as dt
import json
import os

from pyspark.sql import functions as F

from tracewarden.operators import ledger
from tracewarden.sources import retention
from tracewarden.streaming import late

T0 = dt.datetime(2024, 1, 1)


def _doubled(df):
    return df.select("n", (F.col("n") * 2).alias("twice"))


def _frame(spark, rows):
    return spark.createDataFrame([(n, None if m is None else T0 + dt.timedelta(minutes=m)) for n, m in rows], "n int, ts timestamp")


def test_late_rows_land_once_also_after_a_replay(spark, tmp_path):
    out, side = str(tmp_path / "out"), str(tmp_path / "late")
    write = late.late_split(out, side, _doubled)
    batches = [_frame(spark, rows) for rows in ([(1, 0), (2, 60)], [(3, 49), (4, 50), (5, 51), (6, None), (7, 100)], [], [(8, 89), (9, 91), (10, 95), (10, 95)])]
    batches[2] = _frame(spark, [(0, 0)]).where("false")
    for i, b in enumerate(batches):
        write(b, i)
    assert sorted(r.n for r in spark.read.parquet(side).collect()) == [3, 4, 8]
    write(batches[1], 1)  # replays: of the last batch, and of one before it
    write(batches[3], 3)
    assert sorted(r.n for r in spark.read.parquet(side).collect()) == [3, 4, 8]
    want = sorted((r.n, r.twice) for b in batches for r in _doubled(b).collect())
    assert sorted((r.n, r.twice) for r in late.with_late(spark, out, side, _doubled).collect()) == want


def test_a_stateful_query_drops_only_rows_of_the_side_table(spark, tmp_path):
    """Over the same files a watermarked operator drops late rows at most; it keeps every row in time."""
    src = tmp_path / "src"
    src.mkdir()
    parts = [[(i, 3 * i) for i in range(20)], [(20 + i, 45 + i) for i in range(6)] + [(30, 200)], [(31 + i, 186 + i) for i in range(10)]]
    for k, part in enumerate(parts):
        file = src / f"{k}.json"
        file.write_text("\n".join(json.dumps({"n": n, "ts": (T0 + dt.timedelta(minutes=m)).isoformat() + "Z"}) for n, m in part))
        os.utime(file, (1_700_000_000 + 10 * k, 1_700_000_000 + 10 * k))  # a file's time is its place in the stream
    feed = spark.readStream.schema("n int, ts timestamp").option("maxFilesPerTrigger", 1).json(str(src))
    out, side = str(tmp_path / "out"), str(tmp_path / "late")
    feed.writeStream.foreachBatch(late.late_split(out, side, _doubled)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(r.n for r in spark.read.parquet(side).collect())
    assert got == [20, 21, 22, 31, 32, 33, 34, 35]
    deduped = feed.withWatermark("ts", "10 minutes").dropDuplicatesWithinWatermark(["n"])
    deduped.writeStream.format("parquet").option("path", str(tmp_path / "kept")).option("checkpointLocation", str(tmp_path / "cp2")).trigger(
        availableNow=True).start().awaitTermination()
    kept = {r.n for r in spark.read.parquet(str(tmp_path / "kept")).collect()}
    in_time = {r.n for r in spark.read.parquet(out).collect()}
    assert in_time <= kept and in_time | set(got) == set(range(26)) | {30} | set(range(31, 41)) and not in_time & set(got)


def _ledger(spark):
    rows = [(c, i, f"2024-01-{1 + i // 4:02d}", f'{{"n":{i}}}', T0 + dt.timedelta(hours=6 * i)) for i in range(1, 25) for c in ("a", "b")]
    rows += [("old", i, "x", "{}", T0 + dt.timedelta(hours=i)) for i in range(1, 5)]
    return ledger.chain_ledger(spark.createDataFrame(rows, "chain_id string, seq long, ingest_at string, event_json string, ts timestamp"), ["chain_id"])


def _files(path, day):
    folder = f"{path}/{retention.DAY}={day}"
    return {f: os.stat(f"{folder}/{f}").st_mtime_ns for f in os.listdir(folder) if f.endswith(".parquet")} if os.path.isdir(folder) else None


def test_retention_deletes_days_and_keeps_the_chains_starts(spark, tmp_path):
    path, starts = str(tmp_path / "ledger"), str(tmp_path / "starts")
    whole = _ledger(spark)
    retention.write_by_day(whole, path)
    cutoff = T0 + dt.timedelta(days=3, hours=7)
    untouched = _files(path, "2024-01-06")
    border = _files(path, "2024-01-04")
    retention.drop_before(spark, path, starts, cutoff, ["chain_id"])
    left = spark.read.parquet(path).drop(retention.DAY)
    key = lambda r: (r["chain_id"], r["seq"], r["hash"])
    assert sorted(map(key, left.collect())) == sorted(map(key, whole.where(F.col("ts") >= F.lit(cutoff)).collect()))
    assert _files(path, "2024-01-03") is None and _files(path, "2024-01-06") == untouched and _files(path, "2024-01-04") != border
    saved = retention.saved_starts(spark, starts)
    checked = retention.verify_retained(left, ["chain_id"], saved).collect()
    assert {(r.chain_id, r.ok) for r in checked} == {("a", True), ("b", True)}
    ends = {r.chain_id: (r.last_seq + 1, r.head_hash) for r in ledger.chain_heads(whole, ["chain_id"]).collect()}
    got = {r.chain_id: (r.first_seq, r.start_hash) for r in saved.collect()}
    assert got["old"] == ends["old"] and got["a"][0] == 14
    # a record lost at the start is told from retention
    short = retention.verify_retained(left.where("NOT (chain_id = 'a' AND seq = 14)"), ["chain_id"], saved).where("NOT ok").collect()
    assert [(r.chain_id, r.bad_seq, r.reason) for r in short] == [("a", 14, "chain start mismatch")]
    n = left.count()
    # the same run again changes nothing, a later one goes on from here and still knows the chain that is gone
    retention.drop_before(spark, path, starts, cutoff, ["chain_id"])
    assert spark.read.parquet(path).count() == n
    retention.drop_before(spark, path, starts, T0 + dt.timedelta(days=5), ["chain_id"])
    after = spark.read.parquet(path)
    assert after.agg(F.min("ts")).first()[0] == T0 + dt.timedelta(days=5)
    saved = retention.saved_starts(spark, starts)
    assert all(r.ok for r in retention.verify_retained(after, ["chain_id"], saved).collect())
    assert {r.chain_id: (r.first_seq, r.start_hash) for r in saved.collect()}["old"] == ends["old"]
