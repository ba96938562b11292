"""Captured traffic: message files and event-stream texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewarden.schema import TRAFFIC


def read_traffic(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """TRAFFIC rows. ``text`` takes one raw JSON-RPC message per line and leaves the rest empty.

    ``msg_id`` must be unique, later operators join on it. A text line is named by a hash of its file, its block
    of the file and itself, which is the same in every read; only lines that repeat in a block are counted up.
    """
    if format == "text":
        lines = spark.read.text(path).where(F.trim("value") != "")
        others = [F.lit(None).cast(f.dataType).alias(f.name) for f in TRAFFIC if f.name not in ("msg_id", "raw")]
        name = F.sha2(F.concat_ws("\x1f", "_metadata.file_path", F.col("_metadata.file_block_start").cast("string"), "value"), 256)
        rows = lines.select(name.alias("msg_id"), *others, F.col("value").alias("raw"))
        again = rows.groupBy("msg_id").agg(F.count("*").alias("n")).where("n > 1").select("msg_id")
        nth = F.row_number().over(Window.partitionBy("msg_id").orderBy("raw"))
        repeated = rows.join(again, "msg_id", "left_semi").withColumn("msg_id", F.concat("msg_id", F.lit("-"), nth.cast("string")))
        return rows.join(again, "msg_id", "left_anti").unionByName(repeated)
    reader = spark.read.schema(TRAFFIC)
    if format == "json":
        return reader.option("mode", "PERMISSIVE").json(path)
    return reader.format(format).load(path)


def sse_payloads(text: Column) -> Column:
    """Payload strings of the data events in a captured event stream.

    A blank line ends an event, its ``data:`` lines are joined by a newline, events without data
    are dropped.
    """
    unix = F.regexp_replace(text, "\r\n", "\n")
    events = F.split(unix, r"\n\n+")

    def payload(event: Column) -> Column:
        lines = F.filter(F.split(event, "\n"), lambda x: x.startswith("data:"))
        return F.array_join(F.transform(lines, lambda x: F.trim(F.substring(x, 6, 1 << 30))), "\n")

    return F.filter(F.transform(events, payload), lambda p: p != "")


def sse_events(df: DataFrame, text: str = "body") -> DataFrame:
    """One row per data event, in stream order."""
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(sse_payloads(F.col(text))).alias("event_pos", "raw"))
