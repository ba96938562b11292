"""Ledger files and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RECORD = "seq bigint, ingest_at string, prev_hash string, hash string, event string, _bad string"


class CorruptLedgerError(ValueError):
    """A ledger line that is not a record."""


def parse_records(lines: DataFrame) -> DataFrame:
    """Record columns of NDJSON lines; ``event_json`` is cut from the line so its bytes stay as written."""
    r = F.from_json("value", _RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.where(F.trim("value") != "").withColumn("_r", r)
    body = F.regexp_extract("value", r'(?s)"event":(.*)\}\s*\z', 1)
    return rows.select(
        "_r.seq", "_r.ingest_at", "_r.prev_hash", "_r.hash", body.alias("event_json"),
        (F.col("_r").isNull() | F.col("_r._bad").isNotNull() | F.col("_r.seq").isNull()).alias("corrupt"),
        F.col("value").alias("line"))


def read_ledger(spark: SparkSession, path: str, corrupt: str = "raise") -> DataFrame:
    """Ledger rows of NDJSON files. ``corrupt``: raise (whatever columns are read), skip or keep."""
    rows = parse_records(spark.read.text(path))
    if corrupt == "skip":
        return rows.where(~F.col("corrupt")).drop("corrupt")
    if corrupt == "keep":
        return rows
    # a filter that raises: no choice of columns can prune it away
    broken = F.raise_error(F.concat(F.lit("corrupt ledger record: "), F.left("line", F.lit(80)))).cast("boolean")
    return rows.where(F.when(F.col("corrupt"), broken).otherwise(F.lit(True))).drop("corrupt")


def read_events_jdbc(spark: SparkSession, url: str, table: str = "events", lower: int = 0, upper: int = 1_000_000,
                     partitions: int = 64, **options: str) -> DataFrame:
    """Ledger table of a database, read in ranges of ``seq``; filters on its indexed columns are pushed down."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn="seq", lowerBound=str(lower), upperBound=str(upper),
        numPartitions=str(partitions), **options)
    return reader.load()


def write_ledger(ledger: DataFrame, path: str, mode: str = "append") -> None:
    """NDJSON records with the field order that ``read_ledger`` relies on (event last)."""
    line = F.concat(
        F.lit('{"seq":'), F.col("seq").cast("string"), F.lit(',"ingest_at":"'), F.col("ingest_at"),
        F.lit('","prev_hash":"'), F.col("prev_hash"), F.lit('","hash":"'), F.col("hash"),
        F.lit('","event":'), F.col("event_json"), F.lit("}"))
    ledger.select(line.alias("value")).write.mode(mode).text(path)
