"""A ledger on disk by day of arrival, and retention that removes what is older."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.operators.ledger import verify_chain

DAY = "ingest_day"


def write_by_day(ledger: DataFrame, path: str, ts: str = "ts", mode: str = "append") -> None:
    """Write the ledger below ``path`` in one folder per day of ``ts``; a day of any size is cut into ranges of ``seq``."""
    days = ledger.withColumn(DAY, F.to_date(ts))
    days.repartitionByRange(DAY, "seq").write.partitionBy(DAY).mode(mode).parquet(path)


def chain_starts(ledger: DataFrame, cutoff: dt.datetime, chain: list[str], ts: str = "ts") -> DataFrame:
    """Where each chain starts once everything before ``cutoff`` is gone: ``first_seq`` and ``start_hash``.

    A chain without newer records starts behind its last one. ``ts`` is the time of arrival, which does not fall along a chain.
    """
    kept = F.col(ts) >= F.lit(cutoff)
    return ledger.groupBy(*chain).agg(
        F.coalesce(F.min(F.when(kept, F.col("seq"))), F.max("seq") + 1).alias("first_seq"),
        F.coalesce(F.min_by("prev_hash", F.when(kept, F.col("seq"))), F.max_by("hash", "seq")).alias("start_hash"))


def _done(spark: SparkSession, path: str) -> bool:
    fs, where = _folder(spark, f"{path}/_SUCCESS")
    return fs.exists(where)


def _latest(starts: DataFrame, chain: list[str]) -> DataFrame:
    return starts.groupBy(*chain).agg(F.max("first_seq").alias("first_seq"), F.max_by("start_hash", "first_seq").alias("start_hash"))


def drop_before(spark: SparkSession, path: str, starts: str, cutoff: dt.datetime, chain: list[str], ts: str = "ts") -> None:
    """Remove what arrived before ``cutoff`` from a ledger that ``write_by_day`` wrote; the chains' new starts are kept below ``starts``.

    The starts are saved first, then the day of the cutoff is written anew, by way of a copy of what stays of it, then older days are deleted. Other
    days are not read but for the starts, and not touched. Each step gives the same when it is repeated, so a run that was cut off is run again with
    the same cutoff. Rows without a time stay.
    """
    ledger = spark.read.parquet(path)
    day = cutoff.date()
    name = f"t{cutoff:%Y%m%dT%H%M%S%f}"
    if not _done(spark, f"{starts}/at={name}"):
        found = chain_starts(ledger, cutoff, chain, ts)
        try:  # chains of which nothing is left keep the start they have
            earlier = spark.read.parquet(starts).where(F.col("at") != name)
            found = _latest(found.unionByName(earlier.select(*found.columns)), chain)
        except AnalysisException:
            pass  # the first retention run of this ledger
        found.write.mode("overwrite").parquet(f"{starts}/at={name}")
    staged = f"{path.rstrip('/')}_border/{name}"
    if not _done(spark, staged):
        ledger.where((F.col(DAY) == F.lit(day)) & (F.col(ts) >= F.lit(cutoff))).write.mode("overwrite").parquet(staged)
    stays = spark.read.schema(ledger.schema).parquet(staged)
    if stays.isEmpty():
        _remove(spark, f"{path}/{DAY}={day}")
    else:
        stays.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)
    for old in _days(spark, path):
        if old < day.isoformat():
            _remove(spark, f"{path}/{DAY}={old}")
    _remove(spark, staged)


def saved_starts(spark: SparkSession, starts: str) -> DataFrame:
    """The latest start of every chain after all retention runs."""
    rows = spark.read.parquet(starts)
    return _latest(rows, [c for c in rows.columns if c not in ("first_seq", "start_hash", "at")])


def verify_retained(ledger: DataFrame, chain: list[str], starts: DataFrame) -> DataFrame:
    """``verify_chain`` of what is left, with the first record of each chain held against the saved start. Chains without a saved start begin at theirs."""
    checked = verify_chain(ledger, chain, None)
    first = ledger.groupBy(*chain).agg(F.min("seq").alias("_seq"), F.min_by("prev_hash", "seq").alias("_prev"))
    known = starts.select(*chain, F.col("first_seq").alias("_first"), F.col("start_hash").alias("_start"))
    cut = F.col("_first").isNotNull() & ((F.col("_seq") != F.col("_first")) | (F.col("_prev") != F.col("_start")))
    return checked.join(first, chain, "left").join(known, chain, "left").select(
        *chain, "records", (F.col("ok") & ~F.coalesce(cut, F.lit(False))).alias("ok"),
        F.when(cut, F.col("_first")).otherwise(F.col("bad_seq")).alias("bad_seq"),
        F.when(cut, F.lit("chain start mismatch")).otherwise(F.col("reason")).alias("reason"))


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _days(spark: SparkSession, path: str) -> list[str]:
    """Days that have a folder; one name per day, whatever the rows."""
    fs, where = _folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{DAY}=") and not n.endswith("__HIVE_DEFAULT_PARTITION__"))


def _remove(spark: SparkSession, path: str) -> None:
    fs, where = _folder(spark, path)
    fs.delete(where, True)
