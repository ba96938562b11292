"""Rows that come too late for a stream go to a side table instead of being lost."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BOUND = T.StructType([T.StructField("bound", T.TimestampType())])


def _bound_before(spark: SparkSession, folder: str, batch_id: int):
    """Event time up to which rows of this batch are late: the bound that the batch before it left behind."""
    if batch_id == 0:
        return None
    try:
        left = spark.read.schema(_BOUND).parquet(f"{folder}/batch_id={batch_id - 1}")
    except AnalysisException:
        try:
            left = spark.read.schema(_BOUND).parquet(folder).where(F.col("batch_id") < batch_id)
        except AnalysisException:
            return None
    return left.agg(F.max("bound")).first()[0]


def is_late(ts: Column, bound) -> Column:
    """At or behind the bound. Rows without a time are never late."""
    return F.lit(False) if bound is None else F.coalesce(ts <= F.lit(bound), F.lit(False))


def late_split(out: str, late_out: str, fn: Callable[[DataFrame], DataFrame], delay: str = "10 minutes", ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """foreachBatch function: ``fn`` of the rows in time goes to ``out``, late rows go to ``late_out`` as they came.

    The bound of a batch is the largest event time of all batches before it less ``delay`` (whole milliseconds). A stateful query over the same
    batches with the same delay drops rows by the watermark of a batch earlier, so it drops none that is not in ``late_out``, and may still count some
    that are. Every batch leaves its bound
    below ``late_out``; a batch reads only what earlier ones left, and all three tables are written per batch id, so a replayed batch splits its
    rows as before and overwrites itself. No row is in both tables, and none is in neither.
    """
    bounds = f"{late_out.rstrip('/')}_bounds"

    def write(batch: DataFrame, batch_id: int) -> None:
        before = _bound_before(batch.sparkSession, bounds, batch_id)
        late = is_late(F.col(ts), before)
        fn(batch.where(~late)).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        batch.where(late).write.mode("overwrite").parquet(f"{late_out}/batch_id={batch_id}")
        reached = F.date_trunc("MILLISECOND", F.max(ts)) - F.expr(f"INTERVAL {delay}")
        batch.agg(F.greatest(reached, F.lit(before).cast("timestamp")).alias("bound")).coalesce(1).write.mode("overwrite").parquet(
            f"{bounds}/batch_id={batch_id}")

    return write


def with_late(spark: SparkSession, out: str, late_out: str, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The answer over all rows, for a ``fn`` that decides row by row: what the stream wrote, and ``fn`` of the late rows."""
    written = spark.read.parquet(out).drop("batch_id")
    return written.unionByName(fn(spark.read.parquet(late_out).drop("batch_id")))
