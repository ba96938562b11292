"""As-of helpers that never put one key into one task.

A plain window per key sorts all rows of the key in a single task, so a key that holds a
third of the table decides the run time. Here rows are cut into time chunks first: windows
run per (key, chunk), and what earlier chunks contribute is carried over from one summary
row per (key, chunk). The summaries are bounded by the covered time span, not by the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3600.0


def chunk_of(ts: Column | str, seconds: float = HOUR) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(ts) / F.lit(int(seconds * 1_000_000))).cast("bigint")


def carry_last(df: DataFrame, keys: list[str], order: list[str], exprs: dict[str, Column],
               seconds: float = HOUR, chunk: Column | None = None) -> DataFrame:
    """Add, per expression, its last non-null value in strictly earlier rows of the same key.

    ``order`` starts with the timestamp column; keys must not be null.
    """
    return _carry(df, keys, order, exprs, seconds, chunk, last=True)


def carry_first(df: DataFrame, keys: list[str], order: list[str], exprs: dict[str, Column],
                seconds: float = HOUR, chunk: Column | None = None) -> DataFrame:
    """Add, per expression, its first non-null value in strictly earlier rows of the same key."""
    return _carry(df, keys, order, exprs, seconds, chunk, last=False)


def _carry(df, keys, order, exprs, seconds, chunk, last):
    pick = F.max_by if last else F.min_by
    edge = F.last if last else F.first
    position = F.struct(*order)
    rows = df.withColumn("_chunk", chunk_of(order[0], seconds) if chunk is None else chunk)
    for name, expr in exprs.items():
        rows = rows.withColumn(f"_v_{name}", expr)
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)

    summary = rows.groupBy(*keys, "_chunk").agg(*[
        pick(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), position)).alias(f"_s_{n}") for n in exprs])
    carried = summary.select(*keys, "_chunk", *[
        edge(F.col(f"_s_{n}"), ignorenulls=True).over(across).alias(f"_c_{n}") for n in exprs])

    out = rows.select("*", *[
        edge(F.col(f"_v_{n}"), ignorenulls=True).over(local).alias(f"_l_{n}") for n in exprs])
    out = out.join(carried, [*keys, "_chunk"], "left")
    for n in exprs:
        first, second = (f"_l_{n}", f"_c_{n}") if last else (f"_c_{n}", f"_l_{n}")
        out = out.withColumn(n, F.coalesce(F.col(first), F.col(second)))
    return out.select(*df.columns, *exprs)


def running_count(df: DataFrame, keys: list[str], order: list[str], flag: Column, out: str,
                  seconds: float = HOUR) -> DataFrame:
    """Add the number of strictly earlier rows of the same key for which ``flag`` holds."""
    return running_sum(df, keys, order, flag.cast("bigint"), out, seconds)


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str,
                seconds: float = HOUR) -> DataFrame:
    """Add the sum of ``value`` over strictly earlier rows of the same key."""
    rows = df.withColumn("_chunk", chunk_of(order[0], seconds)).withColumn("_one", value.cast("bigint"))
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy(*keys, "_chunk").agg(F.sum("_one").alias("_sum"))
        .select(*keys, "_chunk", F.sum("_sum").over(across).alias("_before"))
    )
    return (
        rows.withColumn("_local", F.sum("_one").over(local))
        .join(carried, [*keys, "_chunk"], "left")
        .withColumn(out, F.coalesce("_local", F.lit(0)) + F.coalesce("_before", F.lit(0)))
        .select(*df.columns, out)
    )


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Is the table at most ``max_rows`` long? Reads no more than that many rows."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Broadcast hint behind a checked size; larger tables keep the shuffle join."""
    return F.broadcast(df) if small_enough(df, max_rows) else df
