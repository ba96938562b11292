"""Hash-chained ledger: building, checking and canonical records."""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden.schema import GENESIS_HASH


def record_hash(seq: Column, ingest_at: Column, prev_hash: Column, event_json: Column) -> Column:
    return F.sha2(F.concat_ws("\n", seq.cast("string"), ingest_at, prev_hash, event_json), 256)


def rfc3339(ts: Column | str) -> Column:
    """UTC time as text with trailing zeros of the fraction removed."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(
        F.regexp_replace(text, r"(\.[0-9]*?)0+\z", "$1"), r"\.\z", ""), F.lit("Z"))


def segment_of(seq: Column | str, rows: int) -> Column:
    seq = F.col(seq) if isinstance(seq, str) else seq
    return F.floor((seq - 1) / rows).cast("bigint")


def _same(left: DataFrame, right: DataFrame, chain: list[str]) -> Column:
    return functools.reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[f"_on_{c}"]) for c in chain])


def _with_heads(events: DataFrame, chain: list[str], heads: DataFrame) -> DataFrame:
    """Events with ``_last`` and ``_start``, the sequence number and hash that their chain has reached; null for new chains."""
    known = heads.select(*[F.col(c).alias(f"_on_{c}") for c in chain], F.col("last_seq").alias("_last"), F.col("head_hash").alias("_start"))
    return events.join(known, _same(events, known, chain), "left").select(*[events[c] for c in events.columns], "_last", "_start")


def append_ledger(events: DataFrame, chain: list[str], order: list[str], heads: DataFrame | None = None, start_hash: str = GENESIS_HASH) -> DataFrame:
    """Number and chain new ``ingest_at, event_json`` rows behind the ``heads`` (``chain_heads``) of an existing ledger.

    A chain continues with the number after its head and the head's hash; one without a head starts at 1 from ``start_hash``. ``order`` must tell
    a chain's rows apart, so that a repeated append gives the same records. A chain's rows meet in one task, as its hashes are sequential anyway.
    """
    if heads is None:
        rows = events.select("*", F.lit(0).cast("bigint").alias("_last"), F.lit(None).cast("string").alias("_start"))
    else:
        rows = _with_heads(events, chain, heads)
    place = F.row_number().over(Window.partitionBy(*chain).orderBy(*order))
    rows = rows.withColumn("seq", F.coalesce("_last", F.lit(0)).cast("bigint") + place)
    return _linked(rows.drop("_last"), chain, start_hash)


def merged_heads(heads: DataFrame | None, appended: DataFrame, chain: list[str]) -> DataFrame:
    """The heads after an append: chains without new records keep theirs."""
    new = chain_heads(appended, chain)
    if heads is None:
        return new
    both = heads.select(*new.columns).unionByName(new)
    return both.groupBy(*chain).agg(F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"), F.max_by("head_hash", "last_seq").alias("head_hash"))


def chain_ledger(events: DataFrame, chain: list[str], start_hash: str = GENESIS_HASH, heads: DataFrame | None = None) -> DataFrame:
    """Add ``prev_hash`` and ``hash`` to ``seq, ingest_at, event_json`` rows, chained in seq order.

    Hash chaining is sequential, so parallelism comes from the chain key: a tenant and day, or a
    fixed-length segment of the sequence (``segment_of``), keeps every chain bounded. A constant
    key gives one single chain. Rows of a partition are streamed in order; nothing is collected. ``heads`` (``chain_heads``) are
    the records that the chains of ``events`` continue.
    """
    start = F.lit(None).cast("string").alias("_start")
    return _linked(events.select("*", start) if heads is None else _with_heads(events, chain, heads).drop("_last"), chain, start_hash)


def _linked(events: DataFrame, chain: list[str], start_hash: str) -> DataFrame:
    """Add the hashes to rows that bring ``_start``, the hash their chain continues, or null."""
    names = [c for c in events.columns if c != "_start"]
    fields = [*events.select(*names).schema.fields, T.StructField("prev_hash", T.StringType()), T.StructField("hash", T.StringType())]

    def link(batches):
        key, prev = None, start_hash
        for batch in batches:
            prevs, hashes = [], []
            cols = {n: batch.column(i) for i, n in enumerate([*names, "_start"])}
            keys = list(zip(*[cols[c].to_pylist() for c in chain]))
            rows = zip(keys, cols["seq"].to_pylist(), cols["ingest_at"].to_pylist(), cols["event_json"].to_pylist(), cols["_start"].to_pylist())
            for k, seq, at, event, start in rows:
                if k != key:
                    key, prev = k, start or start_hash
                prevs.append(prev)
                prev = hashlib.sha256(f"{seq}\n{at}\n{prev}\n{event}".encode()).hexdigest()
                hashes.append(prev)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(prevs, pa.string()), pa.array(hashes, pa.string())],
                names=[*names, "prev_hash", "hash"])

    return events.select(*names, "_start").repartition(*chain).sortWithinPartitions(*chain, "seq").mapInArrow(link, T.StructType(fields))


def chain_heads(ledger: DataFrame, chain: list[str]) -> DataFrame:
    """Last seq and hash of every chain; chaining these rows ties bounded segments together."""
    return ledger.groupBy(*chain).agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max_by("hash", "seq").alias("head_hash"))


def check_links(ledger: DataFrame, chain: list[str], start_hash: str | None = GENESIS_HASH) -> DataFrame:
    """Every broken record with its reason.

    The predecessor comes from an equi-join on (chain, seq), not from a window over the chain, so a
    single huge chain is checked in parallel. ``start_hash=None`` accepts whatever the first
    record of a chain points to (after retention the caller compares it with the saved start).
    """
    ok_hash = F.col("hash") == record_hash(F.col("seq"), F.col("ingest_at"), F.col("prev_hash"), F.col("event_json"))
    rows = ledger.select(*chain, "seq", "prev_hash", "hash", ok_hash.alias("_ok"))
    before = ledger.select(*chain, (F.col("seq") + 1).alias("seq"), F.col("hash").alias("_before"))
    first = ledger.groupBy(*chain).agg(F.min("seq").alias("_first"))
    joined = rows.join(before, [*chain, "seq"], "left").join(first, chain, "left")
    start = F.col("prev_hash") if start_hash is None else F.lit(start_hash)
    expected = F.when(F.col("seq") == F.col("_first"), start).otherwise(F.col("_before"))
    linked = F.coalesce(F.col("prev_hash") == expected, F.lit(False))
    reason = F.when(~linked, F.lit("hash chain broken")).when(
        ~F.coalesce(F.col("_ok"), F.lit(False)), F.lit("record hash mismatch"))
    return joined.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(*chain, "seq", "reason")


def verify_chain(ledger: DataFrame, chain: list[str], start_hash: str | None = GENESIS_HASH,
                 saved_heads: DataFrame | None = None) -> DataFrame:
    """Per chain: ok, number of records, first bad seq and reason.

    With ``saved_heads`` (from ``chain_heads``) a cut-off tail is found too.
    """
    bad = check_links(ledger, chain, start_hash).groupBy(*chain).agg(
        F.min("seq").alias("bad_seq"), F.min_by("reason", "seq").alias("reason"))
    heads = ledger.groupBy(*chain).agg(
        F.count("*").alias("records"), F.max("seq").alias("_last"), F.max_by("hash", "seq").alias("_head"))
    out = heads.join(bad, chain, "left")
    if saved_heads is not None:
        saved = saved_heads.select(*chain, F.col("last_seq").alias("_sl"), F.col("head_hash").alias("_sh"))
        out = out.join(saved, chain, "full")
        short = F.col("_sl").isNotNull() & (
            F.coalesce(F.col("_last") < F.col("_sl"), F.lit(True))
            | ((F.col("_last") == F.col("_sl")) & (F.col("_head") != F.col("_sh"))))
        out = out.withColumn("reason", F.coalesce("reason", F.when(short, F.lit("ledger tail missing"))))
        out = out.withColumn("bad_seq", F.coalesce("bad_seq", F.when(short, F.coalesce("_last", F.lit(0)) + 1)))
    return out.select(
        *chain, F.coalesce("records", F.lit(0)).cast("bigint").alias("records"),
        F.col("reason").isNull().alias("ok"), F.col("bad_seq").cast("bigint").alias("bad_seq"), "reason")


def canonical_records(ledger: DataFrame) -> DataFrame:
    """Add the canonical JSON (sorted keys, event verbatim) and its leaf hash."""
    text = F.concat(
        F.lit('{"event":'), F.col("event_json"), F.lit(',"ingest_at":"'), F.col("ingest_at"),
        F.lit('","prev_hash":"'), F.col("prev_hash"), F.lit('","seq":'), F.col("seq").cast("string"), F.lit("}"))
    return ledger.withColumn("canonical", text).withColumn("leaf_hash", F.sha2(F.col("canonical"), 256))


def dense_index(df: DataFrame, order: str = "seq", partitions: int | None = None) -> DataFrame:
    """Add ``idx`` = 0-based rank by ``order``, without a global window.

    Rows are ranged into blocks of the order column; block sizes are summed (one row per block) and
    added to the rank within the block.
    """
    width = 1 << 16
    rows = df.withColumn("_b", F.floor(F.col(order) / width))
    sizes = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    offsets = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_b").orderBy(order)
    return rows.join(offsets, "_b").withColumn("idx", F.col("_off") + F.row_number().over(inside) - 1).drop("_b", "_off")
