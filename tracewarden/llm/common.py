"""Helpers shared by the corpus operators: shared scratch tables, words, bounded broadcasts, round trips."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: what separates words: space, tab, line feed, vertical tab, form feed, carriage return
BLANKS = r"[\x20\x09-\x0D]+"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@functools.cache
def _own_scratch() -> str:
    return tempfile.mkdtemp(prefix="tracewarden-")


def scratch(spark: SparkSession) -> str:
    """A folder all executors share: the one ``spark.checkpoint.dir`` names, an own one in local mode only."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_scratch()


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession):
    """Jobs inside drop their shuffle files when they end, as what they made is in a table then."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared scratch folder and read it: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/tables/{name}-{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``stored`` wrote, once their last reader is done."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character as it is. Plain ASCII texts take the fast way to the same result."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column, between: str = BLANKS) -> Column:
    """All words of a text, which are what stands between the separators; no text has none."""
    return F.coalesce(F.array_remove(F.split(text, between), ""), F.array().cast("array<string>"))


def crc_fold(key: Column, folds: int) -> Column:
    """crc32 of a key's decimal text, modulo ``folds``."""
    return F.crc32(F.encode(key.cast("string"), "UTF-8")) % folds


def broadcast_blocks(table: DataFrame, size: Column, key: Column, block_bytes: int) -> list[DataFrame]:
    """Split a table by ``key`` into parts of about ``block_bytes``, each fit to be broadcast.

    The number of parts follows from the measured size, so what is broadcast at once stays bounded
    for tables of any size; one pass over the other side is made for each part.
    """
    total = table.agg(F.sum(size).alias("b")).first()["b"] or 0
    parts = int(total // block_bytes) + 1
    if parts == 1:
        return [F.broadcast(table)]
    return [F.broadcast(table.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i)) for i in range(parts)]


def broadcast_if_proven(table: DataFrame, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """A broadcast where the counted rows prove a size below ``limit``; larger tables take the shuffle join."""
    return F.broadcast(table) if table.count() * row_bytes <= limit else table


def union_all(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


def by_length(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vector length -> (rows of an Arrow list column, their matrix)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = {}
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        some = column if len(at) == len(size) else column.take(pa.array(at))
        out[int(d)] = at, some.flatten().to_numpy(zero_copy_only=False).reshape(len(at), int(d))
    return out


# -- round trips: chunks of documents ask what the corpus knows about their keys ---------------------

def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0


def chunked(docs: DataFrame, key: str, n_chunks: int) -> DataFrame:
    """Documents dealt to chunks by a hash of their key, so that each run builds the same chunks."""
    return docs.withColumn("chunk", F.pmod(F.xxhash64(F.col(key)), F.lit(n_chunks)).cast("int"))


def bucket_slices(sorted_keys: np.ndarray, n_buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, first, end) of sorted unsigned 64-bit keys; buckets are equal ranges of the key space."""
    step = (1 << 64) // n_buckets + 1
    edges = np.array([step * i for i in range(1, n_buckets)], dtype=np.uint64)
    cuts = np.concatenate([[0], np.searchsorted(sorted_keys, edges), [len(sorted_keys)]])
    return [(b, int(cuts[b]), int(cuts[b + 1])) for b in range(n_buckets) if cuts[b] < cuts[b + 1]]


def planes(numbers: np.ndarray) -> bytes:
    """Numbers as planes of bytes, lowest first: small counts leave planes of zeros, which compress to nothing."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T).tobytes()


def from_planes(packed: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(packed, dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()


def round_trip(asks: DataFrame, answer: Callable[[list[np.ndarray], list[bytes]], list[bytes]], name: str,
               note: Callable[[list[np.ndarray], list[bytes], list[bytes]], bytes] | None = None) -> DataFrame:
    """Answer packed questions: rows (chunk, bucket, keys, vals) become a stored table (chunk, bucket, reply).

    ``answer`` gets the sorted unsigned keys and the values of all chunks for one bucket and returns one
    reply per chunk. Each chunk names a key once, so a key that is everywhere still takes one entry per chunk.
    ``note`` may add one row per bucket, with chunk -1, from keys, values and replies.
    """
    import pyarrow as pa

    def reduce(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k.as_buffer(), dtype=np.uint64) for k in table["keys"]]
        vals = [v.as_py() for v in table["vals"]]
        replies, chunks = answer(keys, vals), table["chunk"].to_pylist()
        if note:
            replies, chunks = [*replies, note(keys, vals, replies)], [*chunks, -1]
        bucket = table["bucket"][0].as_py()
        del keys, vals, table
        pa.default_memory_pool().release_unused()
        return pa.table({"chunk": pa.array(chunks, pa.int32()), "bucket": pa.array([bucket] * len(chunks), pa.int32()),
                         "reply": pa.array(replies, pa.binary())})

    return stored(asks.groupBy("bucket").applyInArrow(reduce, "chunk int, bucket int, reply binary"), name)


def by_bucket(replies) -> list[bytes]:
    """The replies of one chunk in bucket order, which is the order of its sorted keys."""
    order = np.argsort(replies["bucket"].to_numpy())
    column = replies["reply"]
    return [column[int(i)].as_py() for i in order]
