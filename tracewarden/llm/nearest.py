"""Approximate nearest neighbours by inner product, with cross-polytope hashing.

Entries are dealt to ranges of their norm, each ``STEP`` wide, and lifted to one length inside their range (one more component takes up what is missing
to the range's upper edge), so the largest inner product of a range is its smallest angle, and a few long vectors change nothing for the others. A table
turns vectors by three rounds of random signs and a fast Hadamard transform, and its hash is the signed axis nearest to the turned vector. A
query probes the ``probes`` axes nearest to it in each of ``tables`` tables of every range; what it meets there is ranked by exact inner products. Ranges of up to
``FEW`` entries, such as those of exceptionally long vectors, which are near to a query at wide angles too, are met whole.

Equal vectors are one entry that keeps its ``k + 1`` smallest ids, all that any answer can name. Entries and queries of one axis meet in blocks
of bounded size, so a crowded axis is many tasks. A query that met fewer than ``k`` rows, while there are more, is
compared with all entries, again in blocks.

Defined results. Rows whose vector is null, zero or holds a null or non-finite component, and rows with a null id, take no part. An inner product needs vectors of
one length, so vectors of each length are searched among themselves. Repeated rows count once; an id with several vectors is named once, with its largest
score, and never as its own neighbour. Ties go to the smaller id. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_length, stored

BLOCK, FEW = 4096, 256
#: how many norm ranges a factor of two is
STEP = 2


def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v) of distinct rows that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = rows.select(F.col(vec_id).cast("bigint").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return fine.distinct().select("id", "v", F.size("v").alias("d"), norm.alias("norm"))


def _turn(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Three rounds of signs and the fast Hadamard transform along the last axis."""
    n = x.shape[1]
    for s in signs:
        x = x * s
        h = 1
        while h < n:
            x = x.reshape(len(x), n // (2 * h), 2, h)
            x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
            h *= 2
        x /= np.sqrt(n)
    return x


def hashes(v: np.ndarray, top: np.ndarray | None, tables: int, probes: int, seed: int) -> np.ndarray:
    """(rows, tables, probes): the signed axes nearest to each turned vector, nearest first; entries are lifted to the length ``top``, queries are not."""
    n = 1 << int(np.ceil(np.log2(v.shape[1] + 1)))
    x = np.zeros((len(v), n))
    x[:, :v.shape[1]] = v / (np.linalg.norm(v, axis=1) if top is None else top)[:, None]
    if top is not None:
        x[:, v.shape[1]] = np.sqrt(np.maximum(0, 1 - np.square(x).sum(axis=1)))
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, n))
    out = np.empty((len(v), tables, min(probes, n)), dtype=np.int32)
    for t in range(tables):
        y = _turn(x, signs[t])
        best = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :probes]
        out[:, t] = best * 2 + (np.take_along_axis(y, best, 1) < 0)
    return out


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def with_hashes(rows: DataFrame, lift: bool, **how) -> DataFrame:
    """Rows (id, v, ...) with a row for each (table, axis); entries bring ``top``, the length they are lifted to."""
    schema = T.StructType([*rows.schema.fields, T.StructField("axes", T.ArrayType(T.ArrayType(T.IntegerType())))])

    def run(batches):
        for b in batches:
            for at, m in by_length(b.column("v")).values():
                some = b.take(pa.array(at))
                h = hashes(m, some.column("top").to_numpy() if lift else None, **how)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(h.tolist(), pa.list_(pa.list_(pa.int32())))], schema.names)

    spread = rows.mapInArrow(run, schema).select("*", F.posexplode("axes").alias("table", "axis_list"))
    return spread.select(*rows.columns, "table", F.explode("axis_list").alias("axis"))


def _ranked(q: np.ndarray, query_ids: np.ndarray, m: np.ndarray, ids: list[list[int]], k: int) -> tuple[list, list]:
    """For each query its best rows among the entries; products are exact and summed in one order for every pair."""
    names, scores = [], []
    width = np.array([len(x) for x in ids])
    for i in range(0, len(q), 512):
        s = q[i:i + 512] @ m.T
        top = min(k + 1, m.shape[0])
        best = np.argpartition(-s, top - 1, axis=1)[:, :top]
        for j, row in enumerate(best):
            # entries as good as the last one, up to rounding, are kept too, so that ties are settled by id
            row = np.flatnonzero(s[j] >= s[j, row].min() - 1e-9)
            exact = (m[row] * q[i + j]).sum(axis=1)
            of = np.repeat(exact, width[row])
            who = np.array([x for r in row for x in ids[r]], dtype=np.int64)
            mine = who != query_ids[i + j]
            who, of = who[mine], of[mine]
            order = np.lexsort((who, -of))[:k]
            names.append(who[order].tolist())
            scores.append(of[order].tolist())
    return names, scores


def nearest(rows: DataFrame, is_query: Column, k: int = 20, tables: int = 10, probes: int = 32, seed: int = 3,
            vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows that ``is_query`` (over ``id``) picks."""
    fine = stored(usable(rows, vec_id, vector), "vectors")
    facts = {r["d"]: r for r in fine.groupBy("d").agg(F.count_distinct("id").alias("n"), F.max("norm").alias("longest"), F.sum(is_query.cast("long")).alias("q")).collect()}  # a row per length
    if not facts:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    longest = F.create_map(*[F.lit(x) for d, r in facts.items() for x in (d, r["longest"])])[F.col("d")]
    first = Window.partitionBy("v").orderBy("id")
    entries = fine.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1).groupBy("v", "d", "norm").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    band = F.greatest(F.floor(-STEP * F.log2(F.col("norm") / longest)), F.lit(0)).cast("int")
    entries = entries.select(F.element_at("ids", 1).alias("id"), "v", "ids", "d", band.alias("band"), (longest * F.pow(F.lit(2.0), -band / STEP)).alias("top"))
    entries = stored(entries, "entries")
    queries = stored(fine.where(is_query).select("id", "v", "d"), "queries")
    q_blocks = max(r["q"] or 0 for r in facts.values()) // BLOCK + 1
    ranges = entries.groupBy("d", "band").agg((F.count("*") <= FEW).alias("few"))  # a row per length and norm range
    ranges = stored(ranges, "ranges")
    dealt = entries.join(F.broadcast(ranges), ["d", "band"])

    whole = dealt.where("few").select("d", "band", F.lit(-1).alias("table"), F.lit(0).alias("axis"), "id", "v", "ids")
    data = with_hashes(dealt.where("not few").select("id", "v", "ids", "d", "band", "top"), lift=True, tables=tables, probes=1, seed=seed)
    data = stored(data.select("d", "band", "table", "axis", "id", "v", "ids").unionByName(whole), "hashed")
    asked = with_hashes(queries, lift=False, tables=tables, probes=probes, seed=seed)
    asked = asked.join(F.broadcast(ranges.where("not few").select("d", "band")), "d").select("d", "band", "table", "axis", "id", "v").unionByName(
        queries.join(F.broadcast(ranges.where("few").select("d", "band")), "d").select("d", "band", F.lit(-1).alias("table"), F.lit(0).alias("axis"), "id", "v"))
    # an axis with many entries is cut into blocks, and its queries go to each of them; blocks of the query set are part of the key
    keys = ["d", "band", "table", "axis"]
    blocks = data.groupBy(*keys).agg(F.expr(f"count(*) div {BLOCK} + 1").cast("int").alias("blocks"))
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    part_of = F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int").alias("part")
    data = data.join(F.broadcast(blocks), keys)  # a row per range, table and axis, whatever the data
    data = data.select(*keys, F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), each(F.lit(q_blocks)).alias("part"), "id", "v", "ids")
    asked = asked.join(F.broadcast(blocks), keys).select(*keys, each(F.col("blocks")).alias("block"), part_of, "id", "v")

    def meet(entry: pa.Table, query: pa.Table) -> pa.Table:
        out = pa.schema([("query_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])
        if not len(entry) or not len(query):
            return out.empty_table()
        who = query["id"].to_numpy()
        ids, scores = _ranked(_matrix(query["v"]), who, _matrix(entry["v"]), entry["ids"].to_pylist(), k)
        return pa.table([query["id"], pa.array(ids, out.field(1).type), pa.array(scores, out.field(2).type)], schema=out)

    def merge(table: pa.Table) -> pa.Table:
        ids = np.concatenate([*(np.asarray(x, dtype=np.int64) for x in table["ids"].to_pylist())])
        scores = np.concatenate([*(np.asarray(x, dtype=float) for x in table["scores"].to_pylist())])
        best = np.lexsort((ids, -scores))
        ids, scores = ids[best], scores[best]
        ids, at = np.unique(ids, return_index=True)  # an id's first place is its largest score
        order = np.lexsort((ids, -scores[at]))[:k]
        m = len(order)
        return pa.table({"query_id": pa.array([table["query_id"][0].as_py()] * m, pa.int64()), "rank": pa.array(range(1, m + 1), pa.int32()),
                         "vec_id": pa.array(ids[order]), "score": pa.array(scores[at][order])})

    found_type = "query_id long, ids array<long>, scores array<double>"
    result_type = "query_id long, rank int, vec_id long, score double"

    def answer(asked: DataFrame, data: DataFrame, keys: list[str]) -> DataFrame:
        return data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(meet, found_type).groupBy("query_id").applyInArrow(merge, result_type)

    found = stored(answer(asked, data, [*keys, "block", "part"]), "found")
    there = F.create_map(*[F.lit(x) for d, r in facts.items() for x in (d, r["n"])])[F.col("d")]
    short = queries.join(found.groupBy(F.col("query_id").alias("id")).count(), "id", "left").where(F.coalesce("count", F.lit(0)) < F.least(F.lit(k), there - 1)).drop("count")
    short = stored(short, "short")
    if not short.count():
        return found
    n_blocks = max(r["n"] for r in facts.values()) // BLOCK + 1
    everything = entries.select("d", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("block"), each(F.lit(q_blocks)).alias("part"), "id", "v", "ids")
    again = short.select("id", "v", "d", part_of, each(F.lit(n_blocks)).alias("block"))
    exact = answer(again, everything, ["d", "block", "part"])
    return found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(exact)
