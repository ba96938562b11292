"""Hard negatives by inner product, from candidate lists that each cluster of anchors shares.

Anchors are clustered around directions; a cluster knows the largest angle between its direction and a member. For an anchor of length u in the cluster, a candidate
of length c at angle t from the direction has at most the product u * c * cos(t - largest angle). So the candidates of a cluster are ordered
once by c * cos(t - largest angle), and every member walks that list from the top until the bound of what follows, times its own length, is below
the last place of its result: then the rest cannot enter, which certifies the result.

On Spark a list is a number of chunks in the order of the bound. The first chunks (``SEED`` rows) are walked by all members, which gives each a last
place; after that a chunk goes only to those clusters and members whose last place its bound still reaches, so nothing else of the list is made. Clusters are
walked in blocks of members, so that neither a crowded direction nor a long list is one task. A first walk finds the positives, a second one the negatives, whose window of
allowed scores follows from the positives.

Equal vectors with one label are one entry that keeps its smallest ids, as many as any answer can name; equal anchors with one label are one member.
Scores are integers and exact: in floating point where its 53 bits prove enough, else in Python's integers.

Defined results. Rows with a null id or label, or whose vector is null or holds a null or non-finite component, take no part. A product is defined for vectors of one length
only, so vectors of each length meet among themselves; empty and zero vectors have the product 0 with all they meet. Repeated rows (id, label and vector) count once, a repeated id with
another label or vector is a row of its own. Ties go to the smaller id. Scores beyond 64 bits raise. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_proven, by_length, stored

#: members that a cluster has on average, and most clusters; members of one block; rows of one chunk; rows of the list that all members walk first
MEMBERS, CLUSTERS, BLOCK, CHUNK, SEED = 64, 512, 256, 4096, 4096
#: cells in which bounds are counted; rows of one step of a walk
BINS, STEP = 512, 512
#: relative slack of bounds, far above the rounding of angles
_SLACK = 1e-7


def usable(rows: DataFrame, label: Column, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(id, label, v) of distinct rows that take part, with v = floor(scale * component)."""
    v = F.transform(F.col(vector), lambda c: c.cast("double"))
    fine = rows.select(F.col(vec_id).cast("bigint").alias("id"), label.cast("bigint").alias("label"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    return fine.select("id", "label", F.transform("v", lambda c: F.floor(c * scale).cast("bigint")).alias("v")).distinct()


def products(u: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact inner products (rows of u, rows of m)."""
    most = int(np.abs(u).max(initial=0)) * int(np.abs(m).max(initial=0)) * u.shape[1]
    if most < 2**53:
        return (u.astype(float) @ m.astype(float).T).astype(np.int64)
    if most < 2**63:
        return u @ m.T
    exact = u.astype(object) @ m.astype(object).T
    if max((abs(x) for x in exact.flat), default=0) >= 2**63:
        raise OverflowError("an inner product does not fit into 64 bits")
    return exact.astype(np.int64)


def lengths_of(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(x.astype(float)).sum(axis=1))


def directions(x: np.ndarray) -> np.ndarray:
    n = lengths_of(x)
    return x / np.where(n > 0, n, 1)[:, None]


# -- clusters of anchors ---------------------------------------------------------------------------------------------

def nearest_direction(members: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Members with ``cluster`` (number of the nearest pivot of their length) and ``cosine`` to it."""
    def run(batches):
        for b in batches:
            cluster, cosine = np.zeros(b.num_rows, dtype=np.int32), np.ones(b.num_rows)
            for d, (at, x) in by_length(b.column("v")).items():
                c = directions(x) @ pivots[d].T
                cluster[at] = c.argmax(axis=1)
                cosine[at] = c[np.arange(len(at)), cluster[at]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cluster), pa.array(cosine)], [*b.schema.names, "cluster", "cosine"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema)
    return members.mapInArrow(run, f"{kinds}, cluster int, cosine double")


def clustered(members: DataFrame, per_cluster: int) -> tuple[DataFrame, dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Members with cluster, and per vector length the directions and the cosines of the largest angles."""
    counts = {r["d"]: r["count"] for r in members.groupBy(F.size("v").alias("d")).count().collect()}  # a row per length
    pivots = {}
    for d, n in counts.items():
        few = members.where(F.size("v") == d).orderBy(F.xxhash64("id", F.lit(7)), "id").limit(min(CLUSTERS, -(-n // per_cluster))).select("v").collect()
        pivots[d] = directions(np.array([r["v"] for r in few], dtype=np.int64).reshape(len(few), d))
    # one step towards the means: a task sends sums per cluster
    unit = nearest_direction(members, pivots).select(F.size("v").alias("d"), "cluster", F.posexplode(F.transform("v", lambda c: c.cast("double"))))
    means = unit.groupBy("d", "cluster", "pos").agg(F.avg("col").alias("mean")).collect()  # a pivot's size per cluster
    for r in means:
        pivots[r["d"]][r["cluster"], r["pos"]] = r["mean"]
    pivots = {d: directions(p) for d, p in pivots.items()}
    found = stored(nearest_direction(members, pivots), "members")
    cosines = {d: np.ones(len(p)) for d, p in pivots.items()}
    for r in found.groupBy(F.size("v").alias("d"), "cluster").agg(F.min("cosine").alias("c")).collect():
        cosines[r["d"]][r["cluster"]] = r["c"]
    return found, pivots, cosines


# -- lists of candidates ---------------------------------------------------------------------------------------------

def bounds(x: np.ndarray, pivots: np.ndarray, cosines: np.ndarray) -> np.ndarray:
    """(clusters, rows): what a unit vector of the cluster can have as its product with the row, at most."""
    n = lengths_of(x)
    t = np.arccos(np.clip(directions(x) @ pivots.T, -1, 1)) - np.arccos(np.clip(cosines, -1, 1))
    zero = n == 0
    b = n[:, None] * np.cos(np.maximum(t - _SLACK, 0)) + _SLACK * n[:, None]
    b[zero] = 0
    return b.T


def _cells(b: np.ndarray, longest: float) -> np.ndarray:
    """Cells of bounds, the highest bounds in cell 0."""
    return np.clip(np.floor((1 - b / longest) * (BINS / 2)).astype(np.int64), 0, BINS - 1)


def counted(entries: DataFrame, pivots: dict, cosines: dict, longest: float) -> dict[int, np.ndarray]:
    """Vector length -> (clusters, BINS): how many candidates have their bound in a cell; tasks add up first."""
    def run(batches):
        found = {d: np.zeros((len(p), BINS), dtype=np.int64) for d, p in pivots.items()}
        for b in batches:
            for d, (_, x) in by_length(b.column("v")).items():
                if d in pivots:
                    for c, cells in enumerate(_cells(bounds(x, pivots[d], cosines[d]), longest)):
                        found[d][c] += np.bincount(cells, minlength=BINS)
        for d, n in found.items():
            c, cell = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), d), pa.int32()), pa.array(c, pa.int32()), pa.array(cell, pa.int32()), pa.array(n[c, cell])], ["d", "cluster", "cell", "n"])

    rows = entries.select("v").mapInArrow(run, "d int, cluster int, cell int, n long").groupBy("d", "cluster", "cell").agg(F.sum("n").alias("n")).toArrow()  # BINS numbers per cluster at most
    d, cluster, cell, n = (rows[c].to_numpy() for c in ("d", "cluster", "cell", "n"))
    out = {k: np.zeros((len(p), BINS), dtype=np.int64) for k, p in pivots.items()}
    for k, counts in out.items():
        counts[cluster[d == k], cell[d == k]] = n[d == k]
    return out


def chunks_of(entries: DataFrame, wanted: dict, counts: dict, pivots: dict, cosines: dict, longest: float, chunk_rows: int) -> DataFrame:
    """(d, cluster, chunk, bound, id, label, ids, v): the part of every cluster's list that lies in its wanted cells (clusters, BINS)."""
    before = {d: np.cumsum(n, axis=1) - n for d, n in counts.items()}

    def run(batches):
        for b in batches:
            ids = b.column("id").to_numpy()
            spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
            for d, (at, x) in by_length(b.column("v")).items():
                if d not in pivots:
                    continue
                bound = bounds(x, pivots[d], cosines[d])
                cells = _cells(bound, longest)
                for c in np.flatnonzero(wanted[d].any(axis=1)):
                    mine = np.flatnonzero(wanted[d][c, cells[c]])
                    cell = cells[c, mine]
                    # rows of one cell are dealt over the places that the cell has in the list
                    place = before[d][c, cell] + (spread[at[mine]] % np.maximum(counts[d][c, cell], 1).astype(np.uint64)).astype(np.int64)
                    rows = b.take(pa.array(at[mine]))
                    m = len(mine)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, d), pa.int32()), pa.array(np.full(m, c), pa.int32()), pa.array((place // chunk_rows).astype(np.int32)),
                                                      pa.array(bound[c, mine]), *[rows.column(k) for k in ("id", "label", "ids", "v")]],
                                                     ["d", "cluster", "chunk", "bound", "id", "label", "ids", "v"])

    return entries.select("id", "label", "ids", "v").mapInArrow(
        run, "d int, cluster int, chunk int, bound double, id long, label long, ids array<long>, v array<long>")


def walk(members: DataFrame, chunks: DataFrame, same_label: bool, k: int) -> DataFrame:
    """(member, slot, id, score): the best rows of every chunk for every member and slot.

    Members have lists ``low``, ``high`` (allowed scores) and ``last`` (known last place), a number per slot; ids of an entry share its score.
    """
    def run(entry: pa.Table, who: pa.Table) -> pa.Table:
        out = pa.schema([("member", pa.int64()), ("slot", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])
        if not len(entry) or not len(who):
            return out.empty_table()
        order = np.argsort(-entry["bound"].to_numpy(), kind="stable")  # the list, once for all members
        entry = entry.take(pa.array(order))
        bound, label = entry["bound"].to_numpy(), entry["label"].to_numpy()
        d = entry["d"][0].as_py()
        x, u = by_length(entry["v"])[d][1], by_length(who["v"])[d][1]
        names = entry["ids"].combine_chunks()
        starts, flat = names.offsets.to_numpy(), names.values.to_numpy()
        mine = who["label"].to_numpy()
        low, high, last = ([np.array(z, dtype=np.int64) for z in who[c].to_pylist()] for c in ("low", "high", "last"))
        reach = lengths_of(u)
        best: list[list[tuple[np.ndarray, np.ndarray]]] = [[(np.zeros(0, dtype=np.int64),) * 2 for _ in s] for s in low]
        active = np.arange(len(u))
        for i in range(0, len(x), STEP):
            floor = np.array([min(np.maximum(low[j], last[j]), default=2**62) for j in active], dtype=float)
            active = active[reach[active] * bound[i] >= floor]  # the others' results are certain
            if not len(active):
                break
            s = products(u[active], x[i:i + STEP])
            fits = (label[i:i + STEP][None, :] == mine[active][:, None]) == same_label
            for row, j in enumerate(active):
                at = np.flatnonzero(fits[row])
                of = s[row, at]
                for slot in range(len(low[j])):
                    fine = (of >= max(low[j][slot], last[j][slot])) & (of <= high[j][slot])
                    if not fine.any():
                        continue
                    pick, value = at[fine] + i, of[fine]
                    width = starts[pick + 1] - starts[pick]
                    ids = np.concatenate([flat[starts[p]:starts[p + 1]] for p in pick])
                    ids, value = np.concatenate([best[j][slot][0], ids]), np.concatenate([best[j][slot][1], np.repeat(value, width)])
                    top = np.lexsort((ids, -value))[:k]
                    best[j][slot] = ids[top], value[top]
                    if len(top) == k:
                        last[j][slot] = max(last[j][slot], value[top[-1]])
        member = who["member"].to_numpy()
        part = [(member[j], slot, ids, value) for j, slots in enumerate(best) for slot, (ids, value) in enumerate(slots) if len(ids)]
        if not part:
            return out.empty_table()
        n = [len(p[2]) for p in part]
        return pa.table([pa.array(np.repeat([p[0] for p in part], n), pa.int64()), pa.array(np.repeat([p[1] for p in part], n), pa.int32()),
                         pa.array(np.concatenate([p[2] for p in part])), pa.array(np.concatenate([p[3] for p in part]))], schema=out)

    keys = ["d", "cluster", "chunk", "block"]
    pairs = members.select("d", "cluster", "block", "chunk").distinct()
    lists = chunks.join(pairs, ["d", "cluster", "chunk"])
    lists = lists.select(*[F.col(c).alias(c) for c in lists.columns])  # columns of its own, as both sides come from the members
    return lists.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInArrow(run, "member long, slot int, id long, score long")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each (member, slot), ties by id, with their place."""
    order = Window.partitionBy("member", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def certified(members: DataFrame, entries: DataFrame, shape: tuple, same_label: bool, k: int, name: str, chunk_rows: int, seed_rows: int) -> DataFrame:
    """(member, slot, id, score, place): the certain results of all members (member, label, v, d, cluster, block, low, high)."""
    pivots, cosines, counts, longest = shape
    starts = {d: np.cumsum(n, axis=1) - n for d, n in counts.items()}
    first = {d: s < seed_rows for d, s in starts.items()}
    # the last bit of a bound may differ between two passes: the rest begins a cell earlier, and what both find counts once
    rest = {d: np.pad(~f[:, 1:], ((0, 0), (0, 1)), constant_values=True) for d, f in first.items()}

    def chunk_table(cells: dict[int, np.ndarray]) -> DataFrame:
        """(d, cluster, chunk, top): chunks that hold rows of these cells, with the highest bound they can hold."""
        parts = [np.zeros((0, 5))]
        for d, n in counts.items():
            some = np.pad(n > 0, ((0, 0), (1, 1)))
            c, cell = np.nonzero(cells[d] & (some[:, 1:-1] | some[:, 2:] | some[:, :-2]))
            parts.append(np.column_stack([np.full(len(c), d), c, starts[d][c, cell] // chunk_rows, (starts[d][c, cell] + np.maximum(n[c, cell], 1) - 1) // chunk_rows,
                                          (1 - (cell - 1) / (BINS / 2)) * longest]))
        rows = np.concatenate(parts)
        table = pa.table([pa.array(rows[:, k].astype(np.int32)) for k in range(4)] + [pa.array(rows[:, 4])], names=["d", "cluster", "a", "b", "top"])
        spread = members.sparkSession.createDataFrame(table).select("d", "cluster", F.explode(F.sequence("a", "b")).alias("chunk"), "top")
        return spread.groupBy("d", "cluster", "chunk").agg(F.max("top").alias("top"))

    def chunks(cells):
        return chunks_of(entries, cells, counts, pivots, cosines, longest, chunk_rows)

    none = F.transform("low", lambda x: F.lit(-(2**62)).cast("bigint"))
    seen = members.withColumn("last", none)
    started = stored(best_of(walk(stored(seen.join(chunk_table(first), ["d", "cluster"]), f"{name}-asked"), chunks(first), same_label, k), k), f"{name}-first")
    # the known last places of a member, by slot
    lasts = started.where(F.col("place") == k).groupBy("member").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("m"))
    known = members.join(lasts, "member", "left").withColumn(
        "last", F.transform("low", lambda x, i: F.coalesce(F.try_element_at("m", i.cast("int")), F.lit(-(2**62)).cast("bigint")))).drop("m")
    known = stored(known, f"{name}-known")
    floor = F.array_min(F.zip_with("low", "last", lambda a, b: F.greatest(a, b)))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    open_chunks = known.where(F.size("low") > 0).join(chunk_table(rest), ["d", "cluster"]).where(size * F.col("top") >= floor).drop("top")
    open_chunks = stored(open_chunks, f"{name}-open")
    # cells that no member of the cluster can use are not made
    wanted = {d: np.zeros_like(n, dtype=bool) for d, n in counts.items()}
    for r in open_chunks.groupBy("d", "cluster").agg(F.max("chunk").alias("chunk")).collect():  # a row per cluster
        wanted[r["d"]][r["cluster"]] = rest[r["d"]][r["cluster"]] & (starts[r["d"]][r["cluster"]] < (r["chunk"] + 1) * chunk_rows)
    more = walk(open_chunks, chunks(wanted), same_label, k)
    return stored(best_of(started.select("member", "slot", "id", "score").unionByName(more).distinct(), k), f"{name}-best")


def hard_negatives(rows: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding", chunk_rows: int = CHUNK, seed_rows: int = SEED, per_cluster: int = MEMBERS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``is_anchor`` (over ``id``) picks.

    ``label`` is an expression over the columns of ``rows``; allowed are negatives with low * positive_score <= 100 * score <= high * positive_score.
    """
    fine = stored(usable(rows, label, vec_id, vector, scale), "labelled-vectors")
    keep = max(positives + 1, negatives)
    first = Window.partitionBy("label", "v").orderBy("id")
    entries = fine.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= keep).groupBy("label", "v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    entries = stored(entries.select(F.element_at("ids", 1).alias("id"), "label", "ids", "v"), "entries")
    anchors = fine.where(is_anchor)
    # anchors with one vector and label are one member, named by the smallest of them
    points = stored(anchors.groupBy("label", "v").agg(F.min("id").alias("member")).select(
        F.xxhash64("member", "label", "v").alias("member"), "label", "v", F.col("member").alias("id")), "points")
    longest = entries.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))).first()[0] or 1.0
    members, pivots, cosines = clustered(points, per_cluster)
    counts = counted(entries, pivots, cosines, longest)
    shape = (pivots, cosines, counts, longest)
    blocks = members.groupBy("cluster").agg(F.expr(f"cast(count(*) div {BLOCK} + 1 as int)").alias("blocks"))
    members = members.join(F.broadcast(blocks), "cluster").select(
        "member", "label", "v", F.size("v").alias("d"), "cluster", F.pmod(F.xxhash64("member", F.lit(3)), "blocks").cast("int").alias("block"))
    members = stored(members, "dealt-members")

    whole = F.array(F.lit(-(2**62)).cast("bigint")), F.array(F.lit(2**62).cast("bigint"))
    alike = certified(members.select("*", whole[0].alias("low"), whole[1].alias("high")), entries, shape, True, positives + 1, "positives", chunk_rows, seed_rows)
    # a slot per positive: 100 * score >= low * positive, 100 * score <= high * positive
    scores = alike.groupBy("member").agg(F.array_sort(F.collect_set("score")).alias("scores"))
    least = F.transform("scores", lambda s: F.ceil(s.cast("decimal(38,0)") * low / 100).cast("bigint"))
    most = F.transform("scores", lambda s: F.floor(s.cast("decimal(38,0)") * high / 100).cast("bigint"))
    asking = stored(members.join(scores, "member").select("*", least.alias("low"), most.alias("high")), "asking")
    found = certified(asking.drop("scores"), entries, shape, False, negatives, "negatives", chunk_rows, seed_rows)
    found = found.join(asking.select("member", "scores"), "member").select("member", F.element_at("scores", F.col("slot") + 1).alias("positive_score"), "id", "score", "place")

    # each anchor of a point has the point's best rows but itself as positives
    named = anchors.select(F.col("id").alias("anchor_id"), "label", "v").join(broadcast_if_proven(points.drop("id"), 64 + 8 * max(pivots, default=0)), ["label", "v"]).select("anchor_id", "member")
    best = alike.select("member", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "place")
    own = named.join(best, "member").where("positive_id <> anchor_id")
    order = Window.partitionBy("anchor_id", "member").orderBy("place")
    own = own.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= positives).drop("_n", "place")
    return own.join(found, ["member", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
