"""MinHash near-deduplication with an LSH forest, and an exact pass for what the forest misses.

Each distinct shingle set is a node (exact copies collapse first). Its signature gives ``TREES`` labels of ``DEPTH`` values, and each tree
is the sorted order of one label. Candidates of a node in a tree are its neighbour in that order and the heads of its regions. A region is
the nodes that share the first ``SHALLOW`` values; one with more than ``CROWD`` nodes is split by the next value, and what is still crowded by the one after
that, so the depth follows from how dense the data are there. A node counts for as much as the regions of full depth around it are large, and
the node that counts most is its region's head, so that the centre of a large group of near copies meets all of them.

Links are confirmed on full sets in two rounds: first the partner that most trees name, for every node; then every candidate whose two nodes
are not led to one node by such links. This is only the cheap way to most links, as a region's other pairs are not compared.

The rest is exact. All sets are put into one order, the most frequent shingles last (counts over all texts). Of two similar sets, the first common
shingle is in the prefix of both that is one longer than what a similar set can lack. Sizes are cut into classes, each as wide as similar sizes can be apart, so a
set meets those of its own class and the next one. Nodes of different components that share a shingle of their prefixes meet per (shingle, class), in blocks of ``BLOCK`` by
``BLOCK`` rows. Each set has parity bits that say whether it holds an odd number of the shingles of that bit; as many shingles as two sets differ in bits, they differ in at
least. The join itself drops the pairs that differ in too many bits, so what leaves it is little more than the similar pairs; these are compared on full sets.
Pairs inside one component can change nothing, so no pair that can is left out. Only bits of rows in one (shingle, class) are compared more often than the
input grows, and only where neither the counts nor the sizes tell them apart.

Defined results. A text without words, or null, has an empty set and is linked with nothing. A text with fewer words than a shingle is one shingle.
Rows with a null id take no part: no component, kept. Repeated rows are rows of their own with equal results. Other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_proven, discard, stored, union_all
from .components import components
from .passages import mixed, split_words

TREES, DEPTH, SHALLOW, CROWD = 16, 6, 4, 64
#: rows of a shingle's list that meet in one block
BLOCK = 2048
#: groups in which shingles are counted for the order of the sets, by the first bits of their hash; rows in which a task sends its counts
BUCKET_BITS, PIECES = 20, 64
BUCKETS = 1 << BUCKET_BITS
#: bits of sets of up to 1000 shingles, and of larger ones; sets of classes up to NARROW shingles meet with 256 of them, others with 1024
PARITY, PARITY_LARGE, NARROW = 1024, 8192, 700
_FACTORS = (np.random.default_rng(5).integers(0, 2**63, TREES * DEPTH, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one text after the other, and where each begins."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    w = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    n = len(w.low)
    h = np.full(max(n, 1), size, dtype=np.uint64)[:n]
    for k in range(size):  # shingles that would cross into the next text are never used below
        h = mixed(h * _ODD + np.concatenate([w.low[k:], w.low[:k]])[:n], 11)
    out = []
    for a, b in zip(w.starts[:-1], w.starts[1:]):
        if b - a >= size:
            s = np.sort(h[a:b - size + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            v = np.array([b - a], dtype=np.uint64)
            for x in range(a, b):
                v = mixed(v * _ODD + w.low[x:x + 1], 12)
            out.append(v)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    starts = np.concatenate([[0], np.cumsum([len(s) for s in out])]).astype(np.int64)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64), starts


def minima(sets: np.ndarray, starts: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """The signature (texts, TREES * DEPTH) of non-empty sets: the least value under each multiplication."""
    n = len(starts) - 1
    sig = np.empty((n, len(_FACTORS)), dtype=np.int32)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + step, side="right")) - 1)
        part, at = sets[starts[i]:starts[j]], starts[i:j] - starts[i]
        for k, f in enumerate(_FACTORS):
            sig[i:j, k] = (np.minimum.reduceat(part * f, at) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        i = j
    return sig


def classes(percent: int, most: int = 1 << 40) -> np.ndarray:
    """The largest size of each class: sets of similar size are in one class or in neighbouring ones."""
    out = []
    while not out or out[-1] < most:
        out.append(((out[-1] if out else 0) + 1) * 100 // percent)
    return np.array(out, dtype=np.int64)


def _small(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def frequencies(docs: DataFrame, size: int) -> np.ndarray:
    """How often shingles occur in all texts: the rank of the count of each of ``BUCKETS`` groups of shingles.

    Every shingle of every text is counted. Counts only order the sets (any order gives the same results), so shingles that share a bucket may share a
    count. Tasks send their counts as ``PIECES`` rows each, which are summed as they stream; what reaches the driver is as large for any input.
    """
    width = BUCKETS // PIECES

    def count(batches):
        total, held, n = np.zeros(BUCKETS, dtype=np.int64), [np.zeros(0, dtype=np.int64)], 0
        for whole in batches:
            for b in _small(whole):
                held.append((shingle_sets(b.column("text"), size)[0] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
                n += len(held[-1])
                if n >= BUCKETS:
                    total += np.bincount(np.concatenate(held), minlength=BUCKETS)
                    held, n = held[:1], 0
        total += np.bincount(np.concatenate(held), minlength=BUCKETS)
        if total.any():
            kind = np.min_scalar_type(total.max())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(PIECES, dtype=np.int32)), pa.array([kind.itemsize] * PIECES, pa.int32()),
                 pa.array([x.tobytes() for x in total.astype(kind).reshape(PIECES, width)], pa.binary())], ["piece", "bytes", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for piece, wide, counts in zip(*(b.column(c).to_pylist() for c in ("piece", "bytes", "counts"))):
                part = np.frombuffer(counts, dtype=f"u{wide}").astype(np.int64)
                sums[piece] = sums[piece] + part if piece in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["piece", "counts"])

    counted = docs.where("id is not null").select("text").mapInArrow(count, "piece int, bytes int, counts binary")
    found = counted.repartition(4, "piece").mapInArrow(add, "piece int, counts binary").toArrow()
    total = np.zeros((PIECES, width), dtype=np.int64)
    for piece, counts in zip(found["piece"].to_pylist(), found["counts"].to_pylist()):
        total[piece] = np.frombuffer(counts, dtype=np.int64)
    return np.unique(total.ravel(), return_inverse=True)[1].astype(np.int32)


def signed(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(id, th, n, digest, sig, prefix, odd, class) per row of (id, text, th): set size, 128-bit name of the set, signature (null for empty sets), first shingles, parities, class of the size."""
    often_of = docs.sparkSession.sparkContext.broadcast(frequencies(docs, size))
    ends_of = classes(percent)

    def run(batches):
        for whole in batches:
            for b in _small(whole):
                sets, starts = shingle_sets(b.column("text"), size)
                n = np.diff(starts)
                digests = [xxhash.xxh3_128_digest(sets[i:j].tobytes()) for i, j in zip(starts[:-1], starts[1:])]
                full = np.flatnonzero(n)
                sig = minima(sets, np.append(starts[:-1][full], starts[-1]))
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, sig.shape[1], 0))]).astype(np.int32)
                often = often_of.value[(sets >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
                # of the n shingles, a similar set has n * percent / 100 at least, so one of the first n - that + 1
                heads = [sets[i:j][np.argsort(often[i:j], kind="stable")[:(j - i) - (-(-(j - i) * percent // 100)) + 1]] for i, j in zip(starts[:-1], starts[1:])]
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in heads])]).astype(np.int32)),
                                                  pa.array(np.concatenate([*heads, sets[:0]]).view(np.int64)))
                wide = np.where(n > 1000, PARITY_LARGE, PARITY)
                odd = [np.packbits((np.bincount((sets[i:j] % np.uint64(w)).astype(np.int64), minlength=w) & 1).astype(np.uint8)).view(np.int64) for i, j, w in zip(starts[:-1], starts[1:], wide)]
                odds = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(wide // 64)]).astype(np.int32)), pa.array(np.concatenate(odd)))
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("th"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(sig.ravel())), prefix, odds, pa.array(np.searchsorted(ends_of, n).astype(np.int32))],
                    ["id", "th", "n", "digest", "sig", "prefix", "odd", "class"])

    return docs.select("id", "th", "text").mapInArrow(run, "id long, th long, n long, digest binary, sig array<int>, prefix array<long>, odd array<long>, class int")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """(node, n, items) per row of (node, text)."""
    def run(batches):
        for whole in batches:
            for b in _small(whole):
                sets, starts = shingle_sets(b.column("text"), size)
                yield pa.RecordBatch.from_arrays(
                    [b.column("node"), pa.array(np.diff(starts), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(sets.view(np.int64)))], ["node", "n", "items"])

    return docs.select("node", "text").mapInArrow(run, "node struct<id:bigint,h:bigint>, n long, items array<long>")


def neighbours(labels: DataFrame) -> DataFrame:
    """Pairs of nodes next to each other in the order of (tree, label), with a common prefix of SHALLOW values at least.

    The order is made by range partitions, so equal prefixes may spread over many tasks; the pairs across two partitions come from
    the first and last rows of all, which are two rows per partition.
    """
    rows = labels.select("tree", "label", "node").repartitionByRange("tree", "label", "node").sortWithinPartitions("tree", "label", "node")

    def run(batches):
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), None
        node = pa.struct([("id", pa.int64()), ("h", pa.int64())])
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches(([last] if last is not None else []) + [b]).combine_chunks()
            lab = t["label"].combine_chunks().flatten().to_numpy().reshape(-1, DEPTH)
            tree = t["tree"].to_numpy()
            near = (tree[1:] == tree[:-1]) & (lab[1:, :SHALLOW] == lab[:-1, :SHALLOW]).all(axis=1)
            i = pa.array(np.flatnonzero(near))
            u, v = t["node"].take(i), t["node"].take(pc.add(i, 1))
            n = len(i)
            if last is None:
                yield pa.RecordBatch.from_arrays([pa.nulls(1, node), t["node"].combine_chunks()[:1], pa.array([part], pa.int32()), t["tree"].combine_chunks()[:1],
                                                  t["label"].combine_chunks()[:1]], ["u", "v", "part", "tree", "label"])
            if n:
                yield pa.RecordBatch.from_arrays([u.combine_chunks(), v.combine_chunks(), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, t["label"].type)],
                                                 ["u", "v", "part", "tree", "label"])
            last = b.slice(b.num_rows - 1, 1)
        if last is not None:
            yield pa.RecordBatch.from_arrays([last.column("node"), pa.nulls(1, node), pa.array([part], pa.int32()), last.column("tree"), last.column("label")],
                                             ["u", "v", "part", "tree", "label"])

    node = "struct<id:bigint,h:bigint>"
    found = stored(rows.mapInArrow(run, f"u {node}, v {node}, part int, tree int, label array<int>"), "sorted-neighbours")
    lasts = found.where("part is not null and v is null").select(F.col("part").alias("p"), "u", F.col("tree").alias("t"), F.col("label").alias("l"))
    # empty partitions stand between none: each last row meets the first row of the next partition that has rows
    firsts = found.where("part is not null and u is null").select("part", "v", "tree", "label")
    order = firsts.select("part").unionByName(lasts.select(F.col("p").alias("part"))).distinct()
    parts = sorted(r["part"] for r in order.collect())
    following = {a: b for a, b in zip(parts, parts[1:])}
    pairs = found.where("part is null").select("u", "v")
    if not following:
        return pairs
    step = F.create_map(*[F.lit(x) for kv in following.items() for x in kv])
    edge = lasts.withColumn("part", step[F.col("p")]).join(firsts, "part").where(
        (F.col("t") == F.col("tree")) & (F.slice("l", 1, SHALLOW) == F.slice("label", 1, SHALLOW)))
    return pairs.unionByName(edge.select("u", "v"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose full sets are similar. The set of ``v`` travels to ``u``: hubs stand in ``u`` and their set is not copied about."""
    mine = pairs.join(sets.select(F.col("node").alias("v"), F.col("n").alias("vn"), F.col("items").alias("vi")), "v")
    both = mine.join(sets.select(F.col("node").alias("u"), F.col("n").alias("un"), F.col("items").alias("ui")), "u")
    both = both.where(F.least("un", "vn") * 100 >= F.greatest("un", "vn") * percent)
    common = F.size(F.array_intersect("ui", "vi"))
    return both.where(common * 100 >= (F.col("un") + F.col("vn") - common) * percent).select("u", "v")


def _folded(odd, longs: int) -> list:
    """Parity bits folded to ``longs`` numbers; folding keeps the bound, as bits that agree stay equal."""
    def number(i: int, width: int):
        return functools.reduce(lambda a, b: a.bitwiseXOR(b), [F.get(odd, j) for j in range(i, width // 64, longs)])

    return [F.when(F.size(odd) == PARITY // 64, number(i, PARITY)).otherwise(number(i, PARITY_LARGE)).alias(f"p{i}") for i in range(longs)]


def unexamined(nodes: DataFrame, joined: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of nodes of different components that can still be similar: they share a shingle of their prefixes."""
    of = F.xxhash64(F.coalesce("component", "node")).alias("of")
    # lists hold 64-bit names of nodes and components
    placed = stored(nodes.join(joined, "node", "left").select(F.xxhash64("digest").alias("h"), of, F.col("n").cast("int").alias("n"), "class", "prefix"), "prefixes")
    apart = placed.select("of", F.explode("prefix").alias("item")).groupBy("item").agg(F.min("of").alias("lo"), F.max("of").alias("hi")).where("lo <> hi")
    apart = stored(apart.select("item"), "items-apart")
    lists = placed.select("h", "of", "n", "class", F.posexplode("prefix").alias("pos", "item"))
    # the joins of lists are shuffled at every size; each step is a table, so that its shuffle files go before the next one's come
    lists = stored(lists.join(apart.hint("merge"), "item"), "prefix-lists")
    discard(placed, apart)

    # the larger of two sets stands in its own class, the smaller one in its own and the next
    sides = lists.select("*", F.explode(F.array(F.struct(F.col("class").alias("k"), F.lit(1).alias("large")), F.struct(F.col("class").alias("k"), F.lit(0).alias("large")),
                                                F.struct((F.col("class") + 1).alias("k"), F.lit(0).alias("large")))).alias("s")).select("*", "s.k", "s.large").drop("s", "class")
    cells = sides.groupBy("item", "k").agg(
        F.sum("large").alias("nl"), F.sum(1 - F.col("large")).alias("ns"), F.min("of").alias("lo"), F.max("of").alias("hi")).where("lo <> hi and nl > 0 and ns > 0")
    blocks = lambda n: F.expr(f"cast({n} div {BLOCK} + 1 as int)")
    cells = stored(cells.select("item", "k", blocks("nl").alias("bl"), blocks("ns").alias("bs")), "cells")
    sides = stored(sides.join(cells.hint("merge"), ["item", "k"]), "sides")
    discard(lists, cells)
    narrow = int(np.searchsorted(classes(percent), NARROW))
    bits = nodes.select(F.xxhash64("digest").alias("h"), "odd")
    found = []
    for longs, which in ((4, F.col("k") < narrow), (16, F.col("k") >= narrow)):
        parity = bits.select("h", *_folded(F.col("odd"), longs))
        rows = stored(sides.where(which).join(parity, "h"), "sides-with-bits")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        mine = lambda n: F.pmod(F.xxhash64("h"), n).cast("int")
        named = lambda x: [F.col(c).alias(f"{x}_{c}") for c in ("h", "of", "n", "pos", *[f"p{i}" for i in range(longs)])]
        small = rows.where("large = 0").select("item", "k", mine("bs").alias("i"), every("bl").alias("j"), *named("u"))
        large = rows.where("large = 1").select("item", "k", mine("bl").alias("j"), every("bs").alias("i"), *named("v"))
        order = (F.col("u_n") < F.col("v_n")) | ((F.col("u_n") == F.col("v_n")) & (F.col("u_h") < F.col("v_h")))
        sizes = F.col("u_n").cast("bigint") * 100 >= F.col("v_n").cast("bigint") * percent
        # at the first common shingle, what is left of both sets bounds what they have in common
        both, most = (F.col("u_n") + F.col("v_n")).cast("bigint"), F.least(F.col("u_n") - F.col("u_pos"), F.col("v_n") - F.col("v_pos"))
        differ = sum((F.bit_count(F.col(f"u_p{i}").bitwiseXOR(F.col(f"v_p{i}"))) for i in range(longs)), F.lit(0))
        alike = (most.cast("bigint") * (100 + percent) >= both * percent) & (differ * (100 + percent) <= both * (100 - percent))
        keys = functools.reduce(lambda a, b: a & b, [small[c] == large[c] for c in ("item", "k", "i", "j")])
        met = small.join(large, keys & (F.col("u_of") != F.col("v_of")) & order & sizes & alike)
        found.append(stored(met.select("u_h", "v_h").distinct(), "met"))
        discard(rows)
    discard(sides)
    met = found[0].unionByName(found[1]).distinct()
    name = lambda x: nodes.select(F.xxhash64("digest").alias(f"{x}_h"), F.col("node").alias(x), F.col("n").alias(f"{x}n"), F.col("odd").alias(f"{x}o"))
    met = met.join(name("u"), "u_h").join(name("v"), "v_h")
    differ = F.aggregate(F.zip_with("uo", "vo", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, x: a + x)
    return met.where((F.size("uo") != F.size("vo")) | (differ * (100 + percent) <= (F.col("un") + F.col("vn")) * (100 - percent))).select("u", "v")


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, percent: int = 85) -> DataFrame:
    """Rows (id, th, n, component) for all rows; ``percent`` is the least similarity, ``size`` the words of a shingle."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))
    signatures = stored(signed(rows, size, percent), "signatures")
    slim = stored(signatures.select("id", "th", "n", "digest"), "set-names")
    parts = [F.first(c).alias(c) for c in ("n", "sig", "odd", "prefix", "class")]
    classes_ = signatures.where("id is not null and n > 0").groupBy("digest").agg(F.min(F.struct("id", "th")).alias("first"), *parts)
    # a node is named by its smallest id, with a hash of the set for rows that share an id
    named = lambda digest, i: F.struct(i.alias("id"), F.xxhash64(digest).alias("h"))
    nodes = stored(classes_.select(named(F.col("digest"), F.col("first.id")).alias("node"), F.col("first.th").alias("th"), "n", "digest", "sig", "odd", "prefix", "class"), "nodes")
    discard(signatures)

    labels = nodes.select("node", "n", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.slice("sig", t * DEPTH + 1, DEPTH))).alias("tree", "label"))
    labels = labels.withColumn("region", F.xxhash64("tree", F.slice("label", 1, SHALLOW)))
    dense = labels.groupBy("region").agg(F.count("*").alias("c")).where("c > 1")
    kept = stored(labels.join(dense, "region"), "regions")
    labels = kept.drop("c").withColumn("deep", F.xxhash64("tree", "label"))

    weight = labels.join(labels.groupBy("deep").agg(F.count("*").alias("c")), "deep").groupBy("node").agg(F.sum("c").alias("weight"))
    facts = stored(weight.join(nodes.select("node", "n", "th"), "node"), "facts")

    def stars_of(regions: DataFrame) -> DataFrame:
        heads = regions.join(facts.select("node", "weight"), "node").groupBy("region").agg(
            F.max_by(F.col("node"), F.struct("weight", (-F.col("node.id")).alias("id"), F.col("node.h").alias("h"))).alias("head"))
        return regions.join(heads, "region").where("head <> node").select(F.col("head").alias("u"), F.col("node").alias("v"))

    stars, crowded = [stars_of(labels)], kept.where(F.col("c") > CROWD)
    for depth in range(SHALLOW + 1, DEPTH + 1):  # crowded regions are split by one more value each time
        parts_of = crowded.select("node", "tree", "label", F.xxhash64("tree", F.slice("label", 1, depth)).alias("region"))
        sizes = parts_of.groupBy("region").agg(F.count("*").alias("c")).where("c > 1")
        parts_of = stored(parts_of.join(sizes, "region"), "deeper-regions")
        stars.append(stars_of(parts_of.drop("c")))
        crowded = parts_of.where(F.col("c") > CROWD)
    found = union_all(stars).unionByName(neighbours(labels).where("u <> v"))
    found = found.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.count("*").alias("trees"))
    # the length bound needs no set: similarity is at most the ratio of the sizes
    of = lambda x: facts.select(F.col("node").alias(x), F.col("n").alias(f"{x}n"), F.col("weight").alias(f"{x}w"))
    found = found.join(of("a"), "a").join(of("b"), "b").where(F.least("an", "bn") * 100 >= F.greatest("an", "bn") * percent)
    hub = F.col("aw") >= F.col("bw")
    pairs = stored(found.select(F.when(hub, F.col("a")).otherwise(F.col("b")).alias("u"),
                                F.when(hub, F.col("b")).otherwise(F.col("a")).alias("v"), "trees"), "candidates")

    def sets_of(pairs: DataFrame) -> DataFrame:
        involved = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct().join(nodes.select("node", "th"), "node")
        involved = stored(involved.select("node", F.col("node.id").alias("id"), "th"), "involved")
        of_node = rows.join(broadcast_if_proven(involved, 64), ["id", "th"]).select("node", "text")
        return stored(full_sets(of_node.dropDuplicates(["node"]), size), "sets")

    sets = sets_of(pairs)
    best = pairs.groupBy("v").agg(F.max_by("u", F.struct("trees", (-F.col("u.id")).alias("i"), F.col("u.h").alias("h"))).alias("u"))
    links = stored(confirmed(best.select("u", "v"), sets, percent), "links-1")
    # a node is led by its partner's partner: nodes with one leader are connected
    leads = links.select(F.col("v").alias("node"), F.col("u").alias("lead"))
    leads = leads.join(links.select(F.col("v").alias("lead"), F.col("u").alias("next")), "lead", "left").select("node", F.coalesce("next", "lead").alias("lead"))
    leads = stored(leads, "leaders")
    rest = pairs.select("u", "v").join(leads.select(F.col("node").alias("u"), F.col("lead").alias("lu")), "u", "left").join(
        leads.select(F.col("node").alias("v"), F.col("lead").alias("lv")), "v", "left")
    rest = rest.where(F.coalesce("lu", "u") != F.coalesce("lv", "v")).select("u", "v")
    rest = rest.join(best.select("u", "v"), ["u", "v"], "left_anti")
    more = stored(confirmed(rest, sets, percent), "links-2")
    joined = stored(components(links.unionByName(more)), "components")
    discard(kept, facts, pairs, sets, leads)
    open_pairs = stored(unexamined(nodes, joined, percent), "unexamined")
    if not open_pairs.isEmpty():
        missed = stored(confirmed(open_pairs, sets_of(open_pairs), percent), "links-3")
        if not missed.isEmpty():
            joined = stored(components(links.unionByName(more).unionByName(missed)), "components")

    of_class = nodes.join(joined, "node").select("digest", F.col("component.id").alias("component"))
    own = slim.select("id", "th", "n", "digest").join(nodes.select("digest", F.col("node.id").alias("smallest")), "digest", "left")
    own = own.join(of_class, "digest", "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("component", "smallest"))
    return own.select("id", "th", "n", component.cast("bigint").alias("component"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near copies, columns as they came; of a repeated row, one."""
    found = near_components(docs, doc_id, text, size, percent)
    kept = found.where("component is null or component = id").groupBy("id", "th").agg(F.count("*").alias("_rows")).select(
        F.col("id").alias("_i"), F.col("th").alias("_t"), "_rows")
    rows = docs.join(kept, docs[doc_id].eqNullSafe(kept["_i"]) & (F.xxhash64(docs[text]) == kept["_t"]))
    mine, several = [docs[c] for c in docs.columns], kept["_i"].isNotNull() & (kept["_rows"] > 1)
    repeated = rows.where(several).select(*mine).dropDuplicates([doc_id, text])
    return rows.where(~several).select(*mine).unionByName(repeated)
