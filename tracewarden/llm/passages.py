"""Substring deduplication by recompression.

Words become symbols. In each round runs of equal symbols and then pairs of adjacent symbols get new names; a name is a hash
of what it stands for, so all tasks give equal things equal names without asking each other. Whether two symbols pair depends on
these two alone (the left one in one half of the names, the right one in the other), so equal passages get equal symbols except near
their ends. After ``rounds`` rounds every symbol that touches the middle of a repeated window, ``2 ** rounds`` words away from its
ends, is the same wherever the window stands, and so is each pair of neighbours there. That gives three Spark rounds:

1. reveal: chunks of documents send the neighbour pairs of high-level symbols; a pair is shared if two documents have it;
2. verify: windows whose middle has only shared pairs send a 128-bit hash of their words and the smallest document id;
3. remove: a window goes where a smaller document has it, and the words it covers are cut out.

Windows whose middle holds no pair (next to runs of equal words) skip the first round's test, so none is lost. A chunk names a
key once, however often it holds it; no list of the documents that share something is ever made.

Defined results. Null or empty texts have no words and come back empty. Rows with a null id are returned whole and take no part
in comparisons. Repeated rows with one id are one document: they do not remove each other, and each comes back. Only the id
and the text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_slices, by_bucket, chunked, round_trip, text_bytes

ASKS = "chunk int, bucket int, keys binary, vals binary"
#: runs shorter than this stay as they are; windows that touch longer runs are always verified
RUN = 4
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finalizer."""
    x = x + np.uint64((salt * 0xD1B54A32D192ED03 + 0x8CB92BA72F3D8DD7) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    """All words of a chunk, document after document."""
    flat: pa.Array
    starts: np.ndarray  # first word of each document, and the end
    low: np.ndarray
    high: np.ndarray

    @property
    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


def split_words(texts: pa.Array | pa.ChunkedArray) -> Words:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, ends = lists.flatten(), lists.offsets.to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    flat = flat.filter(full)
    coded = flat.dictionary_encode()
    names = b"".join([xxhash.xxh3_128_digest(w) for w in coded.dictionary.to_pylist()])
    names = np.frombuffer(names, dtype=np.uint64).reshape(-1, 2)
    codes = coded.indices.to_numpy()
    return Words(flat, kept[ends - ends[0]], names[codes, 0], names[codes, 1])


def n_rounds(size: int) -> int:
    """The most rounds after which the middle of any window still holds two symbols."""
    r = 0
    while size - 2 * 2 ** (r + 1) >= 2 ** (r + 1) + 1:
        r += 1
    return r


def recompress(w: Words, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, first word of each, long) after the rounds; ``long`` marks words inside named runs."""
    sym, at = w.low, np.arange(len(w.low))
    last = np.zeros(len(sym), dtype=bool)  # the last symbol of its document
    last[w.starts[1:][np.diff(w.starts) > 0] - 1] = True
    in_run = np.zeros(len(sym), dtype=bool)
    if len(sym):
        head = np.concatenate([[True], (sym[1:] != sym[:-1]) | last[:-1]])
        first = np.flatnonzero(head)
        n = np.diff(np.append(first, len(sym)))
        if (n >= RUN).any():
            in_run = np.repeat(n >= RUN, n)
            keep = head | ~in_run
            count = np.repeat(n, n)[keep].astype(np.uint64)
            named = in_run[keep]
            closing = np.concatenate([head[1:], [True]])
            ends_doc = np.repeat(last[closing], n)[keep]
            last = np.where(named, ends_doc, last[keep])
            sym = np.where(named, mixed(sym[keep] * _ODD + count, 1), sym[keep])
            at = at[keep]
    for r in range(rounds):
        right = (mixed(sym, 2 * r + 2) & np.uint64(1)).astype(bool)
        pair = np.zeros(len(sym), dtype=bool)
        pair[:-1] = ~right[:-1] & right[1:] & ~last[:-1]
        keep = np.ones(len(sym), dtype=bool)
        keep[1:] = ~pair[:-1]
        after = np.concatenate([sym[1:], sym[:1]])
        sym = np.where(pair, mixed(sym * _ODD ^ mixed(after, 2 * r + 3), 2 * r + 3), sym)[keep]
        last = np.where(pair, np.concatenate([last[1:], [True]]) if len(last) else last, last)[keep]
        at = at[keep]
    return sym, at, in_run


@dataclass
class Parsed:
    """Neighbour pairs of high-level symbols, and which of them each window needs."""
    words: Words
    starts: np.ndarray  # first words of all windows
    document: np.ndarray  # of each window
    pairs: np.ndarray  # name of the pair of symbols i and i + 1
    pair_document: np.ndarray
    first: np.ndarray  # of each window: its first pair
    end: np.ndarray  # and the end of its pairs; not beyond first: always verified


def parse(texts, size: int) -> Parsed:
    w = split_words(texts)
    rounds = n_rounds(size)
    sym, at, in_run = recompress(w, rounds)
    doc = w.document
    n = len(w.low)
    starts = np.arange(max(n - size + 1, 0))
    starts = starts[doc[starts] == doc[starts + size - 1]] if len(starts) else starts
    wide = 2 ** rounds
    same = (w.low[1:] == w.low[:-1]) & (doc[1:] == doc[:-1]) if n else np.zeros(0, dtype=bool)
    # equal words from each end of the window inwards, up to the run length
    left, right = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
    more_l, more_r = np.ones(len(starts), dtype=bool), np.ones(len(starts), dtype=bool)
    for k in range(min(RUN, size) - 1):
        more_l &= same[starts + k]
        more_r &= same[starts + size - 2 - k]
        left += more_l
        right += more_r
    low, high = starts + wide + left, starts + size - wide - right  # the middle: words [low, high)
    holder = np.searchsorted(at, np.arange(n), side="right") - 1 if n else np.zeros(0, dtype=np.int64)
    usable = high > low
    first = np.where(usable, holder[np.minimum(low, n - 1)] if n else 0, 0)
    end = np.where(usable, holder[np.minimum(np.maximum(high - 1, 0), n - 1)] if n else 0, 0)
    if in_run.any():
        before = np.concatenate([[0], np.cumsum(in_run)])
        touched = before[starts + size] > before[starts]
        end = np.where(touched, first, end)
    pairs, owner = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    if len(sym) > 1:
        pairs, owner = mixed(sym[:-1] * _ODD ^ mixed(sym[1:], 101), 102), doc[at[:-1]]
        # what stands across two documents depends on the order in which they come: one name for all, and no window asks for it
        pairs[doc[at[1:]] != owner] = 0
    return Parsed(w, starts, doc[starts] if len(starts) else starts, pairs, owner, first, end)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and, for each key given, its place among them."""
    coded = pa.array(keys).dictionary_encode()
    values = coded.dictionary.to_numpy()
    order = np.argsort(values)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return values[order], rank[coded.indices.to_numpy()]


def _asks(chunk, keys: np.ndarray, vals: np.ndarray, n_buckets: int, pack=np.ndarray.tobytes) -> pa.Table:
    cut = bucket_slices(keys, n_buckets)
    return pa.table({
        "chunk": pa.array([chunk] * len(cut), pa.int32()), "bucket": pa.array([b for b, _, _ in cut], pa.int32()),
        "keys": pa.array([keys[i:j].tobytes() for _, i, j in cut], pa.binary()),
        "vals": pa.array([pack(vals[i:j]) for _, i, j in cut], pa.binary())})


def pair_asks(p: Parsed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of a chunk, whether two of its documents hold each, and the place of each pair among them."""
    keys, place = _distinct(p.pairs)
    lowest = np.full(len(keys), np.iinfo(np.int64).max)
    highest = np.full(len(keys), -1)
    np.minimum.at(lowest, place, p.pair_document)
    np.maximum.at(highest, place, p.pair_document)
    return keys, (highest > lowest), place


def shared_bits(keys: list[np.ndarray], vals: list[bytes]) -> list[bytes]:
    """For each chunk's keys: does another chunk, or another document of this one, have the pair?"""
    every = np.concatenate(keys)
    within = np.concatenate([np.frombuffer(v, dtype=np.bool_) for v in vals])
    order = np.argsort(every)
    head = np.concatenate([[True], every[order][1:] != every[order][:-1]])
    group = np.cumsum(head) - 1
    shared = np.bincount(group) > 1
    shared[group[within[order]]] = True
    out = np.empty(len(every), dtype=bool)
    out[order] = shared[group]
    cut = np.cumsum([len(k) for k in keys])[:-1]
    return [x.tobytes() for x in np.split(out, cut)]


def candidates(p: Parsed, replies: list[bytes]) -> np.ndarray:
    """Places of the windows whose middle has shared pairs only."""
    keys, _, place = pair_asks(p)
    shared = np.frombuffer(b"".join(replies), dtype=np.bool_) if replies else np.zeros(len(keys), dtype=bool)
    lone = np.concatenate([[0], np.cumsum(~shared[place])])
    return np.flatnonzero(lone[np.maximum(p.end, p.first)] == lone[p.first])


def window_keys(p: Parsed, at: np.ndarray, size: int, ids: np.ndarray, known: np.ndarray):
    """Distinct window hashes (128 bits) of documents with an id, the smallest id of each, and the windows they stand for."""
    at = at[known[p.document[at]]]
    a, b = np.zeros(len(at), dtype=np.uint64), np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        a = mixed(a * _ODD + p.words.low[p.starts[at] + k], 7)
        b = mixed(b * _ODD + p.words.high[p.starts[at] + k], 8)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    head = np.ones(len(a), dtype=bool)
    head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(head)
    owner = ids[p.document[at]]
    least = np.minimum.reduceat(owner[order], first) if len(first) else np.zeros(0, dtype=np.int64)
    place = np.empty(len(at), dtype=np.int64)
    place[order] = np.cumsum(head) - 1
    return a[first], b[first], least, at, place, owner


def smaller_bits(keys: list[np.ndarray], vals: list[bytes]) -> list[bytes]:
    """For each chunk's windows: does a document with a smaller id than the chunk's smallest have it?"""
    a = np.concatenate(keys)
    rest = np.concatenate([np.frombuffer(v, dtype=np.uint64).reshape(-1, 2) for v in vals])
    b, least = rest[:, 0], rest[:, 1].astype(np.int64)
    order = np.lexsort((b, a))
    head = np.ones(len(a), dtype=bool)
    head[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    first = np.flatnonzero(head)
    lowest = np.minimum.reduceat(least[order], first)
    out = np.empty(len(a), dtype=bool)
    out[order] = lowest[np.cumsum(head) - 1] < least[order]
    cut = np.cumsum([len(k) for k in keys])[:-1]
    return [x.tobytes() for x in np.split(out, cut)]


def _ids(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = table["id"].combine_chunks()
    return pc.fill_null(column, 0).to_numpy(), pc.is_valid(column).to_numpy(zero_copy_only=False)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 13,
                   chunk_bytes: int = 4 << 20, bucket_bytes: int = 12 << 20) -> DataFrame:
    """Rows (id, n_words, n_removed, kept): the words left when repeats of earlier documents' windows are cut out."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    total = text_bytes(rows)
    n_chunks, n_buckets = total // chunk_bytes + 1, total // bucket_bytes + 1
    rows = rows.withColumn("key", F.struct("id", "text"))
    rows = chunked(rows, "key", n_chunks).select("chunk", "id", "text")

    def reveal(table: pa.Table) -> pa.Table:
        keys, within, _ = pair_asks(parse(hidden(table)["text"], size))
        return _asks(table["chunk"][0].as_py(), keys, within, n_buckets)

    def hidden(table: pa.Table) -> pa.Table:
        """Texts of rows without an id are not compared."""
        known = pc.is_valid(table["id"])
        return table.set_column(table.schema.get_field_index("text"), "text", pc.if_else(known, table["text"], None))

    def verify(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table):
            return _asks(0, np.zeros(0, dtype=np.uint64), np.zeros((0, 2), dtype=np.uint64), 1)
        ids, known = _ids(table)
        p = parse(hidden(table)["text"], size)
        a, b, least, *_ = window_keys(p, candidates(p, by_bucket(replies)), size, ids, known)
        return _asks(table["chunk"][0].as_py(), a, np.column_stack([b, least.astype(np.uint64)]), n_buckets)

    def remove(table: pa.Table, replies: pa.Table) -> pa.Table:
        ids, known = _ids(table)
        p = parse(hidden(table)["text"], size)
        step = replies["step"]
        at = candidates(p, by_bucket(replies.filter(pc.equal(step, 1))))
        _, _, least, at, place, owner = window_keys(p, at, size, ids, known)
        bits = by_bucket(replies.filter(pc.equal(step, 2)))
        smaller = np.frombuffer(b"".join(bits), dtype=np.bool_) if bits else np.zeros(len(least), dtype=bool)
        gone = p.starts[at[smaller[place] | (owner > least[place])]]
        w = p.words if known.all() else split_words(table["text"])
        edge = np.zeros(len(w.low) + 1, dtype=np.int32)
        if known.all():
            np.add.at(edge, gone, 1)
            np.add.at(edge, gone + size, -1)
        else:  # words of rows without an id stand between the compared ones
            shift = w.starts[:-1] - p.words.starts[:-1]
            moved = gone + shift[p.words.document[gone]] if len(gone) else gone
            np.add.at(edge, moved, 1)
            np.add.at(edge, moved + size, -1)
        stay = np.cumsum(edge)[:-1] == 0
        left = np.concatenate([[0], np.cumsum(stay)])[w.starts]
        kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), w.flat.filter(pa.array(stay))), " ")
        n = np.diff(w.starts)
        return pa.table({"id": table["id"], "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(n - np.diff(left), pa.int64()),
                         "kept": kept.cast(pa.string())})

    shared = round_trip(rows.groupBy("chunk").applyInArrow(reveal, ASKS), shared_bits, "shared-pairs")
    asks = rows.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(verify, ASKS)
    smaller = round_trip(asks, smaller_bits, "smaller-windows")
    replies = shared.withColumn("step", F.lit(1)).unionByName(smaller.withColumn("step", F.lit(2)))
    return rows.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
        remove, "id long, n_words long, n_removed long, kept string")
