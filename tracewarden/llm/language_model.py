"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of order two, one and zero: P(w | h) = a c(h, w) / c(h) + b c(w) / N + e / (V + 1). The weights
depend on the bucket of the context's frequency (powers of two) and are learned by expectation-maximisation on held-out counts: each chunk of
training documents is held out in turn, its counts are taken off the corpus counts, and its tokens are predicted by the rest.

Counts live in Spark: a chunk sends its distinct words and pairs of neighbours with its own counts, buckets of the key space add them up over
all chunks, and each chunk gets back the totals of its own keys. Keys are 64-bit hashes. A chunk names a key once, so frequent words are no
hot spots. The histogram that EM works on has a bounded number of cells (frequency bucket, and probabilities in steps of a quarter in log).

Defined results. A null text is an empty text, which is one token, the end. Rows with a null id train and are not held out. Repeated rows count as often as they
stand there. With no training documents N and V are 0 and the model is the uniform estimate. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bucket, chunked, crc_fold, from_planes, planes, round_trip, stored, text_bytes
from .passages import ASKS, _asks, _distinct, mixed, split_words

_ODD = np.uint64(0x9E3779B97F4A7C15)
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
STEP = 0.25
BUCKETS = 40
LOW = 160  # the least log probability that a cell tells apart is -LOW * STEP


@dataclass
class Tokens:
    word: np.ndarray  # all tokens, ends included, document after document
    context: np.ndarray
    starts: np.ndarray

    @property
    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


def tokens(texts) -> Tokens:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    w = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    n_docs = len(w.starts) - 1
    starts = w.starts + np.arange(n_docs + 1)
    word = np.full(len(w.low) + n_docs, END, dtype=np.uint64)
    word[np.arange(len(w.low)) + w.document] = w.low
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[starts[:-1]] = BEGIN
    return Tokens(word, context, starts)


@dataclass
class Counted:
    """A chunk's distinct words and pairs, its own training counts, and where each token's keys are."""
    words: np.ndarray
    word_at: np.ndarray
    pairs: np.ndarray
    pair_at: np.ndarray
    own_words: np.ndarray
    own_pairs: np.ndarray
    begins: int


def counted(t: Tokens, training: np.ndarray) -> Counted:
    words, word_at = _distinct(t.word)
    pairs, pair_at = _distinct(mixed(t.context * _ODD ^ mixed(t.word, 21), 22))
    train = training[t.document]
    return Counted(words, word_at, pairs, pair_at, np.bincount(word_at[train], minlength=len(words)), np.bincount(pair_at[train], minlength=len(pairs)), int(training.sum()))


def add_up(keys: list[np.ndarray], vals: list[bytes]) -> list[bytes]:
    every = np.concatenate(keys)
    own = np.concatenate([from_planes(v, np.uint32) for v in vals]).astype(np.uint64)
    order = np.argsort(every)
    head = np.concatenate([[True], every[order][1:] != every[order][:-1]])
    total = np.add.reduceat(own[order], np.flatnonzero(head))
    out = np.empty(len(every), dtype=np.uint64)
    out[order] = total[np.cumsum(head) - 1]
    return [planes(x) for x in np.split(out, np.cumsum([len(k) for k in keys])[:-1])]


def types_and_tokens(keys: list[np.ndarray], vals: list[bytes], replies: list[bytes]) -> bytes:
    """How many keys of a bucket were counted at all, and the sum of all counts, as two big-endian numbers."""
    every, at = np.unique(np.concatenate(keys), return_index=True)
    seen = np.concatenate([from_planes(r, np.uint64) for r in replies])[at]
    tokens = sum(int(from_planes(v, np.uint32).sum(dtype=np.uint64)) for v in vals)
    return int((seen > 0).sum()).to_bytes(8, "big") + tokens.to_bytes(8, "big")


def _totals(replies: pa.Table, word_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Corpus counts of the chunk's words and pairs."""
    is_word = pc.less(replies["bucket"], word_buckets)
    return tuple(np.concatenate([np.zeros(0, dtype=np.int64), *(from_planes(r, np.int64) for r in by_bucket(replies.filter(kind)))])
                 for kind in (is_word, pc.invert(is_word)))


def frequency_bucket(c: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else one more than the whole part of log2."""
    return np.where(c > 0, np.minimum(1 + np.log2(np.maximum(c, 1)).astype(int), BUCKETS - 1), 0)


def _cell(p: np.ndarray) -> np.ndarray:
    """Steps of the log probability; the last cell is zero probability."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(np.floor(-np.log(np.maximum(p, 1e-300)) / STEP), LOW - 1), LOW).astype(int)


def _value(cell: np.ndarray) -> np.ndarray:
    return np.where(cell < LOW, np.exp(-(cell + 0.5) * STEP), 0.0)


def fit_weights(hist: list, floor: float, rounds: int = 60, prior: float = 20.0) -> np.ndarray:
    """(BUCKETS, 3) weights of the pair, word and uniform estimates from rows (bucket, pair cell, word cell, tokens)."""
    weights = np.tile([0.3, 0.6, 0.1], (BUCKETS, 1))
    if hist:
        b, p2, p1, n = (np.array([r[i] for r in hist]) for i in ("b", "p2", "p1", "n"))
        p = np.column_stack([_value(p2), _value(p1), np.full(len(n), floor)])
        pooled = np.array([0.3, 0.6, 0.1])
        for _ in range(rounds):
            share = pooled * p
            pooled = (share / share.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0) / n.sum()
        for _ in range(rounds):
            share = weights[b] * p
            share = share / share.sum(axis=1, keepdims=True) * n[:, None]
            got = np.column_stack([np.bincount(b, share[:, k], BUCKETS) for k in range(3)]) + prior * pooled
            weights = got / got.sum(axis=1, keepdims=True)
    weights[0, 1] += weights[0, 0]  # an unseen context has no pair estimate
    weights[0, 0] = 0.0
    weights = np.maximum(weights, [0.0, 0.0, 1e-4])
    return weights / weights.sum(axis=1, keepdims=True)


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2,
                    chunk_bytes: int = 4 << 20, bucket_bytes: int = 8 << 20, least_chunks: int = 8) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"),
                       F.coalesce(crc_fold(F.col(doc_id), folds) == held, F.lit(False)).alias("held"))
    size = text_bytes(rows)
    n_chunks, pair_buckets = max(least_chunks, size // chunk_bytes + 1), size // bucket_bytes + 1
    word_buckets = size // (4 * bucket_bytes) + 1
    rows = chunked(rows.withColumn("key", F.struct("id", "text")), "key", n_chunks).select("chunk", "id", "text", "held")

    def training(table: pa.Table) -> np.ndarray:
        return ~table["held"].combine_chunks().to_numpy(zero_copy_only=False)

    def ask(table: pa.Table) -> pa.Table:
        c = counted(tokens(table["text"]), training(table))
        chunk = table["chunk"][0].as_py()
        words = _asks(chunk, c.words, c.own_words.astype(np.uint32), word_buckets, planes)
        pairs = _asks(chunk, c.pairs, c.own_pairs.astype(np.uint32), pair_buckets, planes)
        pairs = pairs.set_column(1, "bucket", pc.cast(pc.add(pairs["bucket"], word_buckets), pa.int32()))
        return pa.concat_tables([words, pairs])

    replies = round_trip(rows.groupBy("chunk").applyInArrow(ask, ASKS), add_up, "corpus-counts", types_and_tokens)

    number = lambda first: F.conv(F.hex(F.substring("reply", first, 8)), 16, 10).cast("long")
    facts = replies.where((F.col("chunk") == -1) & (F.col("bucket") < word_buckets)).agg(
        F.coalesce(F.sum(number(1)), F.lit(0)).alias("v"), F.coalesce(F.sum(number(9)), F.lit(0)).alias("n")).first()
    replies = replies.where("chunk >= 0")
    n_train, n_types = facts["n"], facts["v"]
    n_begin = rows.where(~F.col("held")).count()
    floor = 1.0 / (n_types + 1)

    def context_counts(t: Tokens, c: Counted, of_word: np.ndarray, begins: int) -> np.ndarray:
        """The count of each token's context."""
        out = np.empty(len(t.word), dtype=np.int64)
        out[1:] = of_word[c.word_at[:-1]]
        out[t.starts[:-1]] = begins
        return out

    def histogram(table: pa.Table, reply: pa.Table) -> pa.Table:
        schema = pa.schema([("b", pa.int32()), ("p2", pa.int32()), ("p1", pa.int32()), ("n", pa.int64())])
        if not len(table):
            return schema.empty_table()
        train = training(table)
        t = tokens(table["text"])
        c = counted(t, train)
        words, pairs = _totals(reply, word_buckets)
        words, pairs = words - c.own_words, pairs - c.own_pairs  # what the other chunks know
        left = context_counts(t, c, words, n_begin - c.begins)
        rest = max(n_train - int(c.own_words.sum()), 1)
        use = train[t.document]
        left, at2, at1 = left[use], c.pair_at[use], c.word_at[use]
        p2 = np.where(left > 0, pairs[at2] / np.maximum(left, 1), 0.0)
        key = (frequency_bucket(left) * (LOW + 1) + _cell(p2)) * (LOW + 1) + _cell(words[at1] / rest)
        cell, n = np.unique(key, return_counts=True)
        return pa.table([pa.array(cell // (LOW + 1) ** 2, pa.int32()), pa.array(cell // (LOW + 1) % (LOW + 1), pa.int32()),
                         pa.array(cell % (LOW + 1), pa.int32()), pa.array(n, pa.int64())], schema=schema)

    hist = rows.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(histogram, "b int, p2 int, p1 int, n long")
    hist = stored(hist.groupBy("b", "p2", "p1").agg(F.sum("n").alias("n")), "held-out-counts")
    weights = fit_weights(hist.collect(), floor)  # cells, a bounded number

    def score(table: pa.Table, reply: pa.Table) -> pa.Table:
        t = tokens(table["text"])
        c = counted(t, training(table))
        words, pairs = _totals(reply, word_buckets)
        context = context_counts(t, c, words, n_begin)
        mine, both = words[c.word_at], pairs[c.pair_at]
        w = weights[frequency_bucket(context)]
        p = w[:, 0] * both / np.maximum(context, 1) + w[:, 1] * mine / max(n_train, 1) + w[:, 2] * floor
        base = np.log10((mine + 1) / (n_train + n_types + 1))
        total = lambda x: np.add.reduceat(x, t.starts[:-1])  # noqa: E731  every document has its end
        return pa.table({
            "id": table["id"], "held_out": table["held"], "n_tokens": pa.array(np.diff(t.starts), pa.int64()),
            "n_known": pa.array(total((mine > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(table), n_train), pa.int64()),
            "base_score": pa.array(total(base)), "score": pa.array(total(np.log10(p)))})

    return rows.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
        score, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
