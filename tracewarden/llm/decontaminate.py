"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

An item's windows are the tokens that must all be found, so the necessary prefix of a window, with its tokens ordered
by rarity in the corpus, is its single rarest token. Documents join their words with these tokens; offset and length bounds
say where the window would have to lie, and the words there are compared with the window.

Defined results. Null or empty texts have no words and no hits; items without words have no windows; an item with fewer
words than a window is one window of its own size. An item with a null id marks words but is not listed. Repeated rows
are judged each on its own and come out as often as they went in. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_blocks, stored, union_all, words

#: ASCII letters and digits and everything beyond ASCII make words (texts are lower-cased before)
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = 10) -> DataFrame:
    """(item, win): the distinct windows of every item; shorter items are one window."""
    w = items.select(F.col(item_id).alias("item"), words(ascii_lower(F.col(text)), BETWEEN).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    return w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, size))).alias("win")).distinct()


def rare_prefixes(windows: DataFrame, doc_words: DataFrame, block_bytes: int) -> DataFrame:
    """Add each window's rarest word and where in the window it stands; rarity is counted over all documents."""
    wins = windows.select("win").distinct()
    vocabulary = wins.select(F.explode("win").alias("word")).distinct()
    seen = union_all([
        doc_words.select(F.explode("words").alias("word")).join(part, "word").groupBy("word").agg(F.count("*").alias("n"))
        for part in broadcast_blocks(vocabulary, F.octet_length("word") + 16, F.col("word"), block_bytes)])
    placed = wins.select("win", F.posexplode("win").alias("off", "word")).join(seen, "word", "left")
    rarest = placed.groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "off")).alias("r"))
    return rarest.select("win", F.col("r.word").alias("word"), F.col("r.off").alias("off"), F.size("win").alias("len"))


def benchmark_hits(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   size: int = 10, block_bytes: int = 32 << 20) -> tuple[DataFrame, DataFrame]:
    """Slim documents (id, th, n_words) and all occurrences (id, th, start, len, item) of item windows."""
    doc_words = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("th"),
                            words(ascii_lower(F.col(text)), BETWEEN).alias("words"))
    windows = stored(item_windows(items, size=size), "item-windows")
    prefixes = stored(rare_prefixes(windows, doc_words, block_bytes), "rare-prefixes")
    found = []
    for part in broadcast_blocks(prefixes, 40 * F.col("len"), F.col("word"), block_bytes):
        at = doc_words.select("id", "th", "words", F.posexplode("words").alias("pos", "word"))
        start = F.col("pos") - F.col("off")
        found.append(
            at.join(part, "word")
            .where((start >= 0) & (start + F.col("len") <= F.size("words")))
            .where(F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("len")) == F.col("win"))
            .select("id", "th", start.alias("start"), "len", "win"))
    hits = union_all(found).join(windows, "win").select("id", "th", "start", "len", "item")
    return doc_words.select("id", "th", F.size("words").alias("n_words")), hits


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  size: int = 10, block_bytes: int = 32 << 20) -> DataFrame:
    """Per document: id, th (hash of the text), n_words, n_hit and the ids of the items found in it, sorted as strings."""
    slim, hits = benchmark_hits(docs, items, doc_id, text, size, block_bytes)
    per_doc = hits.groupBy("id", "th").agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("end")))).alias("spans"),
        F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["end"]), F.lit(0))).alias("n"),
            F.greatest(a["end"], s["end"]).alias("end")),
        lambda a: a["n"])
    per_doc = per_doc.select(F.col("id").alias("_i"), F.col("th").alias("_t"), covered.alias("n_hit"), "items")
    joined = slim.join(per_doc, F.col("id").eqNullSafe(F.col("_i")) & (F.col("th") == F.col("_t")), "left")
    return joined.select(
        "id", "th", F.col("n_words").cast("bigint").alias("n_words"), F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Documents without any benchmark window, columns as they came."""
    bad = contamination(docs, items, doc_id, text, **how).where("n_hit > 0").select(
        F.col("id").alias("_i"), F.col("th").alias("_t")).distinct()
    return docs.join(bad, docs[doc_id].eqNullSafe(bad["_i"]) & (F.xxhash64(docs[text]) == bad["_t"]), "left_anti")
