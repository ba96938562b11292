"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of toxic words at several strengths, their nearness to the second person, rates of capitals, exclamation and other
marks, digits, and obfuscation. The lexicon is a short fixed list and beginnings of words (3 to 6 letters) whose share of toxic training
documents is far above that of others. A beginning must stand in 0.5 % of the toxic training documents, so the lexicon cannot outgrow
200 times the beginnings of one average document, and is broadcast with the task.

Training rows fall in three folds. Trees learn on the first two, with the lexicon of the other one, so that no row meets a lexicon that
has seen it; the third fold calibrates margins to probabilities, with the lexicon of both, which scoring uses too. Labels are read from at most
``SAMPLE`` documents, chosen by a hash (documented bound of the fit); every document is scored, whole.

Defined results. Null and empty texts are texts without words and get the score of such. With no label of either kind there is nothing to learn:
every score is the share of toxic labels, or 0 without any. Several labels of one document count once, as the highest; null labels do not count.
Rows with a null id are scored. Repeated rows get equal scores. All columns of the input come back, with three more.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_proven, crc_fold, stored

#: most labelled documents that a model is fitted on
SAMPLE = 20_000
# Insults any corpus of English may hold, and second persons
INSULTS = frozenset("idiot moron stupid dumb trash scum loser pathetic worthless disgusting clown filth vermin imbecile".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine euch tu toi ton ta te ti tus vous votre usted".split())
LETTERS = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6)
STRENGTHS = (1.0, 2.0, 3.0)
NEAR = 5
COUNTED = {  # Arrow counts these over whole batches
    "caps": r"\p{Lu}", "loud": r"[!?]", "marks": r"[^\p{L}\p{N}\s]", "digits": r"\p{Nd}",
    "masked": r"\p{L}[0-9@$*!|]+\p{L}", "spaced": r"(?:\b\p{L}[.\-_ ]){3,}",
}
FEATURES = ["n_words", *[f"density_{i}" for i in range(len(STRENGTHS))], "weight", "strongest", "hits", "insults", "near_second", *COUNTED]
OUT = ("_held_out", "_score", "_predicted")


def beginnings(word: str) -> list[str]:
    return [word[:k] for k in PREFIXES if len(word) >= k]


def learn_lexicons(rows: DataFrame) -> dict[tuple[int, ...], dict[str, float]]:
    """Log odds of word beginnings for the folds (0,), (1,) and (0, 1); rows have (fold, toxic, text)."""
    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for fold, toxic, text in zip(b.column("fold").to_pylist(), b.column("toxic").to_pylist(), b.column("text").to_pylist()):
                words = set(LETTERS.findall((text or "").lower()))
                seen.update((fold, toxic, g) for g in {g for w in words for g in beginnings(w)})
                seen[fold, toxic, ""] += 1
        keys = list(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()),
             pa.array([seen[k] for k in keys], pa.int64())], ["fold", "toxic", "g", "n"])

    counts = rows.where("fold < 2").select("fold", "toxic", "text").mapInArrow(count, "fold int, toxic int, g string, n long")
    counts = counts.groupBy("g").pivot("fold", [0, 1]).agg(
        F.coalesce(F.sum(F.when(F.col("toxic") == 1, F.col("n"))), F.lit(0)).alias("t"), F.coalesce(F.sum(F.when(F.col("toxic") == 0, F.col("n"))), F.lit(0)).alias("c"))
    counts = stored(counts.select("g", *[F.coalesce(f"{f}_{k}", F.lit(0)).alias(f"{k}{f}") for f in (0, 1) for k in "tc"]), "beginnings")
    totals = counts.where("g = ''").first()
    out = {}
    for folds in ((0,), (1,), (0, 1)):
        t, c = sum(F.col(f"t{f}") for f in folds), sum(F.col(f"c{f}") for f in folds)
        nt, nc = (sum(totals[f"{k}{f}"] for f in folds) if totals else 0 for k in "tc")
        odds = F.log((t + 0.5) / (nt + 1)) - F.log((c + 0.5) / (nc + 1))
        kept = counts.where((F.col("g") != "") & (t >= max(3, math.ceil(nt * 0.005)))).select("g", odds.alias("o")).where(f"o >= {STRENGTHS[0]}")
        out[folds] = {r["g"]: r["o"] for r in kept.collect()}
    return out


def _word_features(text: str, lexicon: dict[str, float], memo: dict[str, float]) -> tuple:
    words = LETTERS.findall(text.lower())
    n = len(words)
    counts = Counter(words)
    hits, total, strongest, insults = [0] * len(STRENGTHS), 0.0, 0.0, 0
    bad = set()
    for w, k in counts.items():
        o = memo.get(w)
        if o is None:
            o = max((lexicon.get(g, 0.0) for g in beginnings(w)), default=0.0)
            if w in INSULTS:
                o = max(o, STRENGTHS[-1])
            memo[w] = o
        if o:
            total += o * k
            strongest = max(strongest, o)
            for i, s in enumerate(STRENGTHS):
                if o >= s:
                    hits[i] += k
            if o >= STRENGTHS[-1]:
                bad.add(w)
            if w in INSULTS:
                insults += k
    near = 0
    if bad and not SECOND.isdisjoint(counts):
        last_you, last_bad = -NEAR - 1, []
        for i, w in enumerate(words):
            if w in SECOND:
                last_you = i
                near += sum(i - j <= NEAR for j in last_bad)
                last_bad = []
            elif w in bad:
                if i - last_you <= NEAR:
                    near += 1
                else:
                    last_bad = [j for j in last_bad if i - j <= NEAR] + [i]
    d = max(n, 1)
    return (math.log1p(n), *[h / d for h in hits], total / d, strongest, math.log1p(hits[-1]), insults / d, near / d)


def with_features(rows: DataFrame, lexicons: dict[int, dict[str, float]], text: str = "text", which: str | None = None,
                  prefix: str = "_toxic_") -> DataFrame:
    """All columns and the features; ``which`` names a column that picks the lexicon of a row, else lexicon 0 serves all."""
    schema = T.StructType([*rows.schema.fields, *[T.StructField(prefix + f, T.DoubleType()) for f in FEATURES]])
    names = rows.columns

    def run(batches: Iterable[pa.RecordBatch]):
        memos: dict[int, dict[str, float]] = {k: {} for k in lexicons}
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                b = whole.slice(i, 500)
                texts = pc.fill_null(b.column(names.index(text)), "")
                if isinstance(texts, pa.ChunkedArray):
                    texts = texts.combine_chunks()
                picks = b.column(names.index(which)).to_pylist() if which else [0] * b.num_rows
                made = []
                for x, p in zip(texts.to_pylist(), picks):
                    made.append(_word_features(x, lexicons[p], memos[p]))
                    if len(memos[p]) > 300_000:  # memory, not results: words are looked up anew
                        memos[p].clear()
                f = np.array(made, dtype=float).reshape(len(picks), len(FEATURES) - len(COUNTED))
                chars = np.maximum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), 1)
                rates = [pc.count_substring_regex(texts, pattern=p).to_numpy(zero_copy_only=False) / chars for p in COUNTED.values()]
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, *[pa.array(f[:, j]) for j in range(f.shape[1])], *[pa.array(r) for r in rates]], [x.name for x in schema])

    return rows.mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 3, held: int = 1,
                   cut: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """All rows and columns of ``docs`` with ``_held_out``, ``_score`` and ``_predicted``, which replace columns of these names.

    Labels count only where crc32 of the id's text modulo ``folds`` is not ``held``.
    """
    prefix = "_toxic_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    own = [c for c in docs.columns if c.lower() not in OUT]
    learnt = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    learnt = stored(learnt.where(crc_fold(F.col("doc_id"), folds) != held), "labels")
    n = learnt.count()
    if n > sample:
        learnt = learnt.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    learnt = learnt.select(F.col("doc_id").alias("_id"), "toxic", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(3)).cast("int").alias("fold"))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(broadcast_if_proven(learnt, 32), "_id")
    rows = stored(rows.select("text", "toxic", "fold"), "labelled")

    kinds = {(r["fold"] < 2, r["toxic"]): r["count"] for r in rows.groupBy("fold", "toxic").count().collect()}
    held_out = F.coalesce(crc_fold(F.col(doc_id), folds) == held, F.lit(False))
    if not all(k in kinds for k in ((True, 0), (True, 1), (False, 0), (False, 1))):
        share = rows.agg(F.avg("toxic").alias("s")).first()["s"] or 0.0
        return docs.select(*own, held_out.alias("_held_out"), F.lit(share).alias("_score"), F.lit(int(share >= cut)).alias("_predicted"))

    lexicons = learn_lexicons(rows)
    byfold = {0: lexicons[1,], 1: lexicons[0,], 2: lexicons[0, 1]}
    feats = stored(with_features(rows, byfold, "text", "fold", prefix).drop("text"), "features")
    assembler = VectorAssembler(inputCols=[prefix + f for f in FEATURES], outputCol=prefix + "vector")
    trees = GBTClassifier(featuresCol=prefix + "vector", labelCol="toxic", predictionCol=prefix + "class", maxIter=20, maxDepth=3, stepSize=0.3, maxBins=64, minInstancesPerNode=2, seed=1)
    trees = trees.fit(assembler.transform(feats.where("fold < 2").coalesce(6)))
    trees = trees.setRawPredictionCol(prefix + "raw").setProbabilityCol(prefix + "p")

    def margins(df: DataFrame) -> DataFrame:
        return trees.transform(assembler.transform(df)).withColumn(prefix + "margin", vector_to_array(prefix + "raw")[1])

    calibrated = IsotonicRegression(featuresCol=prefix + "margin", labelCol="toxic", predictionCol=prefix + "iso").fit(
        margins(feats.where("fold = 2")).select(prefix + "margin", F.col("toxic").cast("double").alias("toxic")))
    scored = calibrated.transform(margins(with_features(docs, {0: lexicons[0, 1]}, text, prefix=prefix)))
    score = F.least(F.greatest(F.col(prefix + "iso"), F.lit(0.0)), F.lit(1.0))
    return scored.select(*own, held_out.alias("_held_out"), score.alias("_score"), (score >= cut).cast("int").alias("_predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows that are not predicted toxic, columns as they came."""
    clean = score_toxicity(docs, labels, doc_id, text, **how).where("_predicted = 0")
    return clean.select(*docs.columns)
