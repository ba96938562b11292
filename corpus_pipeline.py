"""A training-corpus pipeline: each stage reads what the stage before it kept, and its decisions take effect.

All stages read whole texts, whatever their length, and pass on columns of any name. An empty table gives an empty table. Decisions are made from a row's
id and text, so repeated rows share theirs; where a stage keeps one of them, that is said below.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm import common, decontaminate, mixing, near, queries, secrets, toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from ``labels``, calls toxic go.

    Null and empty texts are judged as texts without words, rows with a null id as others are. A score at the threshold itself goes. Where the
    labels are of one kind only, all rows go if it is toxic, else none.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more.

    The smallest id of a group stays, and one row of a repeated row. Null and empty texts and texts of blanks are in no group, so they stay; rows with a null id
    stay too.
    """
    return near.keep_one(docs, size=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go.

    Null and empty texts have no words and stay; of rows with a null id those go whose own text has a passage.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are replaced, and the length column follows.

    A null text stays null, and its length is null then; rows with a null id and repeated rows are cleaned like all others.
    """
    clean = secrets.redact_documents(docs)
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast("bigint")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: rows of (document, epoch) with the text that is taken.

    Texts without words, null ones included, are never taken. Null languages and sources are nodes named ''. Repeated rows are taken as often as they stand there;
    equal places in the seeded order are settled by the text.
    """
    chosen = mixing.mix(docs, queries.mix_levels(), queries.MIX_WEIGHTS, queries.MIX_PART, queries.MIX_EPOCHS, queries.MIX_SEED)
    return mixing.with_texts(chosen, docs).drop("th")


STAGES = [
    ("toxicity", without_toxic),
    ("near duplicates", without_near_copies),
    ("benchmark decontamination", decontaminated),
    ("secret scan", without_secrets),
    ("mixing", mixed),
]
#: toxicity is a trained model and near duplicates come from iterated joins, so there is no SQL twin
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{common.scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
