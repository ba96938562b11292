"""Queries over the operators of this subpackage, with production parameters, and their SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, language, language_model, mixing, near, nearest, negatives, passages, secrets, sharding, toxicity, whitening
from .common import crc_fold
from .oracles import CHAT_SQL, DECONTAMINATE_SQL, NEGATIVES_SQL, PASSAGES_SQL, SECRETS_SQL, mixing_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f
    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- 1: mixing -------------------------------------------------------------------------------------------

MIX_LEVELS = ("domain", "lang", "source")
MIX_WEIGHTS = {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 6, "domain0/en": 2, "domain1/de": 3, "domain3/es": 9, "domain2/fr": 0}
MIX_PART, MIX_EPOCHS, MIX_SEED = 0.75, 2, 17


def mix_levels() -> dict:
    """Sources are grouped to four domains by their number; sources without one are a domain of their own."""
    number = F.regexp_extract("source", "([0-9]+)$", 1)
    domain = F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("domain"), (number.cast("int") % 4).cast("string")))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


@_query(mixing_sql(MIX_WEIGHTS, MIX_PART, MIX_EPOCHS, MIX_SEED))
def op1_mix_sources(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, mix_levels(), MIX_WEIGHTS, MIX_PART, MIX_EPOCHS, MIX_SEED)
    return mixed.select("doc_id", *MIX_LEVELS, "epoch", "n_tokens", "take")


# -- 2: repeated passages -----------------------------------------------------------------------------------

@_query(PASSAGES_SQL)
def op2_remove_repeats(spark, sf_dir):
    out = passages.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


# -- 3: nearest neighbours -----------------------------------------------------------------------------------

@_query()
def op3_nearest(spark, sf_dir):
    return nearest.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


# -- 4: language model ----------------------------------------------------------------------------------------

@_query()
def op4_language_model(spark, sf_dir):
    return language_model.score_documents(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


# -- 5: near duplicates --------------------------------------------------------------------------------------

@_query()
def op5_near_duplicates(spark, sf_dir):
    out = near.near_components(_table(spark, sf_dir, "documents"), size=3, percent=85)
    kept = F.col("component").isNull() | (F.col("id") == F.col("component"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


# -- 6: decontamination -----------------------------------------------------------------------------------

@_query(DECONTAMINATE_SQL)
def op6_decontaminate(spark, sf_dir):
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.col("n_hit").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


# -- 7: secrets ---------------------------------------------------------------------------------------------

@_query(SECRETS_SQL)
def op7_scan_secrets(spark, sf_dir):
    found, _ = secrets.scan_versions(_table(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.BASE_RULES]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base_spans = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select(
        F.col("path").alias("doc_id"), *[count(k) for k in base],
        F.sha2(secrets.spans_text(base_spans), 256).alias("base_sha256"), secrets.spans_text(F.col("spans")).alias("spans"))


# -- 8: toxicity ----------------------------------------------------------------------------------------------

@_query()
def op8_score_toxicity(spark, sf_dir):
    out = toxicity.score_toxicity(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.col("_held_out").alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))


# -- 9: chat -------------------------------------------------------------------------------------------------

def chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's turn rows as records, and conversation -1 in another layout."""
    rows = _table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("turn"),
        F.to_json(F.struct(F.lit(said).alias("prompt"), F.lit(said).alias("response"))).alias("record"))
    return rows.unionByName(extra)


@_query(CHAT_SQL)
def op9_format_chat(spark, sf_dir):
    out = chat.formatted(chat.canonical_turns(chat_records(spark, sf_dir), strict=True))
    turns, under = chat.read_back(F.col("formatted")), chat.loss_texts(F.col("formatted"), F.col("loss"))
    read = out.select("conv_id", turns.alias("turns"), under.alias("under"), F.char_length("formatted").cast("bigint").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.char_length("under").cast("bigint").alias("loss_chars"), F.sha2(F.encode("under", "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars")


# -- 10: language -------------------------------------------------------------------------------------------

def language_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, with their source as host, and pages, with what their markup and address say."""
    docs, pages = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages")
    none = lambda kind: F.lit(None).cast(kind)
    host = language.host_of(F.col("url"))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), none("bigint").alias("page_id"), F.coalesce(crc_fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        none("string").alias("declared"), none("string").alias("suffix"), none("string").alias("domain"), F.col("source").alias("host"), "text",
    ).unionByName(pages.select(
        none("bigint").alias("doc_id"), F.col("page_id").cast("bigint").alias("page_id"), F.lit(True).alias("held_out"),
        language.declared_language(F.col("html")).alias("declared"), language.address_suffix(F.col("url")).alias("suffix"),
        F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"), host.alias("host"), language.page_text(F.col("html")).alias("text")))


@_query()
def op10_identify_language(spark, sf_dir):
    labelled = _table(spark, sf_dir, "documents").where(F.coalesce(crc_fold(F.col("doc_id"), 3) != 1, F.lit(True))).select("lang", "text")
    return language.identify(language_rows(spark, sf_dir), labelled).select("doc_id", "page_id", "held_out", "declared", "suffix", "host", "lang", "score")


# -- 11: hard negatives -------------------------------------------------------------------------------------

@_query(NEGATIVES_SQL)
def op11_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)


# -- 12: whitening ------------------------------------------------------------------------------------------

@_query()
def op12_whiten(spark, sf_dir):
    out = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    # a deviation beyond 64 bits (some millions of rows) has no bigint
    return out.select(F.col("id").alias("vec_id"), "component", "n", F.col("deviation").try_cast("bigint").alias("deviation"), "whitened", "explained", "identity_error")


# -- 13: sharding -------------------------------------------------------------------------------------------

@_query()
def op13_shard(spark, sf_dir):
    out, _ = sharding.shard_records(_table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("position").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("slot").alias("virtual_slot"))
