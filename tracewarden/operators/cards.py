"""Agent cards: parsing, inspectable fields, structural checks, signature trust."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.asof import broadcast_if_small
from tracewarden.schema import FINDING

CARD = (
    "name string, description string, url string, provider struct<organization:string,url:string>, version string, "
    "skills array<struct<id:string,name:string,description:string,tags:array<string>>>, signature string, _bad string"
)


def parse_card(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``card``, ``status`` and ``reason``; a card needs a name."""
    text = F.coalesce(F.col(raw), F.lit(""))
    card = F.col("card")
    reason = (
        F.when(F.octet_length(text) == 0, F.lit("empty card body"))
        .when(card.isNull() | card["_bad"].isNotNull() | ~F.trim(text).startswith("{"), F.lit("parse card"))
        .when(F.coalesce(card["name"], F.lit("")) == "", F.lit("card missing name"))
    )
    return (
        df.withColumn("card", F.from_json(text, CARD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
        .withColumn("reason", reason)
        .withColumn("status", F.when(F.col("reason").isNull(), F.lit("ok")).otherwise(F.lit("malformed")))
    )


def _field(name: Column | str, value: Column) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    return F.struct(name.alias("name"), value.alias("value"))


def extract_card_fields(df: DataFrame, card: str = "card") -> DataFrame:
    """Add ``fields`` with the inspectable strings of a card; empty ones are left out (tags stay)."""
    c = F.col(card)
    top = F.array(
        _field("card.name", c["name"]), _field("card.description", c["description"]), _field("card.url", c["url"]),
        _field("card.provider.organization", c["provider"]["organization"]))
    keep = lambda f: F.coalesce(f["value"], F.lit("")) != ""

    def of_skill(skill: Column, i: Column) -> Column:
        base = F.concat(F.lit("card.skills."), i.cast("string"))
        named = F.filter(F.array(
            _field(F.concat(base, F.lit(".name")), skill["name"]),
            _field(F.concat(base, F.lit(".description")), skill["description"])), keep)
        tags = F.transform(
            F.coalesce(skill["tags"], F.array().cast("array<string>")),
            lambda t, j: _field(F.concat(base, F.lit(".tags."), j.cast("string")), t))
        return F.concat(named, tags)

    none = F.array().cast("array<struct<name:string,value:string>>")
    skills = F.coalesce(F.flatten(F.transform(c["skills"], of_skill)), none)
    return df.withColumn("fields", F.concat(F.filter(top, keep), skills))


def validate_card(df: DataFrame, card: str = "card") -> DataFrame:
    """Add ``errors``, ``warnings`` and ``signature_present``."""
    c = F.col(card)
    text = lambda name: F.coalesce(c[name], F.lit(""))
    skills = F.coalesce(c["skills"], F.array().cast(
        "array<struct<id:string,name:string,description:string,tags:array<string>>>"))
    nameless = F.array_compact(F.transform(skills, lambda s, i: F.when(
        (F.coalesce(s["id"], F.lit("")) == "") & (F.coalesce(s["name"], F.lit("")) == ""),
        F.concat(F.lit("skill["), i.cast("string"), F.lit("] has neither id nor name")))))
    warnings = F.array_compact(F.array(
        F.when((text("url") != "") & ~text("url").startswith("https://") & ~text("url").startswith("http://"),
               F.lit("url is not http(s)")),
        F.when(text("version") == "", F.lit("version is empty")),
        F.when(F.size(skills) == 0, F.lit("no skills declared"))))
    return (
        df.withColumn("errors", F.array_compact(F.array(F.when(
            F.trim(text("name")) == "", F.lit("name is empty")))))
        .withColumn("warnings", F.concat(warnings, nameless))
        .withColumn("signature_present", text("signature") != "")
    )


def card_trust(cards: DataFrame, trust_store: DataFrame, verified: str = "signature_ok") -> DataFrame:
    """Add ``trust_finding`` from the trusted issuers (``issuer``) and a checked-signature column.

    The signature bytes are verified outside; ``verified`` says whether they held. The store is
    broadcast only when its size is small.
    """
    issuer = F.coalesce("card.provider.organization", F.lit(""))
    store = broadcast_if_small(trust_store.select(F.col("issuer").alias("_issuer")).distinct())
    joined = cards.withColumn("_by", F.nullif(issuer, F.lit(""))).join(store, F.col("_by") == F.col("_issuer"), "left")

    def finding(rule: str, category: str, severity: str, text: Column) -> Column:
        return F.struct(
            F.lit(rule).alias("rule_id"), F.lit(category).alias("category"), F.lit(severity).alias("severity"),
            text.alias("description"), F.lit("").alias("match"), F.lit("card.signature").alias("field"),
            F.lit(1.0).alias("confidence"), F.create_map().cast("map<string,string>").alias("metadata")).cast(FINDING)

    why = (
        F.when(F.col("_by").isNull(), F.lit("trust: card has no declared issuer"))
        .when(F.col("_issuer").isNull(), F.concat(F.lit('trust: unknown issuer "'), "_by", F.lit('"')))
        .when(~F.coalesce(F.col(verified), F.lit(False)), F.lit("trust: signature does not verify"))
    )
    trust = (
        F.when(~F.col("signature_present"), finding(
            "card.signature_missing", "policy", "low",
            F.lit("card declared no signature; provenance is unverified")))
        .when(F.col("_why").isNotNull(), finding("card.signature_invalid", "tool-poisoning", "high", F.col("_why")))
        .otherwise(finding("card.signature_verified", "policy", "info",
                           F.lit("card signature verified against trust store")))
    )
    return joined.withColumn("_why", why).withColumn("trust_finding", trust).drop("_by", "_issuer", "_why")
