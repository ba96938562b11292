"""Routing to an external reviewer model and use of its verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.text import truncate_bytes
from tracewarden.schema import FINDING

# Confidence limits and the least field size of the routing rule.
CONFIDENT = 0.7
CONFIDENT_IN_CATEGORY = 0.85
MIN_FIELD = 64


def undecided(findings: Column | str = "findings", categories: list[str] | None = None) -> Column:
    findings = F.col(findings) if isinstance(findings, str) else findings
    if categories:
        return ~F.exists(findings, lambda f: f["category"].isin(*categories) & (f["confidence"] >= CONFIDENT_IN_CATEGORY))
    return ~F.exists(findings, lambda f: f["confidence"] >= CONFIDENT)


def judge_candidates(messages: DataFrame, categories: list[str] | None = None, min_len: int = MIN_FIELD,
                     max_len: int | None = None) -> DataFrame:
    """Messages (``msg_id, fields, findings``) worth a review, with the longest field, cut to ``max_len`` bytes on request."""
    longest = F.array_max(F.transform(
        F.filter("fields", lambda f: F.octet_length(f["value"]) >= min_len),
        # the first of equally long fields wins
        lambda f, i: F.struct(F.octet_length(f["value"]).alias("n"), (-i).alias("i"), f.alias("f"))))
    return (
        messages.where(undecided(categories=categories))
        .withColumn("_best", longest)
        .where(F.col("_best").isNotNull())
        .select("msg_id", F.col("_best.f.name").alias("field"),
                truncate_bytes(F.col("_best.f.value"), max_len).alias("content"))
    )


def parse_verdict(content: Column) -> Column:
    """Verdict struct of a model answer, code fences tolerated."""
    text = F.trim(content)
    text = F.regexp_replace(text, r"\A```(?:json)?", "")
    text = F.trim(F.regexp_replace(text, r"```\z", ""), F.lit(" \n\t\r"))
    return F.from_json(text, "verdict string, category string, confidence double, rationale string, _bad string",
                       {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})


def apply_judge_verdicts(candidates: DataFrame, verdicts: DataFrame, mode: str = "warn", model: str = "") -> DataFrame:
    """Candidates with answers (``msg_id, content, error``) -> findings.

    Only malicious verdicts count; a failed call leaves a low transport finding.
    """
    answered = candidates.select("msg_id", "field").join(
        verdicts.select("msg_id", F.col("content").alias("_answer"), F.col("error").alias("_error")), "msg_id")
    v = F.col("_v")
    broken = v.isNull() | v["_bad"].isNotNull()
    failed = F.col("_error").isNotNull() | broken
    confidence = F.coalesce(v["confidence"], F.lit(0.0))
    category = F.when(F.coalesce(v["category"], F.lit("")) == "", F.lit("prompt-injection")).otherwise(v["category"])
    why = F.coalesce(F.col("_error"), F.lit("decode judge json"))

    def finding(rule, cat, severity, text, conf, meta) -> Column:
        return F.struct(rule.alias("rule_id"), cat.alias("category"), severity.alias("severity"), text.alias("description"),
                        F.lit("").alias("match"), F.col("field").alias("field"), conf.alias("confidence"),
                        meta.alias("metadata")).cast(FINDING)

    transport = finding(
        F.lit("judge.transport_error"), F.lit("transport"), F.lit("low"), F.concat(F.lit("reviewer unreachable: "), why),
        F.lit(0.1), F.create_map(F.lit("model"), F.lit(model)))
    malicious = finding(
        F.lit("judge.layer3"), category, F.when(confidence > 0.85, F.lit("high")).otherwise(F.lit("medium")),
        F.concat(F.lit("reviewer classified as malicious: "), F.coalesce(v["rationale"], F.lit(""))), confidence,
        F.create_map(F.lit("mode"), F.lit(mode), F.lit("model"), F.lit(model), F.lit("verdict"), v["verdict"]))
    return (
        answered.withColumn("_v", parse_verdict(F.col("_answer")))
        .withColumn("_f", F.when(failed, transport).when(v["verdict"] == "malicious", malicious))
        .where(F.col("_f").isNotNull())
        .select("msg_id", "_f.*")
    )
