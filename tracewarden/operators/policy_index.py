"""Policy resolution by an index from scopes and selectors to policies, for lists that do not fit into a plan.

A policy stands under one key per value of its narrowest selector (rule id, else category, else least severity, else any) and method, together
with its scope. An event asks for the keys its own values give, so it meets only policies that may apply to it. Policies that are equal but for
their rank are reduced to the best one before the join. Events are resolved once per distinct signature (scope, method, findings), and the
answers are joined back by it; no list is ever one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.ranks import severity_rank

#: keys that many rows share are spread over this many parts
SALTS = 16
_SCOPES = ((1, "tenant_id"), (2, "sensor_id"), (4, "server_name"))


def _any() -> Column:
    return F.lit(None).cast("string")


def given(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def listed(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) > 0


def _each(values: Column, kind: str) -> Column:
    return F.transform(F.array_compact(F.array_distinct(values)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def _key(scope: Column, selector: Column, method: Column) -> Column:
    """Text of a key; JSON, so that no value can be mistaken for another."""
    return F.to_json(F.struct(scope.alias("s"), selector.alias("k"), method.alias("m")))


def _scope(row: str, kind: int) -> Column:
    return F.struct(F.lit(kind).alias("n"), *[F.col(f"{row}.{c}").alias(c) for bit, c in _SCOPES if kind & bit])


def _scope_json(row: str, kind: int) -> Column:
    return F.to_json(_scope(row, kind))


def index_policies(policies: DataFrame, rank: Column, residual: list[str]) -> DataFrame:
    """(``_key``, ``_left``, ``_best``): the best policy of each key among those that differ in nothing else that is tested.

    ``_left`` holds what the key does not decide: categories where the key is a rule id, the least severity where it is a rule id or a category, and
    the columns ``residual``.
    """
    p = policies.select(F.struct("*").alias("p"), rank.alias("_best"))
    by_rule, by_category = listed(F.col("p.rule_ids")), listed(F.col("p.categories"))
    by_severity = given(F.col("p.min_severity"))
    severity = F.when(by_severity, severity_rank("p.min_severity"))
    selectors = (
        F.when(by_rule, _each(F.col("p.rule_ids"), "rule"))
        .when(by_category, _each(F.col("p.categories"), "category"))
        .when(by_severity, _each(F.array(severity.cast("string")), "severity"))
        .otherwise(F.array(F.struct(F.lit("any").alias("kind"), _any().alias("value")))))
    methods = F.when(listed(F.col("p.methods")), F.array_compact(F.array_distinct("p.methods"))).otherwise(F.array(_any()))
    kind = sum((F.when(given(F.col(f"p.{c}")), bit).otherwise(0) for bit, c in _SCOPES), F.lit(0))
    scope = F.coalesce(*[F.when(kind == n, _scope_json("p", n)) for n in range(8)])
    left = F.struct(
        F.when(by_rule & by_category, F.array_sort(F.array_distinct("p.categories"))).alias("categories"),
        F.when(by_rule | by_category, severity).alias("severity"), *[F.col(f"p.{c}") for c in residual])
    return (
        p.select("_best", scope.alias("_scope"), left.alias("_left"), methods.alias("_methods"), F.explode(selectors).alias("_selector"))
        .select("_best", "_left", "_scope", "_selector", F.explode("_methods").alias("_method"))
        .groupBy(_key(F.col("_scope"), F.col("_selector"), F.col("_method")).alias("_key"), "_left").agg(F.max("_best").alias("_best"))
    )


def _event_keys() -> Column:
    """All keys under which a policy for the signature ``_s`` may stand."""
    findings = F.col("_s.findings")
    top = F.array_max(F.transform(findings, lambda f: severity_rank(f["severity"])))
    ranks = F.when(F.size(findings) > 0, F.transform(F.sequence(F.lit(0), top), lambda r: r.cast("string"))).otherwise(F.array().cast("array<string>"))
    selectors = F.concat(
        F.array(F.struct(F.lit("any").alias("kind"), _any().alias("value"))), _each(F.transform(findings, lambda f: f["rule_id"]), "rule"),
        _each(F.transform(findings, lambda f: f["category"]), "category"), _each(ranks, "severity"))
    scopes = F.array_compact(F.array(*[
        F.when(F.lit(True) if not n else F.expr(" AND ".join(f"coalesce(_s.{c}, '') != ''" for bit, c in _SCOPES if n & bit)), _scope_json("_s", n))
        for n in range(8)]))
    methods = F.array_distinct(F.array(_any(), F.col("_s.method")))
    return F.flatten(F.flatten(F.transform(scopes, lambda s: F.transform(selectors, lambda k: F.transform(methods, lambda m: _key(s, k, m))))))


def _salt(c: Column) -> Column:
    return F.pmod(c, F.lit(SALTS)).cast("int")


def winners(events: DataFrame, policies: DataFrame, rank: Column, timed: bool) -> DataFrame:
    """``events`` with ``_winner``, the greatest ``rank`` among the policies that apply (NULL where none does)."""
    findings = F.coalesce(F.array_sort(F.array_distinct(F.transform("findings", lambda f: F.struct(
        f["rule_id"].alias("rule_id"), f["category"].alias("category"), f["severity"].alias("severity"))))),
        F.array().cast("array<struct<rule_id:string,category:string,severity:string>>"))
    parts = [F.col(c).alias(c) for c in ("tenant_id", "sensor_id", "server_name", "method")] + [findings.alias("findings")]
    if timed:
        parts.append(F.unix_micros("ts").alias("at"))
    signed = events.withColumn("_s", F.struct(*parts)).withColumn("_sig", F.sha2(F.to_json("_s"), 256))
    index = index_policies(policies, rank, ["valid_from", "valid_to"] if timed else [])

    left, got = F.col("_left"), F.col("_s.findings")
    fits = F.when(left["categories"].isNull() & left["severity"].isNull(), True).otherwise(F.exists(got, lambda f: (
        # the rule id or the category that the key names must be this finding's own
        (F.col("_kind") != "rule") | (f["rule_id"] == F.col("_value"))) & ((F.col("_kind") != "category") | (f["category"] == F.col("_value")))
        & (left["categories"].isNull() | F.array_contains(left["categories"], f["category"]))
        & (left["severity"].isNull() | (severity_rank(f["severity"]) >= left["severity"]))))
    if timed:
        at = F.col("_s.at")
        fits = fits & (left["valid_from"] <= at) & (left["valid_to"].isNull() | (left["valid_to"] > at))

    asked = signed.groupBy("_sig").agg(F.first("_s").alias("_s")).withColumn("_key", F.explode(_event_keys()))
    asked = asked.withColumn("_part", _salt(F.xxhash64("_sig")))
    spread = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    answers = (
        asked.join(index.withColumn("_part", spread), ["_key", "_part"])
        .withColumn("_kind", F.get_json_object("_key", "$.k.kind")).withColumn("_value", F.get_json_object("_key", "$.k.value"))
        .where(fits).groupBy("_sig").agg(F.max("_best").alias("_winner"))
    )
    # equal signatures are spread by the rows' own plain columns, which a lost task finds again
    plain = [c for c, t in events.dtypes if "<" not in t and t != "variant"]
    placed = signed.drop("_s").withColumn("_part", _salt(F.xxhash64(*plain)))
    return placed.join(answers.withColumn("_part", spread), ["_sig", "_part"], "left").drop("_sig", "_part")
