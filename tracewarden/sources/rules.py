"""Rule packs: loading, defaults, checks and content hashes."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.functions.patterns import to_java
from tracewarden.schema import RULE
from tracewarden.sources.default_packs import DEFAULT_RULES

# What a pack may leave out.
_DEFAULT_SEVERITY = "medium"
_DEFAULT_MODE = "monitor"
DEFAULT_CONFIDENCE = 0.9


class RulePackError(ValueError):
    """A pack that cannot be used: no id, no patterns or a bad pattern."""


def _complete(rule: dict, pack_category: str, pos: int) -> dict:
    if not rule.get("id"):
        raise RulePackError("rule without id")
    patterns = [str(p) for p in rule.get("patterns") or []]
    if not patterns:
        raise RulePackError(f"{rule['id']}: rule has no patterns")
    return {
        "id": rule["id"],
        "category": rule.get("category") or pack_category or "",
        "severity": rule.get("severity") or _DEFAULT_SEVERITY,
        "description": rule.get("description") or "",
        "mode": rule.get("mode") or _DEFAULT_MODE,
        "targets": list(rule.get("targets") or []),
        "directions": list(rule.get("directions") or []),
        "fields": list(rule.get("fields") or []),
        "patterns": patterns,
        "case_sensitive": bool(rule.get("case_sensitive", False)),
        "confidence": float(rule.get("confidence") or 0.0),
        "view": rule.get("view") or "normalized",
        "pos": pos,
    }


def rules_table(spark: SparkSession, rules: list[dict], category: str = "") -> DataFrame:
    """RULE table from dictionaries, in list order; every pattern is compiled once to check it."""
    done = [_complete(r, category, i) for i, r in enumerate(rules)]
    _check_patterns(spark, done)
    return spark.createDataFrame([tuple(r[f.name] for f in RULE) for r in done], RULE)


def _check_patterns(spark: SparkSession, rules: list[dict]) -> None:
    java = spark._jvm.java.util.regex.Pattern
    for rule in rules:
        for pattern in rule["patterns"]:
            try:
                java.compile(to_java(pattern, rule["case_sensitive"]))
            except Exception as err:
                raise RulePackError(f"{rule['id']}: bad pattern {pattern!r}") from err


def default_rules(spark: SparkSession) -> DataFrame:
    return rules_table(spark, DEFAULT_RULES)


def parse_pack_text(text: str) -> list[dict]:
    """Rules of one YAML text, which may hold several documents."""
    try:
        import yaml
    except ImportError as err:  # pragma: no cover - depends on the installation
        raise RulePackError("reading YAML packs needs PyYAML") from err
    rules: list[dict] = []
    for pack in yaml.safe_load_all(text):
        for rule in (pack or {}).get("rules") or []:
            rules.append({**rule, "category": rule.get("category") or pack.get("category")})
    return rules


def load_rule_packs(spark: SparkSession, path: str) -> DataFrame:
    """RULE table of every ``*.yaml`` / ``*.yml`` below ``path`` (definitions, read on the driver)."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{yaml,yml,YAML,YML}")
        .load(path)
        .select("path", "content")
        .orderBy("path")
    )
    rules: list[dict] = []
    for row in files.toLocalIterator():
        rules.extend(parse_pack_text(bytes(row["content"]).decode("utf-8")))
    return rules_table(spark, rules)


def complete_rules(rules: list[dict], category: str = "") -> list[dict]:
    """Definitions with defaults filled in and the content hash, without a Spark job."""
    done = [_complete(r, category, i) for i, r in enumerate(rules)]
    for rule in done:
        rule["content_hash"] = hashlib.sha256(_hashed_text(rule).encode()).hexdigest()
    return done


def default_rule_list() -> list[dict]:
    return complete_rules(DEFAULT_RULES)


def _hashed_text(rule: dict) -> str:
    scalars = [("id", rule["id"]), ("category", rule["category"]), ("severity", rule["severity"]), ("mode", rule["mode"]),
               ("case_sensitive", str(rule["case_sensitive"]).lower()), ("confidence", f"{rule['confidence']:g}")]
    lists = [(label, v) for label, key in (("target", "targets"), ("direction", "directions"), ("field", "fields"),
                                           ("pattern", "patterns")) for v in rule[key]]
    return "".join(f"{label}: {value}\n" for label, value in scalars + lists)


def collect_rules(rules: DataFrame | list[dict]) -> list[dict]:
    """Rule definitions as dictionaries (hash included), in pack order."""
    if isinstance(rules, list):
        return rules
    rows = rules.withColumn("content_hash", content_hash()).orderBy("pos").collect()
    return [row.asDict(recursive=True) for row in rows]


def _number(c: Column) -> Column:
    """Shortest decimal form: 0, 0.85, 1."""
    text = c.cast("string")
    return F.regexp_replace(text, r"\.0\z", "")


def content_hash() -> Column:
    """sha256 over ``label: value`` lines, one per scalar and one per list element, in fixed order."""
    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(label + ": "), value, F.lit("\n"))

    def lines(label: str, values: str) -> Column:
        return F.array_join(F.transform(F.col(values), lambda v: line(label, v)), "")

    # Labels and order of the hashed text.
    text = F.concat(
        line("id", F.col("id")),
        line("category", F.col("category")),
        line("severity", F.col("severity")),
        line("mode", F.col("mode")),
        line("case_sensitive", F.col("case_sensitive").cast("string")),
        line("confidence", _number(F.col("confidence"))),
        lines("target", "targets"),
        lines("direction", "directions"),
        lines("field", "fields"),
        lines("pattern", "patterns"),
    )
    return F.sha2(text, 256)


def rule_content_hash(rules: DataFrame) -> DataFrame:
    """Add ``content_hash``, the value that findings cite."""
    return rules.withColumn("content_hash", content_hash())
