"""Rule evaluation over the string fields of a message.

``fields`` becomes an array of views (each field and its decoded base64 payloads, normalized). Up to
``PLAN_RULES`` rules become literal regex tests over the views: everything stays inside one row and
detection never shuffles, whatever the size of the traffic table. Longer lists are a table: an index from
required literals to patterns, and RE2 behind it, give each view the patterns it may match, a join brings their rows, and
regexes run on those only. The plan does not grow with the rules, and both forms give equal rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.patterns import glob_sql, glob_to_regex, required_literals, sql_string, to_java
from tracewarden.functions.ranks import (
    computed_once,
    mode_of_rank,
    MODE_RANK,
    severity_of_rank,
    severity_rank,
)
from tracewarden.functions.scan import re2_check, scan_slots, scan_views, seen_slot
from tracewarden.functions.text import base64_candidates, strip_invisible, truncate_bytes
from tracewarden.schema import FINDING
from tracewarden.sources.rules import DEFAULT_CONFIDENCE, collect_rules

#: bytes of a match that a finding quotes; None quotes it whole
MATCH_BYTES: int | None = None
#: longest rule list that becomes part of the plan; longer ones are joined as a table
PLAN_RULES = 256
#: largest part of a rule table that is sent to all tasks; a longer table is read in parts of that size
RULE_BYTES = 16 << 20
_META = "array<struct<rule_id:string,category:string,severity:string,description:string," \
        "confidence:double,mode:string,hash:string>>"


def guards_of(rules: list[dict]) -> tuple[dict, dict, dict, dict]:
    """Guard slots: ({(rule, pattern): slot}, {slot: exact literals}, {slot: lower-cased literals}, {slot: (RE2 pattern, looks at the raw text)}).

    A pattern without literals worth looking for is guarded by its RE2 form alone, one that RE2 does not take by its literals alone.
    """
    slots: dict = {}
    exact: dict = {}
    folded: dict = {}
    checks: dict = {}
    for i, rule in enumerate(rules):
        raw = rule.get("view") == "raw"
        for k, pattern in enumerate(rule["patterns"]):
            literals = None if raw else required_literals(pattern, rule["case_sensitive"])
            check = re2_check(pattern, not rule["case_sensitive"])
            if not literals or any(x in (" ", ".") for x in literals):
                literals = None
            elif any(len(x) < 3 and (check or x.isalnum() and not rule["case_sensitive"]) for x in literals):
                literals = None  # too common to be worth looking for
            if not literals and not check:
                continue
            slot = slots[(i, k)] = len(slots)
            if literals:
                (exact if rule["case_sensitive"] else folded)[slot] = literals
            if check:
                checks[slot] = (check, raw)
    return slots, exact, folded, checks


def with_views(messages: DataFrame, rules: list[dict], base64: bool = True, listed: bool = False) -> DataFrame:
    """Add ``_views``: array<struct<name, value, enc, norm, seen>> in field order.

    ``seen`` packs the guard slots found into words, or with ``listed`` names them.
    """
    slots, exact, folded, checks = guards_of(rules)

    def expand(f: Column) -> Column:
        plain = F.array(F.struct(f["name"].alias("name"), f["value"].alias("value"), F.lit("").alias("enc")))
        if not base64:
            return plain
        decoded = F.transform(
            base64_candidates(f["value"]),
            lambda d: F.struct(f["name"].alias("name"), d.alias("value"), F.lit("base64").alias("enc")),
        )
        return F.concat(plain, decoded)

    texts = F.transform("_raw_views", lambda v: v["value"])
    seen = "slots" if listed else "seen"
    return (
        messages
        .withColumn("_raw_views", F.flatten(F.transform("fields", expand)))
        .withColumn("_scan", scan_slots(texts, exact, folded, checks) if listed else scan_views(texts, exact, folded, checks, len(slots)))
        .withColumn("_views", F.zip_with("_raw_views", "_scan", lambda v, n: F.struct(
            v["name"].alias("name"), v["value"].alias("value"), v["enc"].alias("enc"),
            _visible(F.coalesce(n["nfkc"], v["value"])).alias("norm"), n[seen].alias("seen"))))
        .drop("_raw_views", "_scan")
    )


def _visible(c: Column) -> Column:
    return F.when(F.octet_length(c) > F.length(c), strip_invisible(c)).otherwise(c)


def scope_sql(rule: dict, name: str) -> str:
    """SQL test of a rule's methods, directions and field globs; ``true`` when it accepts everything."""
    tests = []
    for column, allowed in (("method", rule["targets"]), ("direction", rule["directions"])):
        if allowed:
            tests.append(f"{column} IN (" + ", ".join(map(sql_string, allowed)) + ")")
    if rule["fields"] and "**" not in rule["fields"]:
        tests.append("(" + " OR ".join(glob_sql(g, name) for g in rule["fields"]) + ")")
    return " AND ".join(tests) or "true"


def _match_sql(rule: dict, slots: list[int | None]) -> str:
    """CASE with the text of the first pattern that matches view ``v``."""
    text = "v.value" if rule.get("view") == "raw" else "v.norm"
    arms = []
    for pattern, slot in zip(rule["patterns"], slots):
        java = sql_string(to_java(pattern, rule["case_sensitive"]))
        guard = "" if slot is None else seen_slot("v.seen", slot) + " AND "
        arms.append(f"WHEN {guard}{text} RLIKE {java} THEN regexp_extract({text}, {java}, 0)")
    return "CASE " + " ".join(arms) + " END"


def rule_matches_sql(rules: list[dict], scopes: list[str]) -> str:
    """array<string> over view ``v`` with one slot per rule: the matched text or NULL.

    ``scopes`` lists the distinct scope tests, whose results are in ``v.scope``. One SQL text keeps the
    expression small and spares the thousands of driver calls of the equivalent Column tree.
    """
    table = guards_of(rules)[0]
    slots = []
    for i, rule in enumerate(rules):
        match = _match_sql(rule, [table.get((i, k)) for k in range(len(rule["patterns"]))])
        scope = scope_sql(rule, "v.name")
        slots.append(match if scope == "true" else f"IF(v.scope[{scopes.index(scope)}], {match}, NULL)")
    return "array(" + ",\n".join(slots) + ")"


def rule_meta(rules: list[dict]) -> Column:
    """Constant array with the attributes a finding copies from its rule."""
    rows = [{
        "rule_id": r["id"], "category": r["category"], "severity": r["severity"],
        "description": r["description"], "confidence": r["confidence"] or DEFAULT_CONFIDENCE,
        "mode": r["mode"], "hash": r.get("content_hash", ""),
    } for r in rules]
    return F.from_json(F.lit(json.dumps(rows)), _META)


def _metadata(meta: Column, enc: Column, changed: Column) -> Column:
    base = F.create_map(F.lit("mode"), meta["mode"], F.lit("rule_content_hash"), meta["hash"])
    coded = F.when(enc != "", F.create_map(
        F.lit("encoding"), enc,
        F.lit("note"), F.concat(F.lit("match found after "), enc, F.lit(" decode")),
    )).otherwise(F.create_map().cast("map<string,string>"))
    normal = F.when(changed, F.create_map(F.lit("normalized"), F.lit("true"))).otherwise(
        F.create_map().cast("map<string,string>"))
    return F.map_concat(base, coded, normal)


_PATTERN_ROW = ("_slot int, rpos int, k int, java string, raw boolean, targets array<string>, directions array<string>, field_regex string, "
                "rule_id string, category string, severity string, description string, confidence double, mode string, hash string")


def _fields_regex(rule: dict) -> str | None:
    """One regex over ``.`` and the path for all field globs of a rule; None when it accepts every field."""
    if not rule["fields"] or "**" in rule["fields"]:
        return None
    # a glob without a star is anchored on the path itself
    return "|".join(glob_to_regex(g) if "*" in g else glob_to_regex("." + g) for g in rule["fields"])


def pattern_rows(rules: list[dict]) -> list[tuple]:
    """One row per pattern, as ``_PATTERN_ROW``. Slot -1 holds the patterns that have no guard."""
    slots = guards_of(rules)[0]
    return [(slots.get((i, k), -1), i, k, to_java(pattern, r["case_sensitive"]), r.get("view") == "raw", r["targets"], r["directions"],
             _fields_regex(r), r["id"], r["category"], r["severity"], r["description"], r["confidence"] or DEFAULT_CONFIDENCE, r["mode"],
             r.get("content_hash", ""))
            for i, r in enumerate(rules) for k, pattern in enumerate(r["patterns"])]


def _parts(rows: list[tuple], limit: int) -> list[list[tuple]]:
    """Rows in order, cut into parts of at most ``limit`` bytes (a larger row is a part of its own)."""
    parts, size = [[]], 0
    for row in rows:
        b = len(json.dumps(row).encode())
        if parts[-1] and size + b > limit:
            parts.append([])
            size = 0
        parts[-1].append(row)
        size += b
    return parts


def _accepts(allowed: str, value: str) -> Column:
    return (F.size(allowed) == 0) | F.array_contains(allowed, F.col(value))


def find_by_table(messages: DataFrame, rules: list[dict], base64: bool = True, rule_bytes: int = RULE_BYTES) -> DataFrame:
    """(``msg_id``, findings) of messages with findings, with the rules as rows of a table.

    A view is joined with the patterns whose guards it holds, and with those that have none. Pattern rows are broadcast, in parts
    of at most ``rule_bytes``; only rows that matched are shuffled, once, by message. ``msg_id`` must be unique.
    """
    spark = messages.sparkSession
    views = with_views(messages.select("msg_id", "method", "direction", "fields"), rules, base64, listed=True)
    views = views.select("msg_id", "method", "direction", F.posexplode("_views").alias("vpos", "_v"))
    asked = views.select("*", F.explode(F.concat(F.array(F.lit(-1)), "_v.seen")).alias("_slot"))
    hits = None
    for part in _parts(pattern_rows(rules), rule_bytes):
        rows = spark.createDataFrame(part, _PATTERN_ROW)
        text = F.when(F.col("raw"), F.col("_v.value")).otherwise(F.col("_v.norm"))
        found = (
            asked.join(F.broadcast(rows), "_slot")
            .where(_accepts("targets", "method") & _accepts("directions", "direction")
                   & (F.col("field_regex").isNull() | F.expr("concat('.', _v.name) RLIKE field_regex")))
            .withColumn("_text", text)
            .where("_text RLIKE java")
            .select("msg_id", F.struct(
                "rpos", "vpos", "k", truncate_bytes(F.expr("regexp_extract(_text, java, 0)"), MATCH_BYTES).alias("match"),
                F.col("_v.name").alias("field"), F.col("_v.enc").alias("enc"), (F.col("_v.norm") != F.col("_v.value")).alias("changed"),
                "rule_id", "category", "severity", "description", "confidence", "mode", "hash").alias("_h")))
        hits = found if hits is None else hits.unionByName(found)

    def finding(h: Column) -> Column:
        return F.struct(*[h[f.name].alias(f.name) for f in FINDING if f.name != "metadata"], _metadata(h, h["enc"], h["changed"]).alias("metadata"))

    # of the patterns of a rule that match a view the first one counts
    first = "filter(_all, (h, i) -> i = 0 OR h.rpos != _all[i - 1].rpos OR h.vpos != _all[i - 1].vpos)"
    return (
        hits.groupBy("msg_id").agg(F.array_sort(F.collect_list("_h")).alias("_all"))
        .select("msg_id", F.transform(F.expr(first), finding).alias("_found"))
    )


def detect_rules(messages: DataFrame, rules: DataFrame | list[dict], base64: bool = True,
                 out: str = "rule_findings", plan_rules: int = PLAN_RULES) -> DataFrame:
    """Add an array of findings (rule order, then field order, plain text before decoded).

    More than ``plan_rules`` rules are joined as a table (``find_by_table``) and the findings joined back by ``msg_id``.
    """
    rules = collect_rules(rules)
    none = F.array().cast(f"array<{FINDING.simpleString()}>")
    if not rules:
        return messages.withColumn(out, none)
    if len(rules) > plan_rules:
        found = find_by_table(messages, rules, base64)
        columns = [c for c in messages.columns if c != out]
        return messages.join(found, "msg_id", "left").select(
            *columns, F.when(F.col("fields").isNotNull(), F.coalesce("_found", none)).alias(out))
    viewed = with_views(messages, rules, base64)
    scopes = sorted({scope_sql(r, "v.name") for r in rules})
    scoped = ("transform(_views, v -> named_struct('name', v.name, 'value', v.value, 'enc', v.enc, 'norm', v.norm, "
              f"'seen', v.seen, 'changed', v.norm != v.value, 'scope', array({', '.join(scopes)})))")
    hits = ("flatten(transform(_views, (v, vpos) -> filter(transform(" + rule_matches_sql(rules, scopes) +
            ", (m, rpos) -> named_struct('rpos', rpos, 'vpos', vpos, 'match', m, 'name', v.name, 'enc', v.enc, "
            "'changed', v.changed)), h -> h.match IS NOT NULL)))")

    meta = rule_meta(rules)

    def finding(hit: Column) -> Column:
        m = F.element_at(meta, hit["rpos"] + 1)
        return F.struct(
            m["rule_id"].alias("rule_id"), m["category"].alias("category"), m["severity"].alias("severity"),
            m["description"].alias("description"), truncate_bytes(hit["match"], MATCH_BYTES).alias("match"),
            hit["name"].alias("field"), m["confidence"].alias("confidence"),
            _metadata(m, hit["enc"], hit["changed"]).alias("metadata"))

    return (
        viewed
        .withColumn("_views", F.expr(scoped))
        .withColumn("_hits", F.expr(hits))
        .withColumn(out, computed_once(F.transform(F.array_sort("_hits"), finding)))
        .drop("_views", "_hits")
    )


def apply_rules(messages: DataFrame, rules: DataFrame | list[dict], base64: bool = True, plan_rules: int = PLAN_RULES) -> DataFrame:
    """One row per finding, with the message id it belongs to; more than ``plan_rules`` rules are joined as a table."""
    rules = collect_rules(rules)
    if len(rules) > plan_rules:
        return explode_findings(find_by_table(messages, rules, base64), "_found", "msg_id")
    return explode_findings(detect_rules(messages, rules, base64), "rule_findings", "msg_id")


def explode_findings(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Rows of an array of findings.

    The outer form keeps Catalyst from inferring ``size(column) > 0`` below the generator, which
    would evaluate the whole detection a second time as a filter.
    """
    return (
        df.select(*keys, F.posexplode_outer(column).alias("pos", "_f"))
        .where(F.col("_f").isNotNull())
        .select(*keys, "pos", "_f.*")
    )


def _scope_by_table(fields: DataFrame, rules: list[dict], rule_bytes: int) -> DataFrame:
    """As ``rule_scope``: rules are rows, found by the methods they name; the key NULL stands for any method."""
    out = None
    rows = [(t, r["id"], r["directions"], _fields_regex(r)) for r in rules for t in (dict.fromkeys(r["targets"]) or [None])]
    asked = fields.withColumn("_key", F.explode(F.array_distinct(F.array(F.lit(None).cast("string"), F.col("method")))))
    for part in _parts(rows, rule_bytes):
        table = fields.sparkSession.createDataFrame(part, "target string, rule_id string, directions array<string>, field_regex string")
        found = (
            asked.join(F.broadcast(table), F.col("_key").eqNullSafe(F.col("target")))
            .where(_accepts("directions", "direction") & (F.col("field_regex").isNull() | F.expr("concat('.', field) RLIKE field_regex")))
            .select("msg_id", "field", "rule_id"))
        out = found if out is None else out.unionByName(found)
    return out


def rule_scope(messages: DataFrame, rules: DataFrame | list[dict], plan_rules: int = PLAN_RULES) -> DataFrame:
    """Which rules look at which field: one row per (message, field, rule); more than ``plan_rules`` rules are joined as a table."""
    rules = collect_rules(rules)
    if len(rules) > plan_rules:
        fields = messages.select("msg_id", "method", "direction", F.explode("fields.name").alias("field"))
        return _scope_by_table(fields, rules, RULE_BYTES)

    arms = ", ".join(f"IF({scope_sql(r, 'field')}, {sql_string(r['id'])}, NULL)" for r in rules)
    return (
        messages
        .select("msg_id", "method", "direction", F.explode("fields").alias("_field"))
        .select("msg_id", "method", "direction", F.col("_field.name").alias("field"))
        .select("msg_id", "field", F.explode_outer(F.expr(f"array_compact(array({arms}))")).alias("rule_id"))
        .where(F.col("rule_id").isNotNull())
    )


def highest_severity(findings: Column | str) -> Column:
    findings = F.col(findings) if isinstance(findings, str) else findings
    top = F.array_max(F.transform(findings, lambda f: severity_rank(f["severity"])))
    return severity_of_rank(F.coalesce(top, F.lit(0)))


def highest_mode(findings: Column | str, rules: DataFrame | list[dict]) -> Column:
    """Strongest default mode among the rules behind the findings; other findings do not count."""
    findings = F.col(findings) if isinstance(findings, str) else findings
    ranks = {r["id"]: MODE_RANK.get(r["mode"], 0) for r in collect_rules(rules)}
    table = F.from_json(F.lit(json.dumps(ranks)), "map<string,int>")
    top = F.array_max(F.transform(findings, lambda f: F.coalesce(F.try_element_at(table, f["rule_id"]), F.lit(0))))
    return mode_of_rank(F.coalesce(top, F.lit(0)))
