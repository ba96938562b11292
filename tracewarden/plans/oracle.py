"""SQL twins of the catalog, written for DuckDB over the same parquet tables."""

from __future__ import annotations

from tracewarden.operators import classifier as c
from tracewarden.sources.default_packs import DEFAULT_RULES

_LEDGER = """ledger_v AS (
SELECT event_id + 1 AS seq, ts, concat('tenant-', cast(user_id % 3 AS string)) AS tenant_id,
 concat('sensor-', cast(user_id % 4 AS string)) AS sensor_id, concat('run-', cast(user_id AS string)) AS agent_run_id,
 CASE WHEN event_type IN ('purchase','signup') THEN concat('peer-', cast(user_id % 25 AS string)) ELSE '' END AS counterparty,
 CASE WHEN event_type IN ('purchase','signup') THEN 'a2a' ELSE 'mcp' END AS protocol,
 CASE WHEN event_id % 2 = 0 THEN 'inbound' ELSE 'outbound' END AS direction,
 CASE event_type WHEN 'click' THEN 'tools/call' WHEN 'error' THEN 'tools/call' WHEN 'view' THEN 'tools/list'
  WHEN 'purchase' THEN 'tasks/send' ELSE 'tasks/get' END AS method,
 CASE WHEN event_type IN ('click','error')
  THEN concat('tool-', cast(cast(regexp_extract(props, '([0-9]+)', 1) AS int) % 20 AS string)) ELSE '' END AS tool,
 CASE WHEN value >= 80 THEN 'critical' WHEN value >= 50 THEN 'high' WHEN value >= 30 THEN 'medium'
  WHEN value >= 10 THEN 'low' ELSE 'info' END AS severity,
 CASE WHEN value >= 80 THEN 'block' WHEN value >= 30 THEN 'warn' ELSE 'allow' END AS action,
 cast(regexp_extract(props, '([0-9]+)', 1) AS int) % 4 AS n_findings,
 cast(floor(value * 10) AS bigint) AS latency_micros, props AS raw, event_type FROM events)"""
_FINDINGS = """findings_v AS (
SELECT l.seq, l.ts, l.agent_run_id, l.counterparty, l.tenant_id, n.i AS pos, concat('rule-', cast((l.seq + n.i) % 12 AS string)) AS rule_id,
 CASE (l.seq + n.i) % 5 WHEN 0 THEN 'prompt-injection' WHEN 1 THEN 'tool-poisoning' WHEN 2 THEN 'credential-exfiltration'
  WHEN 3 THEN 'pii-leakage' ELSE 'policy' END AS category, l.severity
FROM ledger_v l JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2) n ON n.i < l.n_findings)"""
_MESSAGES = """messages_v AS (
SELECT concat('d', cast(doc_id AS string)) AS msg_id, 'tools/call' AS method, 'outbound' AS direction,
 'result.content.0.text' AS field, text AS value FROM documents
UNION ALL SELECT concat('c', cast(conv_id AS string), '-', cast(turn AS string)),
 CASE role WHEN 'system' THEN 'tools/list' WHEN 'assistant' THEN 'tools/call' ELSE 'tasks/send' END,
 CASE role WHEN 'user' THEN 'inbound' ELSE 'outbound' END,
 CASE role WHEN 'system' THEN 'result.tools.0.description' WHEN 'assistant' THEN 'result.content.0.text'
  ELSE 'params.message.parts.0.text' END, text FROM conversations
UNION ALL SELECT concat('p', cast(page_id AS string)), 'tools/call', 'outbound', 'result.content.0.html', html FROM pages)"""
_OBS = """obs AS (SELECT agent_run_id AS task_id, sensor_id AS counterparty, CASE event_type WHEN 'purchase' THEN 'submitted'
 WHEN 'view' THEN 'working' WHEN 'click' THEN 'input-required' WHEN 'signup' THEN 'completed' WHEN 'error' THEN 'failed' ELSE '' END AS state,
 method AS fingerprint, ts, seq FROM ledger_v)"""
_LEGAL = ("('submitted>working','submitted>input-required','submitted>canceled','submitted>failed','submitted>completed',"
          "'working>input-required','working>completed','working>canceled','working>failed','input-required>working',"
          "'input-required>canceled','input-required>failed','input-required>completed')")
_CHANGES = """changes AS (SELECT seq, CASE action WHEN 'block' THEN 'delete' WHEN 'warn' THEN 'update' ELSE 'create' END AS op,
 counterparty AS id, concat('n-', counterparty) AS name, seq % 7 AS version, seq % 3 <> 0 AS enabled,
 CASE WHEN seq % 2 = 0 THEN tenant_id ELSE '' END AS tenant_id, action AS mode FROM ledger_v WHERE counterparty <> '')"""
_RPC = """rpc AS (SELECT concat('c', cast(conv_id AS string), '-', cast(turn AS string)) AS msg_id, concat('run-', cast(conv_id AS string)) AS agent_run_id,
 conv_id * 100 + turn AS ts, conv_id, turn, role, text,
 CASE role WHEN 'user' THEN 'tasks/send' WHEN 'assistant' THEN '' ELSE 'notifications/message' END AS method,
 CASE role WHEN 'user' THEN cast(turn AS string) WHEN 'assistant' THEN cast(turn - 1 AS string) END AS id FROM conversations)"""
_CARDS = """cards_v AS (SELECT concat('c', cast(conv_id AS string), '-', cast(turn AS string)) AS msg_id, concat('agent-', cast(conv_id AS string)) AS name,
 text AS description, CASE WHEN conv_id % 3 = 0 THEN 'ftp://x' ELSE 'https://x' END AS url, concat('org-', cast(conv_id % 5 AS string)) AS org,
 turn, role, turn % 3 > 0 AS signed, turn % 2 = 1 AS sig_ok FROM conversations)"""
_NOW = "(SELECT max(ts) FROM ledger_v)"


def _with(*ctes_then_body: str) -> str:
    *ctes, body = ctes_then_body
    return "WITH " + ",\n".join(ctes) + "\n" + body


def _rank(col: str) -> str:
    return f"CASE {col} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ---- rules: patterns run verbatim on DuckDB's RE2 -------------------------------------------

_INVISIBLE = r"[\p{Cf}\x{FE00}-\x{FE0F}\x{E0000}-\x{E007F}\x{E0100}-\x{E01EF}]"


def _glob_sql(glob: str, path: str) -> str:
    if "*" not in glob:
        return f"{path} = {_q(glob)}"
    body = ""
    for seg in glob.split("."):
        body += r"(?:\.[^.]*)*" if seg == "**" else r"\.[^.]*" if seg == "*" else r"\." + seg.replace("-", r"\-")
    return f"regexp_matches('.' || {path}, {_q('^' + body + '$')})"


def _scope_sql(rule: dict) -> str:
    tests = []
    if rule["targets"]:
        tests.append("method IN (" + ",".join(map(_q, rule["targets"])) + ")")
    if rule["directions"]:
        tests.append("direction IN (" + ",".join(map(_q, rule["directions"])) + ")")
    tests.append("(" + " OR ".join(_glob_sql(g, "field") for g in rule["fields"]) + ")")
    return " AND ".join(tests)


def _rules_sql(rules: list[dict], select: str, source: str) -> str:
    parts = []
    for rule in rules:
        flag = "" if rule["case_sensitive"] else "(?i)"
        text = "raw_value" if rule["view"] == "raw" else "value"
        arms = " ".join(f"WHEN regexp_matches({text}, {_q(flag + p)}) THEN regexp_extract({text}, {_q(flag + p)}, 0)" for p in rule["patterns"])
        parts.append(
            f"SELECT msg_id, {_q(rule['id'])} AS rule_id, {_q(rule['category'])} AS category, {_q(rule['severity'])} AS severity, field, "
            f"CASE {arms} END AS match, cast({rule['confidence'] or 0.9} AS double) AS confidence FROM {source} WHERE {_scope_sql(rule)}")
    union = "\nUNION ALL ".join(parts)
    return f"SELECT {select} FROM ({union}) WHERE match IS NOT NULL"


_CLEAN = (f"clean_v AS (SELECT msg_id, method, direction, field, value AS raw_value, "
          f"regexp_replace(value, {_q(_INVISIBLE)}, '', 'g') AS value FROM messages_v)")

# ---- classifier ----------------------------------------------------------------------------


def _any_sql(phrases: list[str], col: str = "lo") -> str:
    return "(" + " OR ".join(f"contains({col}, {_q(p)})" for p in phrases) + ")"


def _features_sql(source: str) -> str:
    nouns = "|".join(c.CONTEXT_NOUNS)
    gap = r"(?:\S+ ){0,7}"
    hits = " + ".join(
        f"CASE WHEN regexp_matches(words, {_q(f' {v} {gap}(?:{nouns}) | (?:{nouns}) {gap}{v} ')}) THEN 1 ELSE 0 END" for v in c.OVERRIDE_VERBS)
    exfil = " + ".join(f"CASE WHEN contains(lo, {_q(p)}) THEN 1 ELSE 0 END" for p in c.EXFIL_PHRASES)
    lst = lambda xs: "[" + ",".join(map(_q, xs)) + "]"
    named = f"{_any_sql(c.EXTRACTION_QUALIFIERS)} AND {_any_sql(c.EXTRACTION_OBJECTS)}"
    return f"""tok AS (SELECT msg_id, field, value, lower(value) AS lo, list_filter(string_split_regex(lower(value), '[^\\p{{L}}\\p{{Nd}}]+'), lambda x: x <> '') AS t FROM {source}),
pre AS (SELECT *, ' ' || array_to_string(t, ' ') || ' ' AS words, len(t) AS n,
 CASE WHEN {_any_sql(c.ROLE_MARKERS)} THEN 0.95 WHEN {_any_sql(c.ROLE_PHRASES)} THEN 0.55 ELSE 0.0 END AS rm,
 list_filter(t, lambda x: list_contains({lst(c.IMPERATIVES)}, x)) AS imp FROM tok),
cnt AS (SELECT *, {hits} AS hits, {exfil} AS ex, {_any_sql(c.URL_MARKS)} AS url, {_any_sql(c.SENSITIVE_NOUNS)} AS noun,
 len(imp)::double / greatest(n, 1) AS dens FROM pre),
feat AS (SELECT msg_id, field, value, n,
 CASE WHEN n = 0 THEN 0.0 ELSE least(1.0, rm + CASE WHEN rm > 0 AND {_any_sql(c.CONTROL_WORDS)} THEN 0.05 ELSE 0 END) END::double AS role_marker,
 CASE WHEN n = 0 OR hits = 0 THEN 0.0 ELSE least(1.0, hits * 0.35 + CASE WHEN n < 30 THEN 0.2 ELSE 0 END + CASE WHEN {_any_sql(c.PROMPT_PHRASES)} THEN 0.25 ELSE 0 END) END::double AS override_imperative,
 CASE WHEN n = 0 THEN 0.0 WHEN {_any_sql(c.NEW_ROLE_PHRASES)} THEN 0.7 WHEN {_any_sql(c.LAPSED_PHRASES)} AND {_any_sql(c.TIME_PHRASES)} THEN 0.75
  WHEN {_any_sql(c.AUTHORITY_PHRASES)} AND {_any_sql(c.PRINCIPALS)} THEN 0.7 ELSE 0.0 END::double AS new_role,
 CASE WHEN n = 0 OR ex = 0 OR NOT (url OR noun) THEN 0.0 ELSE least(1.0, ex * 0.45 + CASE WHEN url THEN 0.25 ELSE 0 END + CASE WHEN noun THEN 0.2 ELSE 0 END) END::double AS exfil_imperative,
 CASE WHEN n = 0 OR NOT list_has_any(t, {lst(c.EXTRACTION_VERBS)}) THEN 0.0 WHEN {named} AND {_any_sql(c.EXACTNESS_WORDS)} THEN 0.85 WHEN {named} THEN 0.65
  WHEN {_any_sql(c.TOLD_PHRASES)} THEN 0.6 ELSE 0.0 END::double AS extraction_imperative,
 CASE WHEN n < 8 OR len(list_distinct(imp)) < 2 THEN 0.0 WHEN dens >= 0.10 THEN 0.8 WHEN dens >= 0.06 THEN 0.6 WHEN dens >= 0.03 THEN 0.4
  WHEN dens >= 0.015 THEN 0.2 ELSE 0.05 END::double AS imperative_density,
 CASE WHEN n = 0 THEN 0.0 WHEN octet_length(encode(value)) > 4000 THEN 0.4 WHEN octet_length(encode(value)) > 1500 THEN 0.2 ELSE 0.0 END::double AS length_anomaly
FROM cnt)"""


_SCORE = " * ".join(f"(1.0 - {f})" for f in c.FEATURES)
_SCORED = f"scored AS (SELECT *, least(1.0, 1.0 - {_SCORE}) AS score FROM feat WHERE octet_length(encode(value)) >= 24)"
_CONTRIB = "array_to_string(list_filter([" + ",".join(
    f"CASE WHEN {f} >= 0.15 THEN '{f}' END" for f in sorted(c.FEATURES)) + "], lambda x: x IS NOT NULL), ',')"
_SEV = "CASE WHEN score >= 0.85 THEN 'critical' WHEN score >= 0.65 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END"
_PII = [r for r in DEFAULT_RULES if r["category"] == "pii-leakage"]


def _policy_sql(final: str) -> str:
    return _with(_LEDGER, _FINDINGS, """agg AS (SELECT l.seq, any_value(l.tenant_id) AS tenant_id, any_value(l.sensor_id) AS sensor_id, any_value(l.method) AS method, count(f.seq) AS n,
 coalesce(bool_or(f.severity IN ('high','critical')), false) AS hi, coalesce(bool_or(f.severity IN ('medium','high','critical')), false) AS med,
 coalesce(bool_or(f.category = 'pii-leakage'), false) AS pii, coalesce(bool_or(f.rule_id IN ('rule-3','rule-4')), false) AS r34
 FROM ledger_v l LEFT JOIN findings_v f USING (seq) GROUP BY l.seq)""", f"""SELECT seq, {final} FROM agg""")


_SHIFTS = "list_distinct(list_transform(range(1, octet_length(b) - 22), lambda i: left(sha256(array_slice(b, i, i + 23)), 32)))"
_STRIPPED = "encode(trim(regexp_replace(text, " + _q(_INVISIBLE) + ", '', 'g'), E' \\n\\t\\r'))"
_LEAKS = f"""tb AS (SELECT item_id, {_STRIPPED} AS b FROM benchmark),
db AS (SELECT doc_id, {_STRIPPED} AS b FROM documents WHERE octet_length(encode(text)) >= 16),
tf AS (SELECT unnest(CASE WHEN octet_length(b) = 0 THEN [] WHEN octet_length(b) <= 24 THEN [left(sha256(b), 32)] ELSE {_SHIFTS} END) AS fp, item_id FROM tb),
df AS (SELECT doc_id, unnest(CASE WHEN octet_length(b) <= 24 THEN [left(sha256(b), 32)] ELSE {_SHIFTS} END) AS fp FROM db),
hit AS (SELECT df.doc_id, min(tf.item_id) AS item_id FROM df JOIN tf USING (fp) GROUP BY df.doc_id)"""

# rule findings and classifier findings; the classifier's count for no mode of their own
_FOUND = ("hit AS (" + _rules_sql(DEFAULT_RULES, "msg_id, rule_id, severity", "clean_v") + ")",
          _features_sql("messages_v"), _SCORED,
          "o AS (SELECT * FROM (VALUES " + ",".join(f"({_q(r['id'])},{i},{_q(r['mode'])})" for i, r in enumerate(DEFAULT_RULES)) + ") v(rule_id, ord, mode))",
          f"""f AS (SELECT msg_id, rule_id, severity, ord, mode FROM hit JOIN o USING (rule_id)
 UNION ALL SELECT msg_id, 'heuristic.injection_density', {_SEV}, 1000, 'monitor' FROM scored WHERE score >= 0.45)""")

ORACLE: dict[str, str] = {
    "query_events": _with(_LEDGER, _FINDINGS, """SELECT seq, agent_run_id, severity, action, method FROM ledger_v l
WHERE severity IN ('high','critical') AND tenant_id = 'tenant-1' AND contains(raw, '1') AND seq > 100
AND EXISTS (SELECT 1 FROM findings_v f WHERE f.seq = l.seq AND f.category = 'policy') ORDER BY seq DESC"""),
    "timeline": _with(_LEDGER, "SELECT seq, method, action FROM ledger_v WHERE agent_run_id = 'run-5' AND tenant_id = 'tenant-2' ORDER BY seq"),
    "tenant_scope": _with(_LEDGER, """SELECT seq, tenant_id, 'read' AS side FROM ledger_v WHERE tenant_id = 'tenant-2'
UNION ALL SELECT seq, 'tenant-0', 'write' FROM ledger_v"""),
    "retain": _with(_LEDGER, f"SELECT seq, tenant_id FROM ledger_v WHERE ts >= {_NOW} - INTERVAL 10 DAY"),
    "retention_summary": _with(_LEDGER, f"""SELECT count(*) FILTER (ts >= {_NOW} - INTERVAL 10 DAY) AS kept, count(*) FILTER (ts < {_NOW} - INTERVAL 10 DAY) AS dropped,
 sha256(cast(min(seq) FILTER (ts >= {_NOW} - INTERVAL 10 DAY) AS string)) AS chain_start FROM ledger_v"""),
    "tool_risk": _with(_LEDGER, """SELECT tool, count(*) FILTER (direction = 'inbound') AS total_calls, cast(sum(n_findings) AS bigint) AS findings,
 count(*) FILTER (action = 'warn') AS warnings, count(*) FILTER (action = 'block') AS blocks,
 round(CASE WHEN count(*) FILTER (direction = 'inbound') = 0 AND sum(n_findings) = 0 THEN 0 ELSE
 (5.0 * count(*) FILTER (action = 'block') + 2.0 * count(*) FILTER (action = 'warn') + sum(n_findings))::double / greatest(count(*) FILTER (direction = 'inbound'), 1) END, 6)::double AS risk_score
 FROM ledger_v WHERE method = 'tools/call' AND tool <> '' GROUP BY tool"""),
    "agent_activity": _with(_LEDGER, _FINDINGS, f"""SELECT l.agent_run_id, count(*) AS events, cast(sum(n_findings) AS bigint) AS findings, count(*) FILTER (action = 'block') AS blocks,
 round(avg({_rank('severity')}), 6) AS severity_score, coalesce(any_value(cats), '') AS categories FROM ledger_v l
 LEFT JOIN (SELECT agent_run_id, string_agg(DISTINCT category, ',' ORDER BY category) AS cats FROM findings_v GROUP BY agent_run_id) k USING (agent_run_id) GROUP BY l.agent_run_id"""),
    "category_counts": _with(_LEDGER, _FINDINGS, "SELECT category, count(*) AS count FROM findings_v GROUP BY category"),
    "counterparty_risk": _with(_LEDGER, """SELECT counterparty, count(*) AS events, cast(sum(n_findings) AS bigint) AS findings, count(*) FILTER (action = 'warn') AS warnings,
 count(*) FILTER (action = 'block') AS blocks, round((5.0 * count(*) FILTER (action = 'block') + 2.0 * count(*) FILTER (action = 'warn') + sum(n_findings))::double / count(*), 6)::double AS risk_score
 FROM ledger_v WHERE counterparty <> '' GROUP BY counterparty"""),
    "task_concerns": _with(_LEDGER, _FINDINGS, "SELECT counterparty, rule_id, seq FROM findings_v WHERE rule_id IN ('rule-1','rule-7') ORDER BY seq DESC, pos LIMIT 40"),
    "action_histogram": _with(_LEDGER, f"""SELECT cell, coalesce(a, 0) AS allow_count, coalesce(w, 0) AS warn_count, coalesce(b, 0) AS block_count FROM (SELECT unnest(range(40)) AS cell) g
 LEFT JOIN (SELECT 39 - (epoch_us({_NOW}) - epoch_us(ts)) // 21600000000 AS cell, count(*) FILTER (action = 'allow') AS a, count(*) FILTER (action = 'warn') AS w, count(*) FILTER (action = 'block') AS b
 FROM ledger_v WHERE ts >= {_NOW} - INTERVAL 10 DAY GROUP BY 1) h USING (cell)"""),
    "window_metrics": _with(_LEDGER, f"""w AS (SELECT *, 9 - (epoch_us({_NOW}) - epoch_us(ts)) // 86400000000 AS cell FROM ledger_v WHERE ts >= {_NOW} - INTERVAL 10 DAY)""",
        """SELECT 864000::bigint AS window_seconds, 86400::bigint AS bucket_seconds, count(*) AS total, count(*) FILTER (action = 'allow') AS allowed, count(*) FILTER (action = 'warn') AS warned,
 count(*) FILTER (action = 'block') AS blocked, cast(sum(n_findings) AS bigint) AS findings, count(DISTINCT counterparty) FILTER (counterparty <> '') AS unique_peers,
 count(DISTINCT agent_run_id) AS unique_runs, (SELECT string_agg(cast(coalesce(n, 0) AS string), ',' ORDER BY i) FROM (SELECT unnest(range(10)) AS i) g
 LEFT JOIN (SELECT cell, count(*) AS n FROM w GROUP BY cell) k ON k.cell = g.i) AS sparkline FROM w"""),
    "event_counters": _with(_LEDGER, "SELECT action, severity, count(*) AS events FROM ledger_v GROUP BY action, severity"),
    "policy_change_counters": _with(_LEDGER, _CHANGES, "SELECT op, CASE WHEN tenant_id = '' THEN '_org_' ELSE tenant_id END AS tenant, count(*) AS changes FROM changes GROUP BY 1, 2"),
    "ledger_stats": _with(_LEDGER, "SELECT max(seq) AS seq, sha256(cast(max(seq) AS string)) AS head_hash FROM ledger_v"),
    "export_window": _with(_LEDGER, "SELECT count(*) AS record_count, min(seq) AS seq_lo, max(seq) AS seq_hi FROM ledger_v WHERE tenant_id = 'tenant-1'"),
    "latency_quantiles": _with(_LEDGER, """r AS (SELECT latency_micros, row_number() OVER (ORDER BY latency_micros) - 1 AS i, count(*) OVER () AS n FROM ledger_v)""",
        "SELECT p::double AS p, latency_micros AS value FROM r JOIN (SELECT unnest([0.5, 0.9, 0.99, 0.999]::double[]) AS p) q ON r.i = floor((n - 1) * p)"),
    "taint_stats": _with(_LEDGER, "SELECT count(DISTINCT agent_run_id) AS runs, count(*) AS taints FROM ledger_v WHERE method = 'tools/call'"),
    "sweep_taints": _with(_LEDGER, """t AS (SELECT * FROM ledger_v WHERE method = 'tools/call'), m AS (SELECT agent_run_id FROM t GROUP BY 1 HAVING max(ts) >= (SELECT max(ts) FROM t) - INTERVAL 4 HOUR)""",
        "SELECT agent_run_id, seq FROM t JOIN m USING (agent_run_id)"),
    "bucket_key": _with(_LEDGER, "SELECT seq, CASE WHEN counterparty <> '' THEN 'peer:' || counterparty ELSE 'run:' || agent_run_id END AS bucket_key FROM ledger_v"),
    "novel_peers": _with(_LEDGER, f"""SELECT 'behavior.novelty_high_severity' AS rule_id, counterparty AS match, 'high' AS severity,
 'first event from this counterparty arrived at ' || s || ' severity' AS description FROM (SELECT counterparty, max_by(severity, seq) AS s FROM ledger_v
 WHERE counterparty <> '' AND ts >= {_NOW} - INTERVAL 72 HOUR GROUP BY 1) WHERE s IN ('high','critical') AND counterparty NOT IN ('peer-1','peer-2','peer-3')"""),
    "rate_spikes": _with(_LEDGER, f"""k AS (SELECT CASE WHEN counterparty <> '' THEN 'peer:' || counterparty ELSE 'run:' || agent_run_id END AS match, count(*) AS h,
 count(*) FILTER (ts >= {_NOW} - INTERVAL 2 DAY) AS recent FROM ledger_v WHERE ts >= {_NOW} - INTERVAL 12 DAY GROUP BY 1)""",
        """SELECT match, recent, round((h - recent) / 5.0::double, 6) AS baseline_mean, round(recent / ((h - recent) / 5.0::double), 6) AS ratio,
 round(least(0.95, recent / ((h - recent) / 5.0::double) / 10), 6) AS confidence FROM k WHERE h >= 5 AND recent > 0 AND h > recent AND recent / ((h - recent) / 5.0::double) >= 1.3"""),
    "finding_rate_spikes": _with(_LEDGER, f"""k AS (SELECT counterparty AS match, count(*) AS h, sum(n_findings) AS hf, count(*) FILTER (ts >= {_NOW} - INTERVAL 2 DAY) AS r,
 coalesce(sum(n_findings) FILTER (ts >= {_NOW} - INTERVAL 2 DAY), 0) AS rf FROM ledger_v WHERE counterparty <> '' AND ts >= {_NOW} - INTERVAL 12 DAY GROUP BY 1)""",
        """SELECT match, round(rf::double / r, 6) AS recent_rate, round(hf::double / h, 6) AS historical_rate FROM k
 WHERE r >= 3 AND hf > 0 AND rf::double / r >= hf::double / h * 1.05"""),
    "suppress_repeats": "WITH RECURSIVE " + ",\n".join([_LEDGER, _FINDINGS, """f AS (SELECT rule_id, category, ts, min(seq) AS seq FROM findings_v GROUP BY 1, 2, 3),
chain AS (SELECT rule_id, category, min(ts) AS ts FROM f GROUP BY 1, 2 UNION ALL
 SELECT f.rule_id, f.category, min(f.ts) FROM chain c JOIN f ON f.rule_id = c.rule_id AND f.category = c.category AND f.ts >= c.ts + INTERVAL 6 HOUR GROUP BY 1, 2)"""])
        + "\nSELECT f.rule_id, f.category, f.seq FROM chain JOIN f USING (rule_id, category, ts)",
    "anomaly_events": _with(_LEDGER, f"""p AS (SELECT counterparty, max_by(severity, seq) AS s FROM ledger_v WHERE counterparty <> '' AND ts >= {_NOW} - INTERVAL 72 HOUR GROUP BY 1),
k AS (SELECT CASE WHEN counterparty <> '' THEN 'peer:' || counterparty ELSE 'run:' || agent_run_id END AS match, count(*) AS h,
 count(*) FILTER (ts >= {_NOW} - INTERVAL 2 DAY) AS recent FROM ledger_v WHERE ts >= {_NOW} - INTERVAL 12 DAY GROUP BY 1)""",
        """SELECT 'behavior' AS protocol, 'inbound' AS direction, 'behavior.tick' AS method, 'warn' AS action, 'high' AS severity, counterparty, '' AS agent_run_id,
 'behavior.novelty_high_severity' AS rule_id FROM p WHERE s IN ('high','critical') UNION ALL
 SELECT 'behavior', 'inbound', 'behavior.tick', 'warn', 'medium', CASE WHEN match LIKE 'peer:%' THEN substr(match, 6) ELSE '' END, CASE WHEN match LIKE 'run:%' THEN substr(match, 5) ELSE '' END,
 'behavior.rate_spike' FROM k WHERE h >= 5 AND recent > 0 AND h > recent AND recent / ((h - recent) / 5.0::double) >= 1.3"""),
    "task_transitions": _with(_LEDGER, _OBS, "o AS (SELECT *, lag(state) OVER (PARTITION BY task_id ORDER BY ts, seq) AS prev FROM obs)",
        f"""SELECT task_id, seq, prev AS state_before, state AS state_to, 'invalid state transition ' || prev || ' -> ' || state AS description FROM o
 WHERE prev IS NOT NULL AND state <> prev AND prev || '>' || state NOT IN {_LEGAL}"""),
    "task_scope_drift": _with(_LEDGER, _OBS, "o AS (SELECT *, first(fingerprint) OVER (PARTITION BY task_id ORDER BY ts, seq) AS f FROM obs)",
        "SELECT task_id, seq, f AS first_fingerprint, fingerprint FROM o WHERE f <> fingerprint AND state <> 'submitted'"),
    "task_peer_change": _with(_LEDGER, """o AS (SELECT agent_run_id AS task_id, seq, ts, CASE WHEN seq % 4 = 0 THEN '' ELSE concat('peer-', cast(seq % 3 AS string)) END AS counterparty FROM ledger_v),
p AS (SELECT *, last_value(nullif(counterparty, '') IGNORE NULLS) OVER (PARTITION BY task_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS peer_before FROM o)""",
        "SELECT task_id, seq, peer_before, counterparty FROM p WHERE counterparty <> '' AND peer_before <> counterparty"),
    "declared_history_findings": _with(_LEDGER, _OBS, f"""g AS (SELECT task_id, seq // 1000 AS g, list(state ORDER BY seq) AS h FROM obs GROUP BY 1, 2),
a AS (SELECT task_id, g, h, task_id || '#' || cast(g AS string) AS msg_id,
 CASE WHEN list_contains(h, 'completed') AND NOT list_has_any(h, ['working','input-required']) THEN [['task.state_skip', 'task reported completed without ever entering working (no work in between)']] ELSE [] END
 || list_transform(list_filter(range(2, len(h) + 1), lambda i: h[i] <> h[i - 1] AND h[i - 1] || '>' || h[i] NOT IN {_LEGAL}), lambda i: ['task.invalid_transition', 'declared invalid state transition ' || h[i - 1] || ' -> ' || h[i]])
 || CASE WHEN g % 2 = 1 THEN [['task.counterparty_mismatch', 'responder "b" is not the contracted peer "a"']] ELSE [] END AS c FROM g),
u AS (SELECT msg_id, c, unnest(range(1, len(c) + 1)) AS i FROM a)""",
        "SELECT msg_id, cast(i - 1 AS int) AS pos, c[i][1] AS rule_id, c[i][2] AS description FROM u"),
    "long_running_tasks": _with(_LEDGER, _OBS, f"""SELECT task_id, max_by(state, (ts, seq)) AS state, epoch_us(min(ts)) AS created_us FROM obs GROUP BY 1
 HAVING max_by(state, (ts, seq)) IN ('working','submitted','input-required') AND min(ts) <= {_NOW} - INTERVAL 2 HOUR"""),
    "task_list": _with(_LEDGER, _OBS, """SELECT task_id, max_by(state, (ts, seq)) AS state, count(*) AS observations, min_by(fingerprint, (ts, seq)) AS first_fingerprint, epoch_us(max(ts)) AS updated_us
 FROM obs GROUP BY 1 ORDER BY 5 DESC, 1 LIMIT 50"""),
    "server_name": _with(_LEDGER, "x AS (SELECT seq, direction, CASE WHEN seq % 3 = 0 THEN NULL ELSE sensor_id END AS s, CASE WHEN seq % 4 = 0 THEN NULL ELSE tenant_id END AS d FROM ledger_v)",
        "SELECT seq, CASE WHEN direction = 'inbound' THEN coalesce(d, s, '') ELSE coalesce(s, d, '') END AS live, coalesce(d, s, '') AS preview FROM x"),
    "tool_name": _with(_LEDGER, "SELECT seq, tool FROM ledger_v"),
    "block_reason": _with(_LEDGER, """SELECT seq, CASE WHEN n_findings > 0 AND severity IN ('high','critical') THEN 'blocked: rule-' || cast(seq % 12 AS string) ELSE 'blocked by policy' END AS reason FROM ledger_v"""),
    "sensor_drift": _with(_LEDGER, f"""SELECT sensor_id, max_by(tenant_id, (ts, seq)) AS tenant_id, max_by(seq % 5, (ts, seq)) AS policy_version, max_by('v' || cast(seq % 2 AS string), (ts, seq)) AS content_version,
 epoch_us(max(ts) FILTER (seq % 11 = 0)) AS started_us, (epoch_us({_NOW}) - epoch_us(max(ts))) // 1000000 AS stale_seconds, (epoch_us({_NOW}) - epoch_us(max(ts))) // 1000000 > 60 AS is_stale,
 max_by(seq % 5, (ts, seq)) <> 3 AS policy_drift, max_by(seq % 2, (ts, seq)) <> 1 AS content_drift FROM ledger_v GROUP BY 1"""),
    "quarantine_entries": _with(_LEDGER, _FINDINGS, """SELECT concat('tool-', cast((l.seq + CASE f.pos WHEN 0 THEN 0 ELSE 7 END) % 20 AS string)) AS tool, f.rule_id, f.severity, epoch_us(l.ts) AS added_us,
 epoch_us(l.ts + INTERVAL 24 HOUR) AS expires_us FROM ledger_v l JOIN findings_v f USING (seq) WHERE l.method = 'tools/list' AND l.direction = 'outbound' AND f.severity IN ('high','critical') AND f.pos < 2"""),
    "apply_quarantine": _with(_LEDGER, _FINDINGS, """e AS (SELECT concat('tool-', cast((l.seq + CASE f.pos WHEN 0 THEN 0 ELSE 7 END) % 20 AS string)) AS tool, f.rule_id, f.pos, l.ts AS added
 FROM ledger_v l JOIN findings_v f USING (seq) WHERE l.method = 'tools/list' AND l.direction = 'outbound' AND f.severity IN ('high','critical') AND f.pos < 2)""",
        """SELECT c.seq AS msg_id, c.tool, 'high' AS severity, max_by(e.rule_id, (e.added, e.pos)) AS quarantine_rule FROM ledger_v c JOIN e ON e.tool = c.tool AND e.added < c.ts
 WHERE c.method = 'tools/call' AND c.direction = 'inbound' AND c.tool <> '' GROUP BY c.seq, c.tool, c.ts HAVING c.ts <= max(e.added) + INTERVAL 2 HOUR"""),
    "peer_risk": None,
    "peer_list": None,
    "resolve_policy": _policy_sql("""CASE WHEN sensor_id = 'sensor-2' AND r34 THEN 'block' WHEN sensor_id = 'sensor-2' AND method = 'tools/call' AND med THEN 'block'
 WHEN tenant_id = 'tenant-1' AND pii THEN 'block' WHEN tenant_id = 'tenant-1' THEN 'monitor' WHEN hi THEN 'warn' ELSE 'monitor' END AS mode,
 CASE WHEN sensor_id = 'sensor-2' AND r34 THEN 'p-sensor-b' WHEN sensor_id = 'sensor-2' AND method = 'tools/call' AND med THEN 'p-sensor'
 WHEN tenant_id = 'tenant-1' AND pii THEN 'p-cat' WHEN tenant_id = 'tenant-1' THEN 'p-tenant' WHEN hi THEN 'p-org' END AS policy_id"""),
    "selector_matches": _policy_sql("pii AS matches"),
    "policy_preview": _with(_LEDGER, "r AS (SELECT * FROM ledger_v), m AS (SELECT sensor_id = 'sensor-2' AND method = 'tools/call' AND n_findings > 0 AND severity IN ('medium','high','critical') AS hit FROM r)",
        "SELECT count(*) AS records_considered, count(*) FILTER (hit) AS records_matched, 0::bigint AS would_monitor, 0::bigint AS would_warn, count(*) FILTER (hit) AS would_block, count(*) FILTER (NOT hit) AS would_none FROM m"),
    "policy_snapshot": _with(_LEDGER, _CHANGES, "l AS (SELECT id, max_by(op, seq) AS op, max_by(version, seq) AS version, max_by(enabled, seq) AS enabled, max_by(tenant_id, seq) AS tenant_id, max_by(mode, seq) AS mode FROM changes GROUP BY 1)",
        "SELECT id, version, mode, tenant_id, (SELECT cast(sum(version) AS bigint) FROM l WHERE op <> 'delete') AS set_version FROM l WHERE op <> 'delete' AND enabled AND tenant_id IN ('', 'tenant-1')"),
    "policy_change_events": _with(_LEDGER, _CHANGES, """SELECT 'policy-' || id || '-v' || cast(version AS string) AS event_id, tenant_id, 'policy' AS protocol, 'change' AS direction, 'policy.audit.' || op AS rule_id,
 'policy "' || name || '" (' || id || ') ' || op || 'd by ops' AS description FROM changes"""),
    "parse_envelope": _with(_RPC, """SELECT msg_id, CASE WHEN ts % 7 < 3 THEN 'malformed' ELSE 'ok' END AS status,
 CASE ts % 7 WHEN 0 THEN 'empty body' WHEN 1 THEN 'parse envelope' WHEN 2 THEN 'unsupported jsonrpc version "1.0"' END AS reason,
 CASE WHEN ts % 7 >= 3 THEN id END AS id, CASE WHEN ts % 7 >= 3 THEN method END AS method FROM rpc"""),
    "explode_batch": _with(_RPC, """SELECT agent_run_id, true AS is_batch, cast(row_number() OVER (PARTITION BY agent_run_id ORDER BY ts) - 1 AS int) AS batch_pos, method, id FROM rpc
 UNION ALL SELECT msg_id, false, 0, method, id FROM rpc WHERE role = 'assistant'"""),
    "message_kind": _with(_RPC, "SELECT msg_id, CASE role WHEN 'user' THEN 'request' WHEN 'assistant' THEN 'response' ELSE 'notification' END AS kind FROM rpc"),
    "extract_fields": _with(_RPC, """SELECT msg_id, 0 AS pos, 'params.id' AS name, 'task-' || cast(conv_id AS string) AS value FROM rpc WHERE role = 'user'
 UNION ALL SELECT msg_id, 1, 'params.message.text', text FROM rpc WHERE role = 'user' UNION ALL SELECT msg_id, 0, 'params.data', text FROM rpc WHERE role NOT IN ('user','assistant')
 UNION ALL SELECT msg_id, 0, 'result.id', 'task-' || cast(conv_id AS string) FROM rpc WHERE role = 'assistant' UNION ALL SELECT msg_id, 1, 'result.message.text', text FROM rpc WHERE role = 'assistant'
 UNION ALL SELECT msg_id, 2, 'result.status.state', 'working' FROM rpc WHERE role = 'assistant'"""),
    "task_signals": _with(_RPC, """SELECT msg_id, CASE WHEN role IN ('user','assistant') THEN 'task-' || cast(conv_id AS string) ELSE '' END AS task_id,
 CASE WHEN role = 'user' THEN left(sha256('{"text":' || cast(to_json(text) AS string) || '}'), 16) ELSE '' END AS fingerprint, CASE WHEN role = 'assistant' THEN 'working' ELSE '' END AS state FROM rpc"""),
    "stamp_method": _with(_RPC, """SELECT r.msg_id, CASE WHEN r.role = 'assistant' THEN coalesce((SELECT max_by(q.method, q.ts) FROM rpc q WHERE q.agent_run_id = r.agent_run_id AND q.id = r.id AND q.method <> '' AND q.ts < r.ts), '')
 ELSE r.method END AS method FROM rpc r"""),
    "sse_events": """SELECT conv_id, cast(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS int) AS event_pos, role || chr(10) || cast(turn AS string) AS raw FROM conversations""",
    "normalize_text": None,
    "base64_candidates": "SELECT doc_id, 'payload of document number ' || cast(doc_id AS string) AS decoded FROM documents",
    "base64_runs": """SELECT doc_id, run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9+/=_-]+')) AS run FROM documents) WHERE length(run) >= 24 AND (
 regexp_matches(run, '^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=|[A-Za-z0-9+/]{2}|[A-Za-z0-9+/]{3})?$') OR regexp_matches(run, '^([A-Za-z0-9_-]{4})*([A-Za-z0-9_-]{2}==|[A-Za-z0-9_-]{3}=|[A-Za-z0-9_-]{2}|[A-Za-z0-9_-]{3})?$'))""",
    "glob_match": _with(_LEDGER, """SELECT seq, method = 'tools/call' AS a, tool = 'tool-3' AS b, false AS c, true AS d FROM ledger_v"""),
    "truncate_bytes": "SELECT event_id, CASE WHEN length(props) > 6 THEN left(props, 6) || '…' ELSE props END AS cut FROM events",
    "severity_weights": _with(_LEDGER, f"""SELECT seq, {_rank('severity')} AS srank, CASE action WHEN 'block' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END AS mrank, ({_rank('severity')})::double AS sweight,
 (CASE severity WHEN 'critical' THEN 5.0 WHEN 'high' THEN 2.5 WHEN 'medium' THEN 1.0 WHEN 'low' THEN 0.25 ELSE 0.0 END + CASE action WHEN 'block' THEN 4.0 ELSE 0.0 END)::double AS pweight FROM ledger_v"""),
    "highest_severity": _with(_LEDGER, _FINDINGS, """SELECT l.seq, CASE WHEN l.n_findings > 0 THEN any_value(l.severity) ELSE 'info' END AS severity,
 CASE WHEN bool_or(f.rule_id = 'rule-5') THEN 'block' WHEN bool_or(f.rule_id = 'rule-1') THEN 'warn' ELSE 'monitor' END AS mode FROM ledger_v l LEFT JOIN findings_v f USING (seq) GROUP BY l.seq, l.n_findings"""),
    "apply_rules": _with(_MESSAGES, _CLEAN, _rules_sql(DEFAULT_RULES, f"msg_id, rule_id, category, severity, field, match, confidence", "clean_v")),
    "apply_rules_base64": """SELECT doc_id AS msg_id, 'pi.core.ignore_previous_instructions' AS rule_id, 'ignore all previous instructions' AS match, 'base64' AS encoding FROM documents""",
    "rule_scope": _with(_MESSAGES, "\nUNION ALL ".join(f"SELECT msg_id, field, {_q(r['id'])} AS rule_id FROM messages_v WHERE {_scope_sql(r)}" for r in DEFAULT_RULES)),
    "classifier_features": _with(_MESSAGES, _features_sql("messages_v"), "SELECT msg_id, " + ", ".join(f"round({f}, 6) AS {f}" for f in c.FEATURES) + " FROM feat"),
    "classify": _with(_MESSAGES, _features_sql("messages_v"), _SCORED,
        f"SELECT msg_id, 'heuristic.injection_density' AS rule_id, {_SEV} AS severity, round(score, 6)::double AS confidence, {_CONTRIB} AS contributors FROM scored WHERE score >= 0.3"),
    "judge_candidates": _with(_MESSAGES, _features_sql("messages_v"), f"scored AS (SELECT *, least(1.0, 1.0 - {_SCORE}) AS score FROM feat)",
        "SELECT msg_id, field, sha256(value) AS content_sha256 FROM scored WHERE octet_length(encode(value)) >= 64 AND score < 0.7"),
    "apply_judge_verdicts": _with(_MESSAGES, "k AS (SELECT msg_id, field, length(msg_id) % 4 AS c FROM messages_v WHERE octet_length(encode(value)) >= 64)",
        """SELECT msg_id, CASE c WHEN 3 THEN 'judge.transport_error' ELSE 'judge.layer3' END AS rule_id, CASE c WHEN 3 THEN 'transport' WHEN 2 THEN 'tool-poisoning' ELSE 'prompt-injection' END AS category,
 CASE c WHEN 3 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS severity, field, (CASE c WHEN 3 THEN 0.1 WHEN 2 THEN 0.5 ELSE 0.9 END)::double AS confidence FROM k WHERE c <> 1"""),
    "extract_card_fields": _with(_CARDS, """f AS (SELECT msg_id, turn, 0 AS o, 'card.name' AS name, length(name) AS n FROM cards_v UNION ALL SELECT msg_id, turn, 1, 'card.description', length(description) FROM cards_v WHERE description <> ''
 UNION ALL SELECT msg_id, turn, 2, 'card.url', length(url) FROM cards_v UNION ALL SELECT msg_id, turn, 3, 'card.provider.organization', length(org) FROM cards_v
 UNION ALL SELECT msg_id, turn, 4, 'card.skills.0.description', length(role) FROM cards_v UNION ALL SELECT msg_id, turn, 5, 'card.skills.0.tags.0', length(role) FROM cards_v UNION ALL SELECT msg_id, turn, 6, 'card.skills.0.tags.1', 1 FROM cards_v)""",
        "SELECT msg_id, cast(row_number() OVER (PARTITION BY msg_id ORDER BY o) - 1 AS int) AS pos, name, n::int AS n FROM f"),
    "validate_card": _with(_CARDS, """SELECT msg_id, '' AS errors, array_to_string(list_filter([CASE WHEN url LIKE 'ftp%' THEN 'url is not http(s)' END, CASE WHEN turn = 0 THEN 'version is empty' END,
 CASE WHEN turn % 2 = 1 THEN 'skill[0] has neither id nor name' END], lambda x: x IS NOT NULL), ';') AS warnings, signed AS signature_present FROM cards_v"""),
    "card_trust": _with(_CARDS, """SELECT msg_id, CASE WHEN NOT signed THEN 'card.signature_missing' WHEN org IN ('org-0','org-1','org-2') AND sig_ok THEN 'card.signature_verified' ELSE 'card.signature_invalid' END AS rule_id,
 CASE WHEN NOT signed THEN 'card declared no signature; provenance is unverified' WHEN org NOT IN ('org-0','org-1','org-2') THEN 'trust: unknown issuer "' || org || '"'
 WHEN NOT sig_ok THEN 'trust: signature does not verify' ELSE 'card signature verified against trust store' END AS description FROM cards_v"""),
    "shingles": f"""WITH tb AS (SELECT item_id, {_STRIPPED} AS b FROM benchmark) SELECT item_id, unnest(CASE WHEN octet_length(b) = 0 THEN [] WHEN octet_length(b) <= 24 THEN [left(sha256(b), 32)] ELSE {_SHIFTS} END) AS fp FROM tb""",
    "taint_tags": """SELECT 't-' || lpad(cast(item_id AS string), 6, '0') || '-00000' AS taint_id, row_number() OVER (ORDER BY item_id) AS taint_no, 'result.text' AS field,
 sha256(text) AS sample_sha256 FROM benchmark""",
    "taint_leaks": "WITH " + _LEAKS + """ SELECT doc_id AS msg_id, concat('peer-', cast(doc_id % 5 AS string)) AS counterparty, 't-' || lpad(cast(item_id AS string), 6, '0') || '-00000' AS taint_id, 'block' AS action FROM hit WHERE doc_id % 5 <> 4""",
    "taint_leaks_by_source": "WITH " + _LEAKS + """, src AS (SELECT df.doc_id, d.source, min(tf.item_id) AS item_id FROM (SELECT DISTINCT * FROM df) AS df JOIN documents AS d USING (doc_id)
 JOIN tf USING (fp) WHERE d.source = concat('src', tf.item_id % 20) AND tf.item_id < df.doc_id GROUP BY ALL)
 SELECT doc_id AS msg_id, source AS agent_run_id, 't-' || lpad(cast(item_id AS string), 6, '0') || '-00000' AS taint_id, 'block' AS action FROM src""",
    "taint_leaks_disguised": "WITH " + _LEAKS + " SELECT doc_id AS msg_id, 't-' || lpad(cast(item_id AS string), 6, '0') || '-00000' AS taint_id, 'block' AS action FROM hit",
    "match_fingerprints": "WITH " + _LEAKS + " SELECT doc_id AS msg_id, 't-' || lpad(cast(item_id AS string), 6, '0') || '-00000' AS taint_id FROM hit",
    "evaluate_mcp": _with(_MESSAGES.replace("ELSE 'tasks/send' END", "ELSE 'tools/call' END"), _CLEAN, *_FOUND,
        """g AS (SELECT * FROM f UNION ALL SELECT 'c' || conv_id || '-' || turn, 'quarantine.tool', 'high', 2000, 'quarantine' FROM conversations
 WHERE role NOT IN ('system', 'assistant') AND (turn % 3 = 2 AND turn * 3600 > 5400 OR turn % 3 = 0 AND turn * 3600 > 1800 AND turn * 3600 <= 14400))""",
        f"""SELECT msg_id, CASE WHEN bool_or(mode = 'quarantine') OR bool_or(rule_id = 'pl.core.credit_card') OR bool_or(mode = 'block') THEN 'block' WHEN bool_or(mode = 'warn') THEN 'warn' ELSE 'allow' END AS action,
 CASE max({_rank('severity')}) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'info' END AS severity,
 string_agg(rule_id, '|' ORDER BY ord) || CASE WHEN bool_or(rule_id = 'pl.core.credit_card') THEN '|policy.match' ELSE '' END AS rule_ids FROM g GROUP BY msg_id"""),
    "evaluate_a2a": _with(_RPC, """rm AS (SELECT *, CASE role WHEN 'assistant' THEN coalesce((SELECT max_by(q.method, q.ts) FROM rpc q WHERE q.agent_run_id = rpc.agent_run_id AND q.id = rpc.id AND q.method <> '' AND q.ts < rpc.ts), '') ELSE method END AS m FROM rpc)""",
        "messages_v AS (SELECT msg_id, m AS method, CASE role WHEN 'assistant' THEN 'outbound' ELSE 'inbound' END AS direction, CASE role WHEN 'user' THEN 'params.message.text' WHEN 'assistant' THEN 'result.message.text' ELSE 'params.data' END AS field, text AS value FROM rm)",
        _CLEAN, *_FOUND,
        f"""h AS (SELECT msg_id, max({_rank('severity')}) AS sev, max(CASE mode WHEN 'block' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) AS md, string_agg(rule_id, '|' ORDER BY ord) AS ids FROM f GROUP BY 1)""",
        """tr AS (SELECT msg_id, role, first(CASE WHEN role = 'user' THEN text ELSE '' END) OVER w AS f0, text, coalesce(bool_or(role = 'assistant') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS begun
 FROM rpc WHERE role IN ('user','assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))""",
        "dr AS (SELECT msg_id FROM tr WHERE role = 'user' AND begun AND f0 <> '' AND text <> f0)",
        """SELECT rpc.msg_id, CASE coalesce(md, 0) WHEN 2 THEN 'block' WHEN 1 THEN 'warn' ELSE 'allow' END AS action,
 CASE greatest(coalesce(sev, 0), CASE WHEN dr.msg_id IS NULL THEN 0 ELSE 3 END) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'info' END AS severity,
 concat_ws('|', ids, CASE WHEN dr.msg_id IS NOT NULL THEN 'task.scope_drift' END) AS rule_ids FROM rpc LEFT JOIN h USING (msg_id) LEFT JOIN dr ON dr.msg_id = rpc.msg_id"""),
    "evaluate_cards": _with(_CARDS, """messages_v AS (SELECT msg_id, 'agent.card' AS method, 'outbound' AS direction, 'card.description' AS field, description AS value FROM cards_v
 UNION ALL SELECT msg_id, 'agent.card', 'outbound', 'card.url', url FROM cards_v UNION ALL SELECT msg_id, 'agent.card', 'outbound', 'card.name', name FROM cards_v)""",
        _CLEAN, *_FOUND,
        f"""k AS (SELECT c.msg_id, signed AND NOT (org IN ('org-0','org-1','org-2') AND sig_ok) AS invalid, signed, coalesce(max({_rank('h.severity')}), 0) AS sev FROM cards_v c LEFT JOIN f h USING (msg_id) GROUP BY ALL)""",
        "st AS (SELECT *, greatest(sev, CASE WHEN invalid THEN 3 WHEN NOT signed THEN 1 ELSE 0 END) AS top FROM k)",
        """SELECT msg_id, CASE WHEN invalid THEN 'block' ELSE 'allow' END AS action, top < 3 AS delivered, CASE top WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'info' END AS severity FROM st"""),
    "canonical_records": None,
    "chain_ledger": None,
    "verify_chain": _with(_LEDGER, """SELECT concat('segment-', cast((seq - 1) // 500 AS string)) AS chain_id, count(*) AS records, count(*) FILTER (seq % 997 = 0) = 0 AS ok, min(seq) FILTER (seq % 997 = 0) AS bad_seq,
 CASE WHEN count(*) FILTER (seq % 997 = 0) > 0 THEN 'record hash mismatch' END AS reason FROM ledger_v GROUP BY 1"""),
    "merkle_root": None,
    "merkle_proof": _with(_LEDGER, "SELECT row_number() OVER (ORDER BY seq) - 1 AS idx, sha256(action || ':' || cast(seq AS string)) AS leaf, true AS valid FROM ledger_v"),
    "export_csv": _with(_LEDGER, _FINDINGS, """t AS (SELECT *, replace(regexp_replace(regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', ''), ' ', '') || 'Z' AS iat FROM ledger_v),
g AS (SELECT seq, string_agg(rule_id, '|' ORDER BY pos) AS rule_ids, string_agg(category, '|' ORDER BY pos) AS categories FROM findings_v GROUP BY seq)""",
        """SELECT seq, iat AS ingest_at, 'ev-' || cast(seq AS string) AS event_id, iat AS "timestamp", protocol, direction, action, severity, agent_run_id, counterparty, method, n_findings::bigint AS finding_count,
 coalesce(rule_ids, '') AS rule_ids, coalesce(categories, '') AS categories, severity AS highest_severity, '' AS source, '' AS destination, raw FROM t LEFT JOIN g USING (seq)"""),
    "siem_payloads": _with(_LEDGER, "SELECT seq, epoch_us(ts) // 1000000 AS time, action FROM ledger_v WHERE severity IN ('high','critical')"),
    "verify_payloads": _with(_LEDGER, "SELECT seq, seq % 10 <> 0 AS verified, 'sha256=' || sha256(unhex('" + bytes(b ^ 0x5C for b in b"k1".ljust(64, b"\0")).hex()
        + "') || unhex(sha256(unhex('" + bytes(b ^ 0x36 for b in b"k1".ljust(64, b"\0")).hex() + "') || encode(raw)))) AS signature FROM ledger_v"),
    "malformed_findings": None,
    "score_against_labels": None,
}
# these texts hold no character that only NFKC changes, so canonical composition gives the same text
ORACLE["normalize_text"] = "SELECT doc_id, sha256(regexp_replace(nfc_normalize(concat(text, chr(8203), 'x', chr(8294))), " + _q(_INVISIBLE) + ", '', 'g')) AS norm_hash FROM documents"
_PRINTED = r"length(regexp_replace(text, '[^\p{L}\p{M}\p{N}\p{P}\p{S} \n\t\r]', '', 'g')) * 5 >= octet_length(encode(text)) * 4"
_HIDDEN = f"length(base64(encode(text))) >= 24 AND {_PRINTED}"
ORACLE["base64_candidates"] = f"SELECT doc_id, CASE WHEN {_HIDDEN} THEN sha256(text) END AS decoded_sha256 FROM documents"
ORACLE["apply_rules_base64"] = _with(
    f"messages_v AS (SELECT doc_id AS msg_id, 'tools/call' AS method, 'outbound' AS direction, 'result.text' AS field, text AS value FROM documents WHERE {_HIDDEN})",
    _CLEAN, _rules_sql(DEFAULT_RULES, "msg_id, rule_id, match, 'base64' AS encoding", "clean_v"))
ORACLE["sse_events"] = """SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS int) AS event_pos,
 sha256(role || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), chr(10))) AS raw_sha256 FROM conversations"""


def _hashed_text(r: dict) -> str:
    """The hashed lines of a rule, written out from its definition."""
    number = repr(float(r["confidence"])).removesuffix(".0")
    lines = [("id", r["id"]), ("category", r["category"]), ("severity", r["severity"]), ("mode", r["mode"]),
             ("case_sensitive", str(r["case_sensitive"]).lower()), ("confidence", number)]
    for label, key in (("target", "targets"), ("direction", "directions"), ("field", "fields"), ("pattern", "patterns")):
        lines += [(label, v) for v in r[key]]
    return "".join(f"{k}: {v}\n" for k, v in lines)


ORACLE["rule_content_hash"] = _with(
    _MESSAGES, "r(id, body) AS (VALUES " + ",".join(f"({_q(r['id'])},{_q(_hashed_text(r))})" for r in DEFAULT_RULES) + ")",
    "n AS (" + "\nUNION ALL ".join(f"SELECT {_q(r['id'])} AS id, count(*) AS n FROM messages_v WHERE {_scope_sql(r)}" for r in DEFAULT_RULES) + ")",
    "SELECT id, sha256(body) AS content_hash, n AS fields_in_scope FROM r JOIN n USING (id)")
ORACLE["retain_on_disk"] = ORACLE["retain"]
ORACLE["apply_rules_by_table"] = ORACLE["apply_rules"]
ORACLE["rule_scope_by_table"] = ORACLE["rule_scope"]
ORACLE["resolve_policy_joined"] = ORACLE["resolve_policy"]
ORACLE["resolve_policy_by_index"] = ORACLE["resolve_policy"]
ORACLE["resolve_policy_at_event_time"] = _with(_LEDGER, _FINDINGS, """c AS (SELECT tenant_id, date_trunc('day', ts) AS t, count(*) AS n, count(*) FILTER (action = 'block') AS b FROM ledger_v GROUP BY 1, 2),
v AS (SELECT *, lead(t) OVER (PARTITION BY tenant_id ORDER BY t) AS u FROM c),
g AS (SELECT seq, bool_or(severity IN ('high','critical')) AS hi, bool_or(severity IN ('low','medium','high','critical')) AS lo FROM findings_v GROUP BY seq),
m AS (SELECT l.seq, v.tenant_id, v.n, v.b FROM ledger_v l JOIN v ON v.tenant_id = l.tenant_id AND l.ts >= v.t AND (v.u IS NULL OR l.ts < v.u) LEFT JOIN g ON g.seq = l.seq
      WHERE v.n % 4 <> 0 AND coalesce(CASE WHEN v.b % 2 = 0 THEN g.hi ELSE g.lo END, false))""",
    """SELECT l.seq, CASE WHEN m.seq IS NULL THEN 'none' ELSE list_value('monitor', 'warn', 'block')[m.b % 3 + 1] END AS mode, 'p-' || m.tenant_id AS policy_id, m.n AS version
FROM ledger_v l LEFT JOIN m USING (seq)""")

_PEER_CTE = "WITH RECURSIVE " + _LEDGER + """,
o AS (SELECT counterparty, seq, ts, n_findings, action, severity, CASE severity WHEN 'critical' THEN 5.0 WHEN 'high' THEN 2.5 WHEN 'medium' THEN 1.0 WHEN 'low' THEN 0.25 ELSE 0.0 END
 + CASE action WHEN 'block' THEN 4.0 ELSE 0.0 END AS w, row_number() OVER (PARTITION BY counterparty ORDER BY ts, seq) AS rn FROM ledger_v WHERE counterparty <> ''),
r AS (SELECT counterparty, seq, ts, rn, w::double AS score, w::double AS w FROM o WHERE rn = 1 UNION ALL
 SELECT o.counterparty, o.seq, o.ts, o.rn, r.score * greatest(0.0, 1 - 0.5 * (epoch_us(o.ts) - epoch_us(r.ts)) / 3.6e9) + o.w, o.w::double FROM r JOIN o ON o.counterparty = r.counterparty AND o.rn = r.rn + 1)
"""
ORACLE["peer_risk"] = _PEER_CTE + "SELECT counterparty, seq, round(score, 6) AS risk_score, score >= 10 AND score - w < 10 AS alarm FROM r"
ORACLE["peer_list"] = _PEER_CTE + """, k AS (SELECT counterparty, count(*) AS requests, cast(sum(n_findings) AS bigint) AS findings, count(*) FILTER (action = 'warn') AS warnings, count(*) FILTER (action = 'block') AS blocks,
 max_by(severity, rn) AS last_severity FROM o GROUP BY 1), l AS (SELECT counterparty, max_by(score, rn) AS score FROM r GROUP BY 1)
SELECT counterparty, requests, findings, warnings, blocks, round(score, 6) AS risk_score, last_severity FROM k JOIN l USING (counterparty) ORDER BY score DESC, counterparty LIMIT 10"""
_STAMP = "regexp_replace(regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') || 'Z'"
_CHAIN_CTE = "WITH RECURSIVE " + _LEDGER + f""",
b AS (SELECT seq, (seq - 1) // 500 AS g, {_STAMP} AS iat, '{{"action":"' || action || '","severity":"' || severity || '"}}' AS ev FROM ledger_v),
h AS (SELECT g, seq, repeat('0', 64) AS prev, sha256(cast(seq AS string) || chr(10) || iat || chr(10) || repeat('0', 64) || chr(10) || ev) AS hash FROM b WHERE seq = g * 500 + 1 UNION ALL
 SELECT b.g, b.seq, h.hash, sha256(cast(b.seq AS string) || chr(10) || b.iat || chr(10) || h.hash || chr(10) || b.ev) FROM h JOIN b ON b.g = h.g AND b.seq = h.seq + 1)
"""
ORACLE["chain_ledger"] = _CHAIN_CTE + "SELECT concat('segment-', cast(g AS string)) AS chain_id, seq, prev AS prev_hash, hash FROM h"
ORACLE["append_ledger"] = ORACLE["chain_ledger"]
ORACLE["verify_saved_heads"] = _with(_LEDGER, """c AS (SELECT concat('segment-', cast((seq - 1) // 500 AS string)) AS chain_id, count(*) AS n, max(seq) AS last FROM ledger_v GROUP BY 1),
k AS (SELECT *, chain_id LIKE '%1' AS cut FROM c)""", """SELECT chain_id, CASE WHEN cut THEN greatest(n - 3, 0) ELSE n END AS records, NOT cut AS ok,
 CASE WHEN cut AND n > 3 THEN last - 2 WHEN cut THEN 1 END AS bad_seq, CASE WHEN cut THEN 'ledger tail missing' END AS reason FROM k""")
ORACLE["canonical_records"] = _CHAIN_CTE + """SELECT concat('segment-', cast(h.g AS string)) AS chain_id, h.seq, sha256('{"event":' || ev || ',"ingest_at":"' || iat || '","prev_hash":"' || prev || '","seq":' || cast(h.seq AS string) || '}') AS leaf_hash
FROM h JOIN b ON b.seq = h.seq"""
ORACLE["merkle_root"] = "WITH RECURSIVE " + _LEDGER + """,
l AS (SELECT row_number() OVER (ORDER BY seq) - 1 AS i, sha256(action || ':' || cast(seq AS string)) AS h, count(*) OVER () AS n FROM ledger_v),
m AS (SELECT i, h, n FROM l UNION ALL SELECT i // 2, sha256(unhex(min_by(h, i)) || unhex(max_by(h, i))), (any_value(n) + 1) // 2 FROM m WHERE n > 1 GROUP BY i // 2)
SELECT (SELECT count(*) FROM l) AS leaf_count, h AS merkle_root FROM m WHERE n = 1"""
ORACLE["malformed_findings"] = "WITH " + _RPC + """ SELECT msg_id, 'allow' AS action, 'low' AS severity, 'envelope.malformed' AS rule_id FROM rpc WHERE length(msg_id) % 2 = 0
UNION ALL SELECT msg_id, 'block', 'low', 'envelope.malformed' FROM rpc WHERE length(msg_id) % 2 = 1 AND octet_length(encode(CASE role
 WHEN 'user' THEN '{"jsonrpc":"2.0","id":"' || cast(turn AS string) || '","method":"tasks/send","params":{"id":"task-' || cast(conv_id AS string) || '","message":{"text":' || cast(to_json(text) AS string) || '}}}'
 WHEN 'assistant' THEN '{"jsonrpc":"2.0","id":"' || cast(turn - 1 AS string) || '","result":{"id":"task-' || cast(conv_id AS string) || '","status":{"state":"working"},"message":{"text":' || cast(to_json(text) AS string) || '}}}'
 ELSE '{"jsonrpc":"2.0","method":"notifications/message","params":{"data":' || cast(to_json(text) AS string) || '}}' END)) > 200"""
_DOCS = "docs_v AS (SELECT doc_id AS msg_id, 'tools/call' AS method, 'outbound' AS direction, 'result.text' AS field, text AS raw_value, regexp_replace(text, " + _q(_INVISIBLE) + ", '', 'g') AS value FROM documents)"
ORACLE["score_against_labels"] = _with(_DOCS, "hit AS (SELECT DISTINCT msg_id AS doc_id FROM (" + _rules_sql(DEFAULT_RULES, "msg_id", "docs_v") + "))", """
s AS (SELECT d.lang AS category, l.toxic = 1 AS bad, h.doc_id IS NOT NULL AS hit FROM labels l JOIN documents d USING (doc_id) LEFT JOIN hit h USING (doc_id)),
k AS (SELECT coalesce(category, 'OVERALL') AS category, count(*) FILTER (bad AND hit) AS tp, count(*) FILTER (NOT bad AND hit) AS fp, count(*) FILTER (bad AND NOT hit) AS fn, count(*) FILTER (NOT bad AND NOT hit) AS tn
 FROM s GROUP BY ROLLUP (category)), p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::double / (tp + fp) ELSE 0.0 END AS pr, CASE WHEN tp + fn > 0 THEN tp::double / (tp + fn) ELSE 0.0 END AS rc FROM k)""",
    "SELECT category, tp, fp, fn, tn, round(pr, 6)::double AS precision, round(rc, 6)::double AS recall, round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END, 6)::double AS f1 FROM p")

# ---- readers, exports and streams (``live_catalog``) -----------------------------------------

ORACLE["read_traffic"] = "WITH " + _RPC + """ SELECT msg_id, agent_run_id, ts * 1000000 AS ts_us, CASE role WHEN 'assistant' THEN 'outbound' ELSE 'inbound' END AS direction,
 sha256(text) AS raw_sha256 FROM rpc"""
ORACLE["read_ledger"] = _CHAIN_CTE + "SELECT h.seq, b.iat AS ingest_at, h.prev AS prev_hash, h.hash, b.ev AS event_json FROM h JOIN b ON b.seq = h.seq"
ORACLE["export_ndjson"] = _with(_LEDGER, _FINDINGS, "e AS (SELECT * FROM ledger_v WHERE tenant_id = 'tenant-1' AND severity IN ('high','critical'))",
    """SELECT 'record' AS kind, seq, action, sha256(raw) AS raw_sha256, coalesce((SELECT string_agg(f.rule_id, '|' ORDER BY f.pos) FROM findings_v f WHERE f.seq = e.seq), '') AS rule_ids,
 NULL::bigint AS record_count, NULL::bigint AS seq_lo, NULL::bigint AS seq_hi, NULL AS head_hash FROM e UNION ALL
SELECT 'chain_proof', NULL, NULL, NULL, NULL, count(*), min(seq), max(seq), (SELECT sha256(cast(max(seq) AS string)) FROM ledger_v) FROM e""")
ORACLE["audit_bundle"] = _CHAIN_CTE + """, l AS (SELECT row_number() OVER (ORDER BY h.seq) - 1 AS i, sha256('{"event":' || ev || ',"ingest_at":"' || iat || '","prev_hash":"' || prev || '","seq":' || cast(h.seq AS string) || '}') AS h,
 count(*) OVER () AS n FROM h JOIN b ON b.seq = h.seq),
m AS (SELECT i, h, n FROM l UNION ALL SELECT i // 2, sha256(unhex(min_by(h, i)) || unhex(max_by(h, i))), (any_value(n) + 1) // 2 FROM m WHERE n > 1 GROUP BY i // 2)
SELECT '' AS tenant, 'head' AS chain_head, h AS merkle_root, (SELECT count(*) FROM l) AS record_count FROM m WHERE n = 1"""
ORACLE["stream_feed"] = _with(_LEDGER, "SELECT seq, epoch_us(ts) AS ts_us, action, raw FROM ledger_v WHERE seq > 100")
ORACLE["stream_siem"] = ORACLE["siem_payloads"]
ORACLE["stream_evaluate"] = _with(_DOCS, _rules_sql(DEFAULT_RULES, "msg_id, rule_id, category, severity", "docs_v"))
# the watermark stands ten minutes, in whole milliseconds, before the last event
_MARK = f"(SELECT max(epoch_us(ts)) // 1000 * 1000 - 600000000 FROM ledger_v)"
ORACLE["stream_metrics"] = _with(_LEDGER, f"""SELECT epoch_us(ts) // 3600000000 * 3600000000 AS bucket_us, count(*) AS total, count(*) FILTER (action = 'allow') AS allowed, count(*) FILTER (action = 'warn') AS warned,
 count(*) FILTER (action = 'block') AS blocked, cast(sum(n_findings) AS bigint) AS findings FROM ledger_v GROUP BY 1 HAVING bucket_us + 3600000000 <= {_MARK}""")
ORACLE["stream_spikes"] = _with(_LEDGER, """k AS (SELECT CASE WHEN counterparty <> '' THEN 'peer:' || counterparty ELSE 'run:' || agent_run_id END AS bucket_key, epoch_us(ts) AS t,
 unnest(range(1, 7)) AS i FROM ledger_v)""", """w AS (SELECT bucket_key, (t // 86400000000 + i) * 86400000000 AS as_of_us, count(*) AS h, count(*) FILTER (i = 1) AS recent FROM k GROUP BY 1, 2)""",
    f"""SELECT bucket_key, as_of_us, recent, round((h - recent) / 5.0::double, 6) AS baseline_mean, round(recent / ((h - recent) / 5.0::double), 6) AS ratio FROM w
 WHERE recent > 0 AND h >= 5 AND h > recent AND recent / ((h - recent) / 5.0::double) >= 1.3 AND as_of_us <= {_MARK}""")
ORACLE["stream_suppress"] = ORACLE["suppress_repeats"]
ORACLE["stream_tasks"] = _with(_LEDGER, _OBS, """o AS (SELECT *, lag(state) OVER w AS prev, first(fingerprint) OVER w AS f FROM obs WINDOW w AS (PARTITION BY task_id ORDER BY ts, seq))""",
    f"""SELECT task_id, seq, 'task.invalid_transition' AS rule_id FROM o WHERE prev IS NOT NULL AND state <> prev AND prev || '>' || state NOT IN {_LEGAL}
 UNION ALL SELECT task_id, seq, 'task.scope_drift' FROM o WHERE f <> fingerprint AND state <> 'submitted'""")
ORACLE["stream_peer_risk"] = ORACLE["peer_risk"]
ORACLE["stream_quarantine"] = "SELECT msg_id, tool, quarantine_rule FROM (" + ORACLE["apply_quarantine"].replace("INTERVAL 2 HOUR", "INTERVAL 24 HOUR") + ")"

# ---- the whole decision of a peer-protocol message -------------------------------------------

_A2A_BODY = "SELECT rpc.msg_id, CASE coalesce(md, 0)"
_A2A_CTES, _ = ORACLE["evaluate_a2a"].split(_A2A_BODY)
_UNNESTED = f"unnest(CASE WHEN coalesce(octet_length(b), 0) = 0 THEN [] WHEN octet_length(b) <= 24 THEN [left(sha256(b), 32)] ELSE {_SHIFTS} END) AS fp"
ORACLE["evaluate_a2a_full"] = _A2A_CTES.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f""",
tf AS (SELECT agent_run_id, ts - 1 AS at, {_UNNESTED} FROM (SELECT *, {_STRIPPED} AS b FROM rpc WHERE role = 'user' AND turn % 4 = 2)),
df AS (SELECT msg_id, agent_run_id, ts, {_UNNESTED} FROM (SELECT *, {_STRIPPED} AS b FROM rpc WHERE role <> 'assistant' AND conv_id % 5 <> 4 AND octet_length(encode(text)) >= 16)),
leak AS (SELECT DISTINCT df.msg_id FROM df JOIN tf ON tf.agent_run_id = df.agent_run_id AND tf.fp = df.fp AND tf.at < df.ts),
d AS (SELECT rm.msg_id, rm.ts, 'peer-' || rm.conv_id % 5 AS peer,
 CASE WHEN leak.msg_id IS NOT NULL OR m = 'notifications/message' THEN 'block' WHEN m = 'tasks/send' THEN 'warn' WHEN md = 2 THEN 'block' WHEN md = 1 THEN 'warn' ELSE 'allow' END AS action,
 CASE WHEN leak.msg_id IS NOT NULL THEN 3 ELSE greatest(coalesce(sev, 0), CASE WHEN dr.msg_id IS NULL THEN 0 ELSE 3 END) END AS sev,
 nullif(concat_ws('|', ids, CASE WHEN m IN ('tasks/send', 'notifications/message') THEN 'policy.match' END, CASE WHEN dr.msg_id IS NOT NULL THEN 'task.scope_drift' END,
  CASE WHEN leak.msg_id IS NOT NULL THEN 'taint.cross_protocol_leak' END), '') AS ids FROM rm LEFT JOIN h USING (msg_id) LEFT JOIN dr ON dr.msg_id = rm.msg_id LEFT JOIN leak ON leak.msg_id = rm.msg_id),
o2 AS (SELECT *, (CASE sev WHEN 4 THEN 5.0 WHEN 3 THEN 2.5 WHEN 2 THEN 1.0 WHEN 1 THEN 0.25 ELSE 0.0 END + CASE action WHEN 'block' THEN 4.0 ELSE 0.0 END)::double AS w,
 row_number() OVER (PARTITION BY peer ORDER BY ts) AS rn FROM d),
r2 AS (SELECT msg_id, peer, ts, rn, w, w AS score FROM o2 WHERE rn = 1 UNION ALL
 SELECT o2.msg_id, o2.peer, o2.ts, o2.rn, o2.w, r2.score * greatest(0.0, 1 - 0.5 * (o2.ts - r2.ts) / 3600.0::double) + o2.w FROM r2 JOIN o2 ON o2.peer = r2.peer AND o2.rn = r2.rn + 1)
SELECT d.msg_id, d.action, CASE d.sev WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'info' END AS severity,
 concat_ws('|', d.ids, CASE WHEN r2.score >= 10 AND r2.score - r2.w < 10 THEN 'counterparty.risk_threshold' END) AS rule_ids FROM d JOIN r2 ON r2.msg_id = d.msg_id"""
ORACLE["rollup_report"] = _with(_LEDGER, f"""SELECT tenant_id, count(*) AS total, count(*) FILTER (action = 'allow') AS allowed, count(*) FILTER (action = 'warn') AS warned,
 count(*) FILTER (action = 'block') AS blocked, cast(sum(n_findings) AS bigint) AS findings FROM ledger_v
 WHERE epoch_us(ts) // 3600000000 * 3600000000 >= epoch_us({_NOW}) - 864000000000 GROUP BY tenant_id""")
ORACLE = {k: v for k, v in ORACLE.items() if v}
