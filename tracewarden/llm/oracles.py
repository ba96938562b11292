"""SQL twins (DuckDB) of the queries that SQL can express, written from the definitions and not from the operators."""

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATE_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({_LOW}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(coalesce({_LOW}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[i:i + 9] AS win, least(len(w), 10) AS n
        FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, i, n, w[i:i + n - 1] AS win
       FROM d, (SELECT DISTINCT n FROM win) AS s, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN win USING (win, n)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hit) AS h, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS varchar) AS item FROM hit) AS x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS bigint) AS n_words, CAST(coalesce(n_hit, 0) AS bigint) AS n_hit, CAST(coalesce(n_items, 0) AS bigint) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def _matches(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    # the pieces between matches are found by splitting at a mark that stands for each match
    return rf"""
SELECT doc_id, '{kind}' AS kind, {rank} AS rank, start, start + m AS "end" FROM (
  SELECT doc_id, m, t, sum(g + m) OVER (PARTITION BY doc_id ORDER BY i) - m AS start FROM (
    SELECT doc_id, i, length(string_split_regex(text, $p${pattern}$p$)[i]) AS g,
           length(regexp_extract_all(text, $p${pattern}$p$)[i]) AS m, length(regexp_extract_all(text, $p${pattern}$p$, {group})[i]) AS t
    FROM docs, unnest(range(1, len(regexp_extract_all(text, $p${pattern}$p$)) + 1)) AS u(i)) AS a) AS b
WHERE t >= {least}"""


_RULES = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("bearer", r"Bearer\x20+[A-Za-z0-9_.~+/-]{20,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
]
_SPAN = """string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank)"""
SECRETS_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(_matches(k, i, p, g, n) for i, (k, p, g, n) in enumerate(_RULES))}),
per AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
               count(*) FILTER (kind = 'hex') AS n_hex, {_SPAN} FILTER (rank < 3) AS base, {_SPAN} AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN per USING (doc_id)
"""

# The template's control strings; each grows by one backslash inside a text, and each backslash by one more
_CONTROL = ["<|turn|>", "<|says|>", "<|done|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
            "<|im_start|>", "<|im_end|>", "<|endoftext|>"]


def _escaped_length(x: str) -> str:
    count = lambda c: f"CAST((length({x}) - length(replace({x}, '{c}', ''))) / {len(c)} AS bigint)"
    return f"(length({x}) + " + " + ".join(count(c) for c in ["\\", *_CONTROL]) + ")"


CHAT_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, 0 AS place, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 0, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, place, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS bigint) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, place, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({len("<|turn|>") + len("<|says|>") + len("<|done|>")} + {_escaped_length("role")} + {_escaped_length("text")}) AS bigint) AS formatted_chars
FROM t GROUP BY conv_id
"""


def mixing_sql(weights: dict[str, int], part: float, epochs: int, seed: int) -> str:
    """Water filling level by level in exact integers, then prefix sums in the seeded order."""
    case = " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items())
    paths = ["domain", "domain || '/' || lang", "domain || '/' || lang || '/' || source"]
    keys = ["domain", "domain, lang", "domain, lang, source"]
    levels, before = [], ""
    for d in range(3):
        parent = f"JOIN s{d - 1} USING ({keys[d - 1]})" if d else ""
        budget = f"s{d - 1}.share" if d else "(SELECT b FROM total)"
        over = f"PARTITION BY {keys[d - 1]}" if d else ""
        levels.append(f"""
n{d} AS (SELECT {", ".join(f"l.{k}" for k in keys[d].split(", "))}, {paths[d].replace("domain", "l.domain").replace("lang", "l.lang").replace("source", "l.source")} AS name,
         CAST(sum(tokens) * {epochs} AS hugeint) AS cap, CAST(sum(tokens) AS hugeint) AS tokens FROM leaves AS l GROUP BY ALL),
w{d} AS (SELECT n{d}.*, CAST(CASE name {case} ELSE 1 END AS hugeint) AS weight, {budget} AS budget FROM n{d} {parent}),
o{d} AS (SELECT *, cap / weight AS ratio FROM w{d} WHERE weight > 0),
r{d} AS (SELECT *, least(budget, sum(cap) OVER ({over})) - coalesce(sum(cap) OVER ({over} ORDER BY ratio, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
         sum(weight) OVER ({over} ORDER BY ratio DESC, name DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS wgt FROM o{d}),
f{d} AS (SELECT *, max(CASE WHEN cap * wgt <= lft * weight THEN 0 ELSE 1 END) OVER ({over} ORDER BY ratio, name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open FROM r{d}),
g{d} AS (SELECT *, max(CASE WHEN open = 1 THEN lft END) OVER ({over}) AS rest, max(CASE WHEN open = 1 THEN wgt END) OVER ({over}) AS all_w,
         coalesce(sum(CASE WHEN open = 1 THEN weight ELSE 0 END) OVER ({over} ORDER BY ratio, name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS upto FROM f{d}),
s{d} AS (SELECT {keys[d]}, tokens, CASE WHEN open = 0 THEN cap ELSE rest * upto // all_w - rest * (upto - weight) // all_w END AS share FROM g{d}),""")
    return rf"""
WITH docs AS (
  SELECT doc_id, md5(coalesce(text, '')) AS th, CASE WHEN regexp_extract(source, '([0-9]+)$', 1) = '' THEN 'other'
         ELSE 'domain' || (CAST(regexp_extract(source, '([0-9]+)$', 1) AS int) % 4) END AS domain,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens
  FROM documents),
worded AS (SELECT * FROM docs WHERE n_tokens > 0),
every AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM worded GROUP BY ALL),
total AS (SELECT CAST(floor(CAST(sum(tokens) AS double) * {part}) AS hugeint) AS b FROM every),
leaves AS (SELECT * FROM every WHERE {" AND ".join(f"(CASE {p} {case} ELSE 1 END) > 0" for p in paths)}),
{"".join(levels)}
e AS (SELECT worded.*, CAST(share // tokens AS bigint) AS whole, CAST(share % tokens AS bigint) AS part FROM worded JOIN s2 USING (domain, lang, source)),
p AS (SELECT *, part - coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{seed}:' || whole || ':' || coalesce(CAST(doc_id AS varchar), '')), th
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM e),
mixed AS (SELECT doc_id, domain, lang, source, epoch, n_tokens, n_tokens AS take FROM p, unnest(range(whole)) AS t(epoch)
          UNION ALL SELECT doc_id, domain, lang, source, whole, n_tokens, least(n_tokens, room) FROM p WHERE room > 0)
SELECT doc_id, domain, lang, source, CAST(epoch AS bigint) AS epoch, CAST(n_tokens AS bigint) AS n_tokens, CAST(take AS bigint) AS take FROM mixed
"""

PASSAGES_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, w[i:i + 12] AS s FROM d, unnest(range(1, len(w) - 11)) AS t(i) WHERE len(w) >= 13),
gone AS (SELECT DISTINCT doc_id, p FROM win JOIN (SELECT s, min(doc_id) AS m FROM win GROUP BY s) AS x USING (s), unnest(range(i, i + 13)) AS t(p) WHERE m < doc_id),
kept AS (SELECT doc_id, count(*) AS n, string_agg(w[p], ' ' ORDER BY p) AS k FROM (
  SELECT doc_id, w, p FROM d, unnest(range(1, len(w) + 1)) AS t(p)) AS a ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS bigint) AS n_words, CAST(len(w) - coalesce(n, 0) AS bigint) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

NEGATIVES_SQL = """
WITH fine AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS double)) AS bigint)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike,
             CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 0) AS bigint) AS score
      FROM fine AS a, fine AS b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS int) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""
