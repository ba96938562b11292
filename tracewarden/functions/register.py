"""SQL names for the scalar functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tracewarden.functions import ranks, text
from tracewarden.functions.patterns import sql_string


def register_functions(spark: SparkSession) -> list[str]:
    """Register temporary functions: Catalyst expressions where SQL can say it, else Arrow functions.

    ``normalize_text(x)`` is the one-call form of ``strip_invisible(nfkc(x))``; ``shingles(x)`` are the fingerprints of one view's
    ``byte_windows(x)``. ``glob_match(glob, path)`` takes globs from columns; constant globs are compiled at plan time by
    ``patterns.glob_sql``.
    """
    def case(name: str, table: dict, kind: str, default: str, suffix: str = "") -> None:
        arms = " ".join(f"WHEN {sql_string(k)} THEN {v}{suffix}" for k, v in table.items())
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS {kind} RETURN CASE s {arms} ELSE {default} END")

    case("severity_rank", ranks.SEVERITY_RANK, "INT", "0")
    case("mode_rank", ranks.MODE_RANK, "INT", "0")
    case("severity_weight", ranks.SEVERITY_WEIGHT, "DOUBLE", "0D", "D")
    spark.udf.register("nfkc", text.nfkc_udf)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION strip_invisible(s STRING) RETURNS STRING "
              f"RETURN regexp_replace(s, {sql_string(text.INVISIBLE)}, '')")
    width = text.SHINGLE_WIDTH
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION byte_windows(s STRING) RETURNS ARRAY<STRING> RETURN "
        f"get(transform(array(encode(trim(s), 'UTF-8')), b -> CASE WHEN octet_length(b) = 0 THEN cast(array() AS ARRAY<STRING>) "
        f"WHEN octet_length(b) <= {width} THEN array(cast(b AS STRING)) ELSE array_distinct(transform("
        f"sequence(1, octet_length(b) - {width - 1}), i -> cast(substring(b, i, {width}) AS STRING))) END), 0)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION shingles(s STRING) RETURNS ARRAY<STRING> "
              "RETURN transform(byte_windows(s), w -> left(sha2(w, 256), 32))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION normalize_text(s STRING) RETURNS STRING RETURN strip_invisible(nfkc(s))")
    weights = " ".join(f"WHEN {sql_string(k)} THEN {v}D" for k, v in ranks.PEER_WEIGHT.items())
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION peer_weight(severity STRING, action STRING) RETURNS DOUBLE RETURN "
              f"CASE severity {weights} ELSE 0D END + CASE WHEN action = 'block' THEN {ranks.PEER_BLOCK_WEIGHT}D ELSE 0D END")
    legal = sql_string(text.BASE64_LEGAL)
    runs = f"filter(regexp_extract_all(s, '([A-Za-z0-9+/=_-]+)', 1), r -> length(r) >= {text.B64_MIN} AND r RLIKE {legal})"
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION base64_decoded(s STRING) RETURNS ARRAY<STRING> RETURN "
              f"transform({runs}, r -> cast(unbase64(concat(translate(r, '-_', '+/'), substring('===', 1, (4 - length(r) % 4) % 4))) AS STRING))")
    # a glob segment is one path segment as written, * any one, ** any number of them
    step = r"CASE g WHEN '**' THEN '(?:\\.[^.]*)*' WHEN '*' THEN '\\.[^.]*' ELSE concat('\\.', regexp_replace(g, '([^A-Za-z0-9_])', '\\\\$1')) END"
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION glob_match(glob STRING, path STRING) RETURNS BOOLEAN RETURN "
              f"concat('.', path) RLIKE concat('^', array_join(transform(split(glob, '\\\\.'), g -> {step}), ''), '$')")
    return ["severity_rank", "mode_rank", "severity_weight", "nfkc", "strip_invisible", "byte_windows", "shingles", "normalize_text",
            "peer_weight", "base64_decoded", "glob_match"]
