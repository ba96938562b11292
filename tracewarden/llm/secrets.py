"""Secret scans with an incremental ledger of blobs.

Every version of a text is addressed by its content. The ledger holds the pairs (blob, rule version) that were scanned
and what was found; a run scans the pairs it lacks and joins findings back to all paths that hold the blob.

Defined results. A null text is an empty text; texts without findings have an empty list. Repeated rows and copies
share one blob and come out once per input row. Columns other than path and text are not read. Matches of one kind do not
overlap; spans of different kinds may.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SPAN = "array<struct<kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """``least`` is the least length of group ``group``; shorter matches are dropped after matching."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    #: a cheap test that every match passes
    needs: str = ""


# The base rules, in the order of their kinds
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    Rule("hex", r"[0-9a-f]{24,}"),  # the runs of [0-9a-f]+ with 24 characters or more
)
#: what the ledger's rule set adds to them
MORE_RULES = (
    Rule("bearer", r"Bearer\x20+[A-Za-z0-9_.~+/-]{20,}", needs="Bearer"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needs="eyJ"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", needs="-----BEGIN "),
)
RULES = BASE_RULES + MORE_RULES


def rule_version(rules: tuple[Rule, ...]) -> str:
    """Names a rule set by its content, so that changed rules are unseen rules."""
    import hashlib

    return hashlib.sha256("\n".join(f"{r.kind}\t{r.pattern}\t{r.group}\t{r.least}" for r in rules).encode()).hexdigest()[:16]


def rule_spans(text: Column, rule: Rule) -> Column:
    """The kept matches of one rule in code points: the pieces between matches say where each match begins."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    gaps = F.split(text, rule.pattern, -1)
    placed = F.aggregate(
        F.zip_with(F.slice(gaps, 1, F.size(found)), F.arrays_zip(found.alias("m"), tested.alias("t")),
                   lambda g, m: F.struct(F.char_length(g).alias("g"), F.char_length(m["m"]).alias("m"), F.char_length(m["t"]).alias("t"))),
        F.struct(F.lit(0).alias("at"), F.lit(None).cast(SPAN).alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["g"] + x["m"]).alias("at"),
            F.when(x["t"] >= rule.least, F.concat(
                F.coalesce(a["out"], F.array().cast(SPAN)),
                F.array(F.struct(F.lit(rule.kind).alias("kind"), (a["at"] + x["g"]).alias("start"),
                                 (a["at"] + x["g"] + x["m"]).alias("end"))))).otherwise(a["out"]).alias("out")),
        lambda a: F.coalesce(a["out"], F.array().cast(SPAN)))
    could = F.contains(text, F.lit(rule.needs)) if rule.needs else F.regexp_like(text, F.lit(rule.pattern))
    return F.when(could, placed).otherwise(F.array().cast(SPAN))


def all_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans of all rules by start, then by the order of the rules."""
    parts = F.concat(*[F.transform(rule_spans(text, r), lambda s, i=i: F.struct(
        s["start"].alias("start"), F.lit(i).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
        for i, r in enumerate(rules)])
    return F.transform(F.array_sort(parts), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def blob_id(text: Column) -> Column:
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, text: str = "text",
                rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, rules, spans): one per blob that the ledger lacks for this rule set."""
    version = rule_version(rules)
    blobs = versions.select(blob_id(F.col(text)).alias("blob"), F.coalesce(text, F.lit("")).alias("body"))
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rules") == version).select("blob").distinct(), "blob", "left_anti")
    return blobs.dropDuplicates(["blob"]).select(
        "blob", F.lit(version).alias("rules"), all_spans(F.col("body"), rules).alias("spans"))


def scan_versions(versions: DataFrame, path: str = "doc_id", text: str = "text", ledger: DataFrame | None = None,
                  rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(path, blob, spans) per input row, and the ledger with what this run added to it."""
    fresh = stored(scan_unseen(versions, ledger, text, rules), "blob-ledger")
    known = fresh if ledger is None else ledger.select(*fresh.columns).unionByName(fresh)
    mine = known.where((F.col("rules") == rule_version(rules)) & (F.size("spans") > 0)).select("blob", "spans")
    paths = versions.select(F.col(path).alias("path"), blob_id(F.col(text)).alias("blob"))
    return paths.join(mine, "blob", "left").select(
        "path", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans")), known


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch of overlapping or touching spans replaced by the mark."""
    done = F.aggregate(
        spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.struct(
            F.when((s["start"] >= a["at"]) & ((a["at"] == 0) | (s["start"] > a["at"])),
                   F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(a["out"]).alias("out"),
            F.greatest(a["at"], s["end"]).alias("at")))
    return F.when(F.size(spans) == 0, text).otherwise(
        F.concat(done["out"], F.substring(text, done["at"] + 1, F.char_length(text))))


def redact_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All documents, columns as they came, secrets in the text replaced."""
    _, ledger = scan_versions(docs, doc_id, text, None, rules)
    found = ledger.where(F.size("spans") > 0).select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans"))
    joined = docs.join(found, blob_id(docs[text]) == found["_blob"], "left")
    spans = F.coalesce(found["_spans"], F.array().cast(SPAN))
    clean = F.when(F.size(spans) == 0, docs[text]).otherwise(redacted(docs[text], spans))
    return joined.select(*[clean.alias(c) if c == text else docs[c] for c in docs.columns])
