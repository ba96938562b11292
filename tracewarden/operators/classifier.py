"""Feature-density classifier for injection-shaped text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.ranks import as_col, computed_once
from tracewarden.functions.text import truncate_bytes

THRESHOLD = 0.45
MIN_LENGTH = 24
CONTRIBUTES = 0.15
#: bytes of the text that a finding quotes; None quotes it whole
MATCH_BYTES: int | None = None

# The word and phrase lists the scores are defined by.
ROLE_MARKERS = [
    "<system>", "<admin>", "<developer>", "<root>", "<assistant>", "<user>", "<tool>",
    "[system]", "[admin]", "[developer]", "[[system]]", "[[admin]]", "[[assistant]]",
]
ROLE_PHRASES = ["as the assistant", "as the system", "i am the assistant", "i am the system"]
CONTROL_WORDS = ["ignore", "override", "now", "must", "always", "never"]
OVERRIDE_VERBS = ["ignore", "disregard", "forget", "override", "bypass", "circumvent"]
CONTEXT_NOUNS = [
    "previous", "prior", "above", "earlier", "preceding", "old", "instructions", "instruction", "rules", "rule",
    "directives", "prompts", "prompt", "messages", "message", "everything", "whatever", "anything", "context",
    "safety", "guardrails", "guardrail", "filters", "filter", "restrictions", "restriction", "policies", "policy",
]
PROMPT_PHRASES = ["system prompt", "initial prompt", "hidden prompt"]
NEW_ROLE_PHRASES = [
    "you are now ", "you are no longer ", "from now on you ", "starting now you ", "act as ", "behave like ",
    "pretend to be ", "role: ", "switch role to ", "role-play exercise", "role-play as", "roleplay as",
    "roleplay exercise", "role play exercise", "role play as", "you are an unbounded ", "you are an unrestricted ",
    "you are a different ", "you are a new ",
]
LAPSED_PHRASES = ["no longer apply", "no longer applies"]
TIME_PHRASES = ["starting now", "from now on", "going forward"]
AUTHORITY_PHRASES = ["authorised by your", "authorized by your"]
PRINCIPALS = ["developer", "admin", "system"]
EXFIL_PHRASES = [
    "send the ", "send all ", "post the ", "post all ", "upload the ", "upload all ", "share the ", "exfiltrate ",
    "leak the ", "leak all ", "transmit the ", "fetch https://",
]
URL_MARKS = ["http://", "https://"]
SENSITIVE_NOUNS = ["context", "messages", "history", "secret", "conversation", "credentials", "token"]
EXTRACTION_VERBS = ["reveal", "print", "show", "output", "return", "repeat", "leak", "expose", "dump", "disclose"]
EXTRACTION_QUALIFIERS = ["system", "initial", "hidden", "original", "secret", "internal"]
EXTRACTION_OBJECTS = [
    "prompt", "message", "instructions", "rules", "rule", "directive", "directives", "configuration", "config",
    "told", "said", "given", "configured",
]
EXACTNESS_WORDS = ["verbatim", "exact", "in full"]
TOLD_PHRASES = ["everything you were", "anything you were", "what you were"]
IMPERATIVES = [
    "ignore", "disregard", "forget", "override", "bypass", "circumvent", "reveal", "show", "print", "output",
    "return", "repeat", "send", "post", "upload", "exfiltrate", "leak", "transmit", "act", "pretend", "behave",
    "roleplay",
]
NEARBY = 8
FEATURES = ("role_marker", "override_imperative", "new_role", "exfil_imperative", "extraction_imperative",
            "imperative_density", "length_anomaly")


def _any(text: Column, phrases: list[str], stems: tuple[str, ...] = ()) -> Column:
    """Whether any phrase is in the text; those that share a stem are looked for only where the stem is."""
    groups: dict[str, list[str]] = {}
    for phrase in phrases:
        stem = next((x for x in stems if x in phrase), phrase)
        groups.setdefault(stem, []).append(phrase)
    out = None
    for stem, members in groups.items():
        hit = text.contains(stem)
        if members != [stem]:
            hit = hit & _any(text, members)
        out = hit if out is None else out | hit
    return out


def _clamp(score: Column) -> Column:
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def tokens_of(lower: Column) -> Column:
    """Runs of letters and digits."""
    return F.filter(F.split(lower, r"[^\p{L}\p{Nd}]+"), lambda t: t != "")


def padded(tokens: Column) -> Column:
    """Tokens as one text with single spaces around each; word windows become plain regexes."""
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


def role_marker(lower: Column) -> Column:
    # inside each branch, so that markers and phrases are not looked for once more to know whether there was one
    bonus = F.when(_any(lower, CONTROL_WORDS), 0.05).otherwise(0.0)
    return _clamp(
        F.when(_any(lower, ROLE_MARKERS, ("<", "[")), F.lit(0.95) + bonus)
        .when(_any(lower, ROLE_PHRASES, (" the assistant", " the system")), F.lit(0.55) + bonus).otherwise(0.0))


def override_imperative(lower: Column, words: Column, n: Column) -> Column:
    nouns = "|".join(CONTEXT_NOUNS)
    gap = rf"(?:\S+ ){{0,{NEARBY - 1}}}"
    hits = None
    for verb in OVERRIDE_VERBS:
        near = words.rlike(rf" {verb} {gap}(?:{nouns}) | (?:{nouns}) {gap}{verb} ")
        one = F.when(words.contains(f" {verb} ") & near, 1).otherwise(0)
        hits = one if hits is None else hits + one
    score = hits * 0.35 + F.when(n < 30, 0.2).otherwise(0.0) + F.when(_any(lower, PROMPT_PHRASES), 0.25).otherwise(0.0)
    return F.when(hits == 0, 0.0).otherwise(_clamp(score))


def new_role(lower: Column) -> Column:
    return (
        F.when(_any(lower, NEW_ROLE_PHRASES, ("you are ", "role")), 0.7)
        .when(_any(lower, LAPSED_PHRASES) & _any(lower, TIME_PHRASES), 0.75)
        .when(_any(lower, AUTHORITY_PHRASES) & _any(lower, PRINCIPALS), 0.7)
        .otherwise(0.0)
    )


def exfil_imperative(lower: Column) -> Column:
    hits = None
    for phrase in EXFIL_PHRASES:
        one = F.when(lower.contains(phrase), 1).otherwise(0)
        hits = one if hits is None else hits + one
    url, noun = _any(lower, URL_MARKS), _any(lower, SENSITIVE_NOUNS)
    score = hits * 0.45 + F.when(url, 0.25).otherwise(0.0) + F.when(noun, 0.2).otherwise(0.0)
    return F.when((hits == 0) | ~(url | noun), 0.0).otherwise(_clamp(score))


def extraction_imperative(lower: Column, tokens: Column) -> Column:
    verb = F.arrays_overlap(tokens, F.array(*[F.lit(v) for v in EXTRACTION_VERBS]))
    named = _any(lower, EXTRACTION_QUALIFIERS) & _any(lower, EXTRACTION_OBJECTS)
    return (
        F.when(~verb, 0.0)
        .when(named & _any(lower, EXACTNESS_WORDS), 0.85)
        .when(named, 0.65)
        .when(_any(lower, TOLD_PHRASES), 0.6)
        .otherwise(0.0)
    )


def imperative_density(tokens: Column, n: Column) -> Column:
    used = F.filter(tokens, lambda t: t.isin(*IMPERATIVES))
    density = F.size(used) / n
    return (
        F.when((n < 8) | (F.size(F.array_distinct(used)) < 2), 0.0)
        .when(density >= 0.10, 0.8).when(density >= 0.06, 0.6).when(density >= 0.03, 0.4)
        .when(density >= 0.015, 0.2).otherwise(0.05)
    )


def length_anomaly(value: Column) -> Column:
    return F.when(F.octet_length(value) > 4000, 0.4).when(F.octet_length(value) > 1500, 0.2).otherwise(0.0)


def _prepared(value: Column) -> Column:
    """One struct holding what several features share, so it is computed once per value."""
    first = F.transform(F.array(F.struct(value.alias("value"), F.lower(value).alias("lower"))), lambda s: F.struct(
        s["value"].alias("value"), s["lower"].alias("lower"), tokens_of(s["lower"]).alias("tokens")))
    return F.transform(first, lambda s: F.struct(
        s["value"].alias("value"), s["lower"].alias("lower"), s["tokens"].alias("tokens"),
        padded(s["tokens"]).alias("words"), F.size(s["tokens"]).alias("n")))


def _scores(s: Column) -> Column:
    parts = {
        "role_marker": role_marker(s["lower"]),
        "override_imperative": override_imperative(s["lower"], s["words"], s["n"]),
        "new_role": new_role(s["lower"]),
        "exfil_imperative": exfil_imperative(s["lower"]),
        "extraction_imperative": extraction_imperative(s["lower"], s["tokens"]),
        "imperative_density": imperative_density(s["tokens"], s["n"]),
        "length_anomaly": length_anomaly(s["value"]),
    }
    empty = s["n"] == 0
    return F.struct(*[F.when(empty, 0.0).otherwise(c).cast("double").alias(name) for name, c in parts.items()])


def classifier_features(value: Column | str) -> Column:
    """struct of the seven feature scores of a text."""
    return F.get(F.transform(_prepared(as_col(value)), _scores), F.lit(0))


def noisy_or(scores: Column) -> Column:
    product = F.lit(1.0)
    for name in FEATURES:
        product = product * (1.0 - scores[name])
    return F.least(1.0 - product, F.lit(1.0))


def contributors(scores: Column) -> Column:
    """Names of the features that matter, in alphabetical order."""
    return F.array_compact(F.array(*[
        F.when(scores[name] >= CONTRIBUTES, F.lit(name)) for name in sorted(FEATURES)]))


def severity_of_score(score: Column) -> Column:
    return (F.when(score >= 0.85, "critical").when(score >= 0.65, "high").when(score >= 0.5, "medium")
            .otherwise("low"))


def classify_fields(messages: DataFrame, threshold: float = THRESHOLD, min_len: int = MIN_LENGTH,
                    mode: str = "warn", out: str = "classifier_findings") -> DataFrame:
    """Add an array with one finding per field that scores at or above the threshold."""
    long_enough = F.filter("fields", lambda f: F.octet_length(f["value"]) >= min_len)
    scored = F.transform(long_enough, lambda f: F.struct(
        f["name"].alias("name"), f["value"].alias("value"), classifier_features(f["value"]).alias("s")))
    totals = F.transform(scored, lambda x: F.struct(
        x["name"].alias("name"), x["value"].alias("value"), x["s"].alias("s"), noisy_or(x["s"]).alias("score")))
    hits = F.filter(totals, lambda x: x["score"] >= threshold)
    findings = F.transform(hits, lambda x: F.struct(
        F.lit("heuristic.injection_density").alias("rule_id"),
        F.lit("prompt-injection").alias("category"),
        severity_of_score(x["score"]).alias("severity"),
        F.lit("feature-density classifier flagged injection-shaped content").alias("description"),
        truncate_bytes(x["value"], MATCH_BYTES).alias("match"),
        x["name"].alias("field"),
        x["score"].alias("confidence"),
        F.create_map(
            F.lit("score"), x["score"].cast("string"),
            F.lit("contributors"), F.array_join(contributors(x["s"]), ","),
            F.lit("mode"), F.lit(mode)).alias("metadata")))
    return messages.withColumn(out, computed_once(findings))


def classify(messages: DataFrame, threshold: float = THRESHOLD, min_len: int = MIN_LENGTH,
             mode: str = "warn") -> DataFrame:
    """One row per classifier finding."""
    from tracewarden.operators.rules import explode_findings

    return explode_findings(classify_fields(messages, threshold, min_len, mode), "classifier_findings", "msg_id")
