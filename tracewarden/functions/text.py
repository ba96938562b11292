"""Text views: Unicode normalization, base64 candidates, byte cuts, byte shingles."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tracewarden.functions.ranks import as_col

# Code points dropped before matching. Category Cf already holds the
# zero-width, bidi and tag characters; variation selectors are category Mn.
INVISIBLE = r"[\p{Cf}\p{Cs}\x{FE00}-\x{FE0F}\x{E0000}-\x{E007F}\x{E0100}-\x{E01EF}]"

# Characters on which NFKC and the strip are both the identity, even side by side:
# ASCII, precomposed Latin-1 letters, basic Cyrillic, unified CJK, plain quotes and dashes.
UNSTABLE = (
    r"(?=[^\x{0}-\x{7F}])[^\x{0}-\x{7F}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}\x{410}-\x{44F}"
    r"\x{4E00}-\x{9FFF}\x{2013}\x{2014}\x{2018}\x{2019}\x{201C}\x{201D}]"
)

# Least length of a base64 run and width of a shingle, in bytes.
B64_MIN = 24
SHINGLE_WIDTH = 24


def _nfkc(value):
    return None if value is None else unicodedata.normalize("NFKC", value)


@F.pandas_udf(StringType())
def nfkc_udf(values: pd.Series) -> pd.Series:
    return values.map(_nfkc)


@F.pandas_udf(ArrayType(StringType()))
def nfkc_array_udf(values: pd.Series) -> pd.Series:
    return values.map(lambda row: None if row is None else [_nfkc(v) for v in row])


def needs_normalizing(c: Column | str) -> Column:
    c = as_col(c)
    return (F.octet_length(c) > F.length(c)) & c.rlike(UNSTABLE)


def strip_invisible(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), INVISIBLE, "")


def normalize_text(c: Column | str) -> Column:
    """NFKC, then drop invisible code points. Only rows that can change reach Python."""
    c = as_col(c)
    return F.coalesce(strip_invisible(nfkc_udf(F.when(needs_normalizing(c), c))), c)


def normalize_array(c: Column | str) -> Column:
    """``normalize_text`` over an array of strings, one Arrow value per row that needs it."""
    c = as_col(c)
    # binding the array to a lambda variable keeps it from being computed for the test and again for its use
    asked = F.get(F.transform(F.array(c), lambda x: F.when(F.exists(x, needs_normalizing), F.transform(x, F.make_valid_utf8))), F.lit(0))
    return F.coalesce(F.transform(nfkc_array_udf(asked), strip_invisible), c)


def truncate_bytes(c: Column | str, n: int | None) -> Column:
    """First ``n`` bytes and an ellipsis; a cut inside a character moves back to its start. ``None`` cuts nothing."""
    c = as_col(c)
    if n is None:
        return c
    raw = F.encode(c, "UTF-8")
    head = F.substring(raw, 1, n).cast("string")
    mid_char = F.hex(F.substring(raw, n + 1, 1)).rlike("^[89AB]")
    cut = F.when(mid_char, F.regexp_replace(F.make_valid_utf8(head), r"\x{FFFD}+\z", "")).otherwise(head)
    return F.when(F.octet_length(c) > n, F.concat(cut, F.lit("…"))).otherwise(c)


def _mostly_printable(c: Column) -> Column:
    """Printable characters, counting each undecodable byte as one, are at least 80 % of the bytes."""
    # all of these are printable and take one byte each, so that one look settles what most payloads are
    plain = ~c.rlike(r"[^ -~\n\t\r]")
    valid = F.regexp_replace(F.make_valid_utf8(c), r"\x{FFFD}", "")
    shown = F.length(F.regexp_replace(valid, r"[^\p{L}\p{M}\p{N}\p{P}\p{S} \n\t\r]", ""))
    undecodable = F.octet_length(c) - F.octet_length(valid)
    return (F.octet_length(c) > 0) & F.when(plain, True).otherwise((shown + undecodable) * 5 >= F.octet_length(c) * 4)


# Padded and unpadded forms of the standard and the URL alphabet.
_STD, _URL = r"[A-Za-z0-9+/]", r"[A-Za-z0-9_-]"
BASE64_LEGAL = "|".join(
    f"^(?:{x}{{4}})*+(?:{x}{{2}}==|{x}{{3}}=|{x}{{2}}|{x}{{3}})?\\z" for x in (_STD, _URL))


def base64_runs(c: Column | str, longest: int | None = None) -> Column:
    """Maximal runs of base64 characters, 24 bytes or longer, that some alphabet can decode."""
    c = as_col(c)
    runs = F.regexp_extract_all(c, F.lit("([A-Za-z0-9+/=_-]+)"), F.lit(1))
    return F.when(
        c.rlike(f"[A-Za-z0-9+/=_-]{{{B64_MIN}}}"),
        F.filter(runs, lambda r: (F.length(r) >= B64_MIN) & (F.lit(True) if longest is None else F.length(r) <= longest) & r.rlike(BASE64_LEGAL)),
    ).otherwise(F.array().cast("array<string>"))


def decode_base64(run: Column) -> Column:
    """Bytes of a legal run as a string (bytes are kept as they are, valid UTF-8 or not)."""
    padding = F.substring(F.lit("==="), F.lit(1), ((F.lit(4) - F.length(run) % 4) % 4).cast("int"))
    # translating goes letter by letter, and most runs have nothing to translate
    standard = F.when(run.contains("-") | run.contains("_"), F.translate(run, "-_", "+/")).otherwise(run)
    return F.unbase64(F.concat(standard, padding)).cast("string")


def base64_candidates(c: Column | str, longest: int | None = None) -> Column:
    """Decoded text of every base64-looking run, kept when mostly printable."""
    return F.filter(F.transform(base64_runs(c, longest), decode_base64), _mostly_printable)


def trim_space(c: Column) -> Column:
    """Drop leading and trailing Unicode white space."""
    # both ends are looked at first: the whole text is searched only where there is something to drop
    blank = r"[\s\x{85}\p{Z}]"
    ends = F.left(c, F.lit(1)).rlike(f"^{blank}") | F.right(c, F.lit(3)).rlike(f"{blank}\\z")
    return F.when(ends, F.regexp_replace(c, f"^{blank}+|{blank}+\\z", "")).otherwise(c)


def byte_windows(c: Column | str, width: int = SHINGLE_WIDTH) -> Column:
    """Distinct ``width``-byte windows of a trimmed string; short strings give themselves.

    Windows are byte strings (they may cut a character): as strings they are hashed in linear
    time by ``array_distinct``, which falls back to pairwise comparison on binary values.
    """
    def windows(b: Column) -> Column:
        n = F.octet_length(b)
        return (
            F.when(n == 0, F.array().cast("array<string>"))
            .when(n <= width, F.array(b.cast("string")))
            .otherwise(F.array_distinct(F.transform(
                F.sequence(F.lit(1), n - width + 1), lambda i: F.substring(b, i, width).cast("string"))))
        )

    # binding the bytes to a lambda variable keeps them from being computed once per window
    return F.get(F.transform(F.array(F.encode(trim_space(as_col(c)), "UTF-8")), windows), F.lit(0))


def plain_views(value: Column | str) -> Column:
    """The value and its base64 payloads, as they stand."""
    value = as_col(value)
    return F.concat(F.array(value), base64_candidates(value))


def canonical_views(value: Column | str) -> Column:
    """The normalized value and its normalized base64 payloads."""
    return normalize_array(plain_views(value))


def fingerprint(window: Column) -> Column:
    return F.left(F.sha2(window, 256), F.lit(32))


def byte_fingerprints(c: Column | str, width: int = SHINGLE_WIDTH) -> Column:
    """Fingerprints of the ``byte_windows`` of a string, one per place: repeated windows repeat theirs."""
    def prints(b: Column) -> Column:
        n = F.octet_length(b)
        return (
            F.when(n == 0, F.array().cast("array<string>"))
            .when(n <= width, F.array(fingerprint(b)))
            .otherwise(F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: fingerprint(F.substring(b, i, width))))
        )

    return F.get(F.transform(F.array(F.encode(trim_space(as_col(c)), "UTF-8")), prints), F.lit(0))


def shingles(value: Column | str, width: int = SHINGLE_WIDTH) -> Column:
    """Distinct 128-bit hex fingerprints over all canonical views of a value."""
    return F.array_distinct(F.flatten(F.transform(canonical_views(value), lambda v: byte_fingerprints(v, width))))
