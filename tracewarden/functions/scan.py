"""One Arrow pass over text views: Unicode normalization, literal search and a first look for patterns.

The JVM has neither NFKC nor a multi-literal search, and its regexes backtrack. All three are done here on
Arrow batches: a pattern is tried with RE2 on views that hold a literal it needs, or on all views when it needs none,
and the regexes (which stay on the JVM and say what matched) run only on views where RE2 found theirs.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BITS = 62

try:
    import ahocorasick
except ImportError:  # pragma: no cover - the plain search below gives the same answer
    ahocorasick = None


#: patterns that one pass looks for together; a set too long for RE2's automaton would be searched slowly
GROUP = 8


@lru_cache(maxsize=65536)
def re2_check(pattern: str, ignore_case: bool) -> str | None:
    """The pattern as RE2 takes it, to test whole batches with; None when it does not compile."""
    check = f"(?i:{pattern})" if ignore_case else f"(?:{pattern})"
    try:
        pc.match_substring_regex(pa.array([""]), check)
    except pa.ArrowInvalid:
        return None
    return check


def _matching(texts: pa.Array, rows: list[int], check: str) -> list[int]:
    """Those of ``rows`` whose text the pattern matches."""
    whole = len(rows) == len(texts)
    hit = pc.match_substring_regex(texts if whole else texts.take(pa.array(rows, pa.int64())), check)
    return [rows[k] for k in pc.indices_nonzero(hit).to_pylist()]


def _matching_any(texts: pa.Array, checks: list[tuple[int, str]]) -> list[tuple[int, list[int]]]:
    """(slot, rows) of patterns searched for in every text: groups first, then their members where a group matched."""
    out = []
    for k in range(0, len(checks), GROUP):
        group = checks[k:k + GROUP]
        rows = list(range(len(texts)))
        if len(group) > 1 and re2_check("|".join(c for _, c in group), False):
            rows = _matching(texts, rows, "|".join(c for _, c in group))
        out += [(slot, _matching(texts, rows, check)) for slot, check in group if rows]
    return out


def scan_views(views: Column, exact: dict[int, list[str]], folded: dict[int, list[str]], checks: dict[int, tuple[str, bool]],
               slots: int) -> Column:
    """array<struct<nfkc, seen>> for an array of strings.

    ``exact`` and ``folded`` map a guard slot to its literals (case-sensitive, lower-cased), ``checks`` to a pattern in RE2's form and whether
    it looks at the text as it stands; ``seen`` packs the slots whose literal and pattern are in the normalized text into 62-bit words.
    """
    n_words = max(1, -(-slots // WORD_BITS))

    def pack(found: list[int]) -> list[int]:
        words = [0] * n_words
        for slot in found:
            words[slot // WORD_BITS] |= 1 << (slot % WORD_BITS)
        return words

    return _scan(views, exact, folded, checks, pack, "seen", pa.int64(), "bigint")


def scan_slots(views: Column, exact: dict[int, list[str]], folded: dict[int, list[str]], checks: dict[int, tuple[str, bool]]) -> Column:
    """As ``scan_views``, with the slots found as a sorted list: the number of slots does not matter."""
    return _scan(views, exact, folded, checks, sorted, "slots", pa.int32(), "int")


def _scan(views: Column, exact: dict[int, list[str]], folded: dict[int, list[str]], checks: dict[int, tuple[str, bool]],
          summary: Callable[[list[int]], list[int]], name: str, kind: pa.DataType, ddl: str) -> Column:
    """array<struct<nfkc, name: array<ddl>>>: NFKC where it differs, and ``summary`` of the slots found."""
    # the check decides on the case, so that one search of the lower-cased text serves; only ASCII lowers letter by letter
    lowered = {slot for slot, words in exact.items() if slot in checks and all(w.isascii() for w in words)}
    exact_words = _inverted({slot: words for slot, words in exact.items() if slot not in lowered})
    folded_words = _inverted(folded | {slot: [w.lower() for w in exact[slot]] for slot in lowered})
    unguarded = [(slot, check, raw) for slot, (check, raw) in sorted(checks.items()) if slot not in exact and slot not in folded]

    @F.arrow_udf(f"array<struct<nfkc:string,{name}:array<{ddl}>>>")
    def scan(column: pa.Array) -> pa.Array:
        raw = column.flatten()
        nfkc, norms = [], []
        asked: dict[int, list[int]] = {}
        exactly, folding = _lister(exact_words), _lister(folded_words)
        for row, text in enumerate(raw.to_pylist()):
            norm = text = text or ""
            changed = None
            if not text.isascii():
                if not unicodedata.is_normalized("NFKC", text):
                    norm = changed = unicodedata.normalize("NFKC", text)
                norm = _strip(norm)
            nfkc.append(changed)
            norms.append(norm)
            for slot in exactly(norm) | folding(norm.lower()):
                asked.setdefault(slot, []).append(row)
        texts = pa.array(norms, pa.large_string())
        for slot, rows in asked.items():
            if slot in checks:
                asked[slot] = _matching(texts, rows, checks[slot][0])
        for over, of_raw in ((texts, False), (raw, True)):
            asked.update(_matching_any(over, [(slot, check) for slot, check, x in unguarded if x == of_raw]))
        found: list[list[int]] = [[] for _ in norms]
        for slot, rows in asked.items():
            for row in rows:
                found[row].append(slot)
        inner = pa.StructArray.from_arrays(
            [pa.array(nfkc, pa.string()), pa.array([summary(x) for x in found], pa.list_(kind))], names=["nfkc", name])
        lengths = [0 if n is None else n for n in column.value_lengths().to_pylist()]
        offsets = [0]
        for n in lengths:
            offsets.append(offsets[-1] + n)
        return pa.ListArray.from_arrays(
            pa.array(offsets, pa.int32()), inner, mask=column.is_null() if column.null_count else None)

    # marked non-deterministic so that Catalyst neither copies it into pushed-down filters nor repeats it
    return scan.asNondeterministic()(F.transform(views, F.make_valid_utf8))


@lru_cache(maxsize=8)
def _lister(words: tuple[tuple[str, tuple[int, ...]], ...]):
    """Function from a text to the set of slots of all words in it."""
    if not words:
        return lambda text: set()
    if ahocorasick is None:
        return lambda text: {slot for word, slots in words if word in text for slot in slots}
    automaton = ahocorasick.Automaton()
    for word, slots in words:
        automaton.add_word(word, slots)
    automaton.make_automaton()
    return lambda text: set().union(*{slots for _, slots in automaton.iter(text)})


def _inverted(literals: dict[int, list[str]]) -> tuple[tuple[str, tuple[int, ...]], ...]:
    """Index from a literal to the slots that need it (any of a slot's literals will do)."""
    index: dict[str, list[int]] = {}
    for slot, words in literals.items():
        for word in words:
            index.setdefault(word, []).append(slot)
    return tuple((word, tuple(slots)) for word, slots in sorted(index.items()))


@lru_cache(maxsize=1)
def _invisible() -> re.Pattern:
    """Code points that the JVM-side strip drops, as one class."""
    codes = [code for code in range(128, sys.maxunicode + 1)
             if 0xFE00 <= code <= 0xFE0F or 0xE0000 <= code <= 0xE007F or 0xE0100 <= code <= 0xE01EF
             or unicodedata.category(chr(code)) in ("Cf", "Cs")]
    ends = [(a, b) for a, b in zip(codes, codes[1:] + [None]) if b != a + 1]
    starts = [codes[0]] + [b for _, b in ends[:-1]]
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, (b, _) in zip(starts, ends)) + "]+")


def _strip(text: str) -> str:
    """Drop code points that are invisible, as the JVM-side strip does, before literals are looked for."""
    return _invisible().sub("", text)


def seen_slot(seen: str, slot: int) -> str:
    """SQL test of a guard slot in a ``seen`` expression."""
    return f"({seen}[{slot // WORD_BITS}] & {1 << (slot % WORD_BITS)}L) != 0"
