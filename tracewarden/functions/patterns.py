"""RE2-dialect patterns on Java's regex engine, path globs, and literal guards.

Rule packs are written for RE2. The rewrite below keeps RE2's answers on the JVM;
``required_literals`` finds substrings every match must contain, so that the costly
regex is tried only on texts that hold one of them.
"""

from __future__ import annotations

import re
from re import _constants as rc  # parse-tree opcodes of the standard library
from re import _parser as rp

_WORD_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
_NOT_WORD_EDGE = r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"
_SPACE = r"\t\n\f\r "

# A loose separator that makes a backtracking engine explode, and a possessive form that is equal where what follows
# cannot start with what the separator ate.
_SEPARATOR = r"\s*[,;\s]\s*"
_SEPARATOR_JAVA = r"(?:[\t\n\f\r ]*+[,;][\t\n\f\r ]*+|[\t\n\f\r ]++)"
_EATEN = [ord(c) for c in "\t\n\f\r ,;"]

_LOCAL = r"[A-Za-z0-9._%+\-]"
_EMAIL_GROUP = "(?:" + _LOCAL + "+@"
_EMAIL_GROUP_JAVA = "(?:(?<!" + _LOCAL + ")" + _LOCAL + "++@"


def _starts_clear(pattern: str) -> bool:
    """Must a match of ``pattern`` start with a character that the separator cannot have eaten?"""
    first = first_class(pattern)
    return first is not None and not any(lo <= c <= hi for lo, hi in first for c in _EATEN)


def _separator_is_safe(pattern: str, at: int) -> bool:
    """Can the separator at this place be possessive? Only where all that may follow it is known not to need what it ate."""
    rest = pattern[at + len(_SEPARATOR):]
    closes = re.match(r"\)(?:\{\d+(?:,\d*)?\}|[*+])(?![?+])", rest)
    if not closes:
        return _starts_clear(rest)
    # the last thing of a repeated group: the group's own start, or what comes after it
    start = pattern.rfind("(?:", 0, at)
    inner = pattern[start + 3:at]
    plain = start >= 0 and not re.search(r"[()|]", re.sub(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]", "", inner))
    return plain and _starts_clear(inner) and _starts_clear(rest[closes.end():])


def _email_is_safe(pattern: str) -> bool:
    """Does the address group that the pattern starts with repeat only after a separator? Then no address starts inside a run of its characters."""
    end = pattern.find(_SEPARATOR)
    return end >= 0 and pattern[end + len(_SEPARATOR):].startswith(")") and _separator_is_safe(pattern, end)


def to_java(pattern: str, case_sensitive: bool = False) -> str:
    """Java pattern that finds what RE2 would find with ``pattern``."""
    out, i, in_class = [], 0, False
    email = pattern.startswith(_EMAIL_GROUP) and _email_is_safe(pattern)
    if email:
        # the same language; the look-behind keeps a long run from being rescanned at every offset
        out.append(_EMAIL_GROUP_JAVA)
        i = len(_EMAIL_GROUP)
    while i < len(pattern):
        if not in_class:
            if pattern.startswith(_SEPARATOR, i) and _separator_is_safe(pattern, i):
                out.append(_SEPARATOR_JAVA)
                i += len(_SEPARATOR)
                continue
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            out.append(_escape(pattern[i + 1], in_class))
            i += 2
        elif in_class:
            if ch == "]":
                in_class = False
                out.append(ch)
                i += 1
            elif pattern.startswith("[:", i) and ":]" in pattern[i:]:
                end = pattern.index(":]", i)
                out.append(_posix(pattern[i + 2:end]))
                i = end + 2
            else:
                out.append("\\" + ch if ch in "[&" else ch)
                i += 1
        elif ch == "[":
            in_class = True
            out.append(ch)
            i += 1
            if pattern.startswith("^", i):
                out.append("^")
                i += 1
            if pattern.startswith("]", i):  # a leading ] is a member
                out.append(r"\]")
                i += 1
        elif ch == "$":
            out.append(r"\z")
            i += 1
        elif pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
        elif ch == "{" and not re.match(r"\{\d+(?:,\d*)?\}", pattern[i:]):
            out.append(r"\{")
            i += 1
        else:
            out.append(ch)
            i += 1
    flags = "(?d)" if case_sensitive else "(?id)"
    body = "".join(out)
    first = None if email else first_class(pattern)
    if first is None:
        return flags + body
    if not case_sensitive:
        first = _both_cases(first)
    # a one-character look-ahead rejects most offsets before anything costlier is tried
    if body.startswith(_WORD_EDGE) and all(_is_word(lo, hi) for lo, hi in first):
        body = r"(?<!\w)" + body[len(_WORD_EDGE):]
    return "(?=[" + "".join(_range(lo, hi) for lo, hi in _merge(first)) + "])" + flags + body


def _range(lo: int, hi: int) -> str:
    return f"\\x{{{lo:X}}}" if lo == hi else f"\\x{{{lo:X}}}-\\x{{{hi:X}}}"


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _both_cases(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = list(ranges)
    for lo, hi in ranges:
        for a, b, shift in ((65, 90, 32), (97, 122, -32)):
            if max(lo, a) <= min(hi, b):
                out.append((max(lo, a) + shift, min(hi, b) + shift))
    return out


_WORD_RANGES = ((48, 57), (65, 90), (95, 95), (97, 122))
_CATEGORY = {
    rc.CATEGORY_DIGIT: ((48, 57),),
    rc.CATEGORY_WORD: _WORD_RANGES,
    rc.CATEGORY_SPACE: ((9, 10), (12, 13), (32, 32)),
}


def _is_word(lo: int, hi: int) -> bool:
    return any(a <= lo and hi <= b for a, b in _WORD_RANGES)


def first_class(pattern: str) -> list[tuple[int, int]] | None:
    """Code-point ranges a match must start with; None when unknown, wide or possibly empty."""
    if re.search(r"\\[zACQpP]|\(\?[a-zA-Z]|\[:", pattern):
        return None
    try:
        ranges, empty = _first(rp.parse(pattern, re.ASCII))
    except (re.error, OverflowError, ValueError, _Unknown):
        return None
    return None if empty or not ranges or len(ranges) > 40 else sorted(set(ranges))


class _Unknown(Exception):
    pass


def _first(seq) -> tuple[list, bool]:
    """Ranges of first characters and whether the sequence may match nothing."""
    out: list = []
    for op, arg in seq:
        if op is rc.AT:
            if arg in (rc.AT_BOUNDARY, rc.AT_NON_BOUNDARY):
                continue
            raise _Unknown
        if op is rc.LITERAL:
            got, empty = [(arg, arg)], False
        elif op is rc.IN:
            got, empty = [], False
            for kind, val in arg:
                if kind is rc.LITERAL:
                    got.append((val, val))
                elif kind is rc.RANGE:
                    got.append(tuple(val))
                elif kind is rc.CATEGORY and val in _CATEGORY:
                    got.extend(_CATEGORY[val])
                else:
                    raise _Unknown
        elif op is rc.SUBPATTERN:
            got, empty = _first(arg[3])
        elif op is rc.BRANCH:
            parts = [_first(b) for b in arg[1]]
            got, empty = [r for p in parts for r in p[0]], any(p[1] for p in parts)
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
            got, empty = _first(arg[2])
            empty = empty or arg[0] == 0
        else:
            raise _Unknown
        out.extend(got)
        if not empty:
            return out, False
    return out, True


def _escape(ch: str, in_class: bool) -> str:
    if ch == "b" and not in_class:
        return _WORD_EDGE
    if ch == "B" and not in_class:
        return _NOT_WORD_EDGE
    if ch == "s":
        return _SPACE if in_class else f"[{_SPACE}]"
    if ch == "S":
        return f"[^{_SPACE}]"
    return "\\" + ch


def _posix(name: str) -> str:
    negated = name.startswith("^")
    java = {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower",
            "punct": "Punct", "space": "Space", "xdigit": "XDigit", "cntrl": "Cntrl", "print": "Print",
            "graph": "Graph", "blank": "Blank"}
    name = name.lstrip("^")
    if name == "word":
        return r"\W" if negated else r"\w"
    return ("\\P{" if negated else "\\p{") + java[name] + "}"


def required_literals(pattern: str, case_sensitive: bool = False) -> list[str] | None:
    """Any-of list of substrings without which ``pattern`` cannot match; None when there is none.

    For case-insensitive patterns the literals are lower case and meant for a lower-cased text.
    """
    try:
        tree = rp.parse(re.sub(r"\\z", r"\\Z", pattern))
    except (re.error, OverflowError, ValueError):
        return None
    best = _required(tree)
    if not best:
        return None
    if not case_sensitive:
        if any(not s.isascii() for s in best):
            return None
        best = {s.lower() for s in best}
    return sorted(best)


def _score(options: set[str]) -> tuple:
    return (min(len(s) for s in options), -len(options))


_MAX_OPTIONS = 24


def _small_class(items) -> list[str] | None:
    """Members of a short character class such as ``[pousr]``."""
    chars: list[str] = []
    for kind, val in items:
        if kind is rc.LITERAL:
            chars.append(chr(val))
        elif kind is rc.RANGE and val[1] - val[0] < 8:
            chars.extend(chr(c) for c in range(val[0], val[1] + 1))
        else:
            return None
    return chars if len(chars) <= 8 else None


def _required(seq) -> set[str] | None:
    candidates: list[set[str]] = []
    run: set[str] = {""}

    def close() -> None:
        nonlocal run
        if run != {""}:
            candidates.append(run)
        run = {""}

    for op, arg in seq:
        if op is rc.LITERAL:
            run = {r + chr(arg) for r in run}
            continue
        if op is rc.IN:
            chars = _small_class(arg)
            if chars and len(chars) * len(run) <= _MAX_OPTIONS:
                run = {r + c for r in run for c in chars}
                continue
        close()
        found = None
        if op is rc.SUBPATTERN:
            found = _required(arg[3])
        elif op is rc.BRANCH:
            parts = [_required(branch) for branch in arg[1]]
            found = set().union(*parts) if all(parts) else None
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[0] >= 1:
            found = _required(arg[2])
        if found and len(found) <= _MAX_OPTIONS:
            candidates.append(found)
    close()
    return max(candidates, key=_score) if candidates else None


def glob_to_regex(glob: str) -> str:
    """Anchored Java regex of a dotted-path glob (``*`` one segment, ``**`` any number)."""
    if glob == "**":
        return r"(?s)\A.*\z"
    if "*" not in glob:
        return r"\A" + _quote(glob) + r"\z"
    # every segment is written with its leading dot; the path is matched as "." + path
    body = ""
    for segment in glob.split("."):
        if segment == "**":
            body += r"(?:\.[^.]*)*"
        elif segment == "*":
            body += r"\.[^.]*"
        else:
            body += r"\." + _quote(segment)
    return r"\A" + body + r"\z"


def sql_string(text: str) -> str:
    """Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def glob_sql(glob: str, path: str) -> str:
    """SQL predicate: does the path expression match ``glob``? Compiled when the plan is built."""
    if glob == "**":
        return "true"
    if "*" not in glob:
        return f"{path} = {sql_string(glob)}"
    parts = glob.split(".")
    if parts[-1] == "**" and "*" not in "".join(parts[:-1]):
        # the common "prefix.**" form needs no regex
        prefix = ".".join(parts[:-1])
        return f"({path} = {sql_string(prefix)} OR startswith({path}, {sql_string(prefix + '.')}))"
    return f"concat('.', {path}) RLIKE {sql_string(glob_to_regex(glob))}"


def glob_match(glob: str, path):
    """Boolean Column: does ``path`` match ``glob``?"""
    from pyspark.sql import functions as F

    from tracewarden.functions.ranks import as_col

    path = as_col(path)
    if glob == "**":
        return F.lit(True)
    if "*" not in glob:
        return path == glob
    return F.concat(F.lit("."), path).rlike(glob_to_regex(glob))


def _quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_\-/ ])", r"\\\1", text)
