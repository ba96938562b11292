"""Chat formatting by schema fingerprints.

A record's fingerprint is a hash of its nested field paths. It selects a declarative mapping, which says where the record keeps
turns; the mapping turns prompt, instruction and message layouts into canonical turns. A template then marks the turns,
escapes control strings in texts reversibly and notes which stretches carry loss.

Defined results. A null text is empty and a null role is an empty role; an empty list of messages makes no turn. Turns of a
conversation are ordered by turn number (nulls first), then by their place in the record, role and text, so ties and repeated rows all stay, in one
order. Records whose fingerprint no mapping names come back from ``unmapped``; they are not guessed at. A conversation id may
be null and is then one conversation. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template
TURN, SEP, END = "<|turn|>", "<|says|>", "<|done|>"
CONTROL = ("<|turn|>", "<|says|>", "<|done|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
           "<|im_start|>", "<|im_end|>", "<|endoftext|>")
LOSS_ROLE = "assistant"

#: bytes from which a record's long strings are left out before its shape is taken
LONG = 1 << 20
ANY_LENGTH = {"maxStringLen": "2147483647"}
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """One layout: its field paths and, per turn, either (role, path of the text) or the path of a list with role and text fields."""
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    each: str = ""
    role: str = "role"
    text: str = "content"
    #: are role names of this layout other names for the canonical ones?
    renamed: bool = False


MAPPINGS = (
    Mapping(("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Mapping(("completion", "prompt"), (("user", "prompt"), ("assistant", "completion"))),
    Mapping(("question", "answer"), (("user", "question"), ("assistant", "answer"))),
    Mapping(("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Mapping(("instruction", "input", "output"), (("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping(("system", "prompt", "response"), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping(("messages", "messages[].content", "messages[].role"), each="messages"),
    Mapping(("conversations", "conversations[].from", "conversations[].value"), each="conversations", role="from", text="value", renamed=True),
    Mapping(("role", "text"), each="$", text="text"),
    Mapping(("content", "role"), each="$"),
)
#: names that layouts give to the roles, and the canonical ones
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def shape_of(paths: tuple[str, ...]) -> str:
    """The shape that records with these field paths have: names in order, lists and objects nested, values left out."""
    tree: dict = {}
    for p in sorted(paths):
        at = tree
        for step in p.split("."):
            at = at.setdefault(step.removesuffix("[]"), {})

    def text(node: dict, path: str) -> str:
        listed = bool(path) and any(p.startswith(f"{path}[]") for p in paths)
        below = f"{path}[]." if listed else f"{path}." if path else ""
        inner = "OBJECT<" + ", ".join(f"{k}: {text(v, below + k)}" for k, v in sorted(node.items())) + ">" if node else "_"
        return f"ARRAY<{inner}>" if listed else inner

    return text(tree, "")


def fingerprint_of(paths: tuple[str, ...]) -> str:
    import hashlib

    return hashlib.sha256(shape_of(paths).encode()).hexdigest()


def shape(record: Column) -> Column:
    """A JSON record's nested field paths, without values and scalar types; text that looks like JSON is a value."""
    # variants hold no very long strings: in long records those are left out first. Escaped quotes and backslashes go before, so quotes stand around strings only
    plain = F.replace(F.replace(record, F.lit("\\\\"), F.lit("??")), F.lit('\\"'), F.lit("??"))
    short = F.regexp_replace(plain, '"([^"]{0,1000}+)"|"[^"]*+"', '"$1"')
    schema = F.schema_of_variant(F.try_parse_json(F.when(F.octet_length(record) > LONG, short).otherwise(record)))
    return F.regexp_replace(schema, r"(: |ARRAY<)(?!OBJECT<|ARRAY<)[A-Z_]+(\([0-9, ]+\))?", "$1_")


def fingerprint(record: Column) -> Column:
    """Hash of the nested field paths of a JSON record; values play no part."""
    return F.sha2(shape(record), 256)


def canonical_role(role: Column) -> Column:
    low = F.lower(F.coalesce(role, F.lit("")))
    out = F.coalesce(role, F.lit(""))
    for name, canonical in ROLES.items():
        out = F.when(low == name, F.lit(canonical)).otherwise(out)
    return out


def _turns(record: Column, m: Mapping) -> Column:
    if not m.each:
        parsed = F.from_json(record, ",".join(f"`{p}` string" for _, p in m.turns), ANY_LENGTH)
        return F.array(*[F.struct(F.lit(r).alias("role"), F.coalesce(parsed[p], F.lit("")).alias("text")) for r, p in m.turns])
    one = f"struct<`{m.role}`:string,`{m.text}`:string>"
    items = F.array(F.from_json(record, one, ANY_LENGTH)) if m.each == "$" else F.from_json(record, f"`{m.each}` array<{one}>", ANY_LENGTH)[m.each]
    return F.transform(F.coalesce(items, F.array().cast(f"array<{one}>")), lambda i: F.struct(
        (canonical_role(i[m.role]) if m.renamed else F.coalesce(i[m.role], F.lit(""))).alias("role"), F.coalesce(i[m.text], F.lit("")).alias("text")))


def canonical_turns(records: DataFrame, conv_id: str = "conv_id", turn: str = "turn", record: str = "record",
                    mappings: tuple[Mapping, ...] = MAPPINGS, strict: bool = False) -> DataFrame:
    """Rows (conv_id, turn, place, role, text) of all records with a known layout; with ``strict`` any other record is an error."""
    marked = records.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(record).alias("record"),
                            fingerprint(F.col(record)).alias("print"))
    out = F.raise_error(F.concat(F.lit("no mapping for a record with fingerprint "), F.coalesce("print", F.lit("null")))) if strict else F.lit(None)
    out = out.cast(TURNS)
    for m in mappings:
        out = F.when(F.col("print") == fingerprint_of(m.paths), _turns(F.col("record"), m)).otherwise(out)
    return marked.select("conv_id", "turn", F.posexplode(out).alias("place", "t")).select(
        "conv_id", "turn", "place", "t.role", "t.text")


def unmapped(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """How many records each unknown fingerprint has, with its shape; broken JSON has none."""
    known = [fingerprint_of(m.paths) for m in mappings]
    return (records.select(fingerprint(F.col(record)).alias("print"), shape(F.col(record)).alias("shape"))
            .where(F.col("print").isNull() | ~F.col("print").isin(known)).groupBy("print", "shape").agg(F.count("*").alias("records")))


def escaped(text: Column) -> Column:
    r"""Break control strings: a backslash after their first character; backslashes of the text are doubled."""
    import re

    heads = {}
    for c in CONTROL:
        heads.setdefault(c[0], []).append(re.escape(c[1:]).replace("<", r"\x3C"))
    pattern = "|".join(f"\\{h}(?={'|'.join(rest)})" if h == "[" else f"{h}(?={'|'.join(rest)})" for h, rest in heads.items())
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), pattern, "$0\\\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): one string per conversation and the [start, end) code points that carry loss."""
    t = turns.select(
        "conv_id", F.struct("turn", "place", "role", F.col("text")).alias("t"))
    conv = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    parts = F.transform("ts", lambda t: F.struct(
        F.concat(F.lit(TURN), escaped(t["role"]), F.lit(SEP)).alias("head"), escaped(t["text"]).alias("body"),
        (t["role"] == LOSS_ROLE).alias("on")))
    conv = conv.select("conv_id", parts.alias("p"))
    spans = F.aggregate(
        "p", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.char_length(x["head"]) + F.char_length(x["body"]) + len(END)).alias("at"),
            F.when(x["on"], F.concat(a["out"], F.array(F.struct(
                (a["at"] + F.char_length(x["head"])).alias("start"),
                (a["at"] + F.char_length(x["head"]) + F.char_length(x["body"])).alias("end"))))).otherwise(a["out"]).alias("out")),
        lambda a: a["out"])
    return conv.select(
        "conv_id", F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"),
        spans.alias("loss"))


def read_back(text: Column) -> Column:
    """Turns read from a formatted string."""
    import re

    pieces = F.filter(F.split(text, re.escape(END), -1), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        unescaped(F.substring(F.substring_index(p, SEP, 1), len(TURN) + 1, F.char_length(p))).alias("role"),
        unescaped(F.substring(p, F.char_length(F.substring_index(p, SEP, 1)) + len(SEP) + 1, F.char_length(p))).alias("text")))


def loss_texts(text: Column, loss: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(text, s["start"] + 1, s["end"] - s["start"]))), "")
