"""Small tables with everything that may go wrong in them."""

import random

# columns whose names the operators use themselves, and the output's names
CLASHES = {"id": 1, "th": 2, "chunk": 3, "key": "k", "n_words": 4, "kept": "x", "word": "w", "_i": 5, "_t": 6, "_rows": 7, "_score": 0.5, "_toxic_n_words": 1.0,
           "score": 0.1, "path": "p", "blob": "b", "spans": "s", "item": 1, "node": 2, "take": 3, "epoch": 9, "_blob": "b", "_spans": "s", "n": 0}

UPPER_TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sentence(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(spark, rows):
    """Rows of (doc_id, text, lang, source) with clashing columns added."""
    base = "doc_id long, text string, lang string, source string, n_chars long"
    more = ", ".join(f"`{c}` {'double' if isinstance(v, float) else 'long' if isinstance(v, int) else 'string'}" for c, v in CLASHES.items())
    data = [(i, t, lang, src, None if t is None else len(t), *CLASHES.values()) for i, t, lang, src in rows]
    return spark.createDataFrame(data, f"{base}, {more}").repartition(3)


def some_documents(seed: int = 1) -> list:
    """Copies, near copies, a shared passage, one very long text, ties, nulls in every column, blanks of all kinds, a repeated row."""
    rng = random.Random(seed)
    base = sentence(rng, 120)
    near = base.split(" ")
    near[60] = "changed"
    passage = sentence(rng, 30)
    rows = [
        (5, base, "en", "s1"), (3, base, "en", "s1"), (9, " ".join(near), "en", "s2"), (9, " ".join(near), "en", "s2"),
        (11, sentence(rng, 40) + " " + passage + " " + sentence(rng, 10), "de", "s1"), (12, passage, "de", None), (13, "A\tb\x0bC\x0c d\r\n" + passage.upper(), None, "s3"),
        (20, None, "en", "s1"), (21, "", "en", "s1"), (22, " \t\n ", None, None), (23, "one", "en", "s1"), (24, "ONE", "fr", "s1"), (25, "one two", "fr", "s2"),
        (26, "\x1cé ß x \U0001f600 y", "fr", "s2"), (30, "z " * 60, "en", "s4"), (31, "q " + "z " * 40, "en", "s4"), (None, base, "en", "s1"), (None, None, None, None),
        (40, sentence(rng, 30000, 5000), "en", "s5"), (41, "x" * 200_000, "en", "s5"),
    ]
    return rows + [(100 + i, sentence(rng, rng.randrange(5, 80)), rng.choice(["en", "de"]), f"s{i % 4}") for i in range(40)]
