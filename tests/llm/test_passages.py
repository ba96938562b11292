"""Repeated passages: the operator against brute force, and no window lost by the symbols' test."""

import random
import re

import pyarrow as pa
import pytest

from tracewarden.llm import passages

from .messy import documents, some_documents


def brute(rows, size):
    words = [(i, re.findall(r"[^\x20\x09-\x0d]+", t or "")) for i, t, *_ in rows]
    least = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - size + 1):
                s = tuple(w[k:k + size])
                least[s] = min(least.get(s, i), i)
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for k in range(len(w) - size + 1):
                if least[tuple(w[k:k + size])] < i:
                    gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [13, 5])
def test_whole_operator(spark, size):
    rows = some_documents()
    out = passages.remove_repeats(documents(spark, rows), size=size, chunk_bytes=60_000, bucket_bytes=50_000)
    assert sorted(map(tuple, out.collect()), key=repr) == brute(rows, size)


def test_empty_table(spark):
    assert passages.remove_repeats(documents(spark, []).where("false")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_symbols_lose_no_window(seed):
    rng = random.Random(seed)
    for _ in range(40):
        vocabulary, size = rng.choice([1, 2, 3, 8, 40]), 13
        base = [str(rng.randrange(vocabulary)) for _ in range(70)]
        docs = []
        for _ in range(6):
            i = rng.randrange(45)
            edge = lambda: [str(rng.randrange(vocabulary * 2)) for _ in range(rng.randrange(9))]
            docs.append(edge() + base[i:i + rng.randrange(13, 25)] + edge())
        parts = [passages.parse(pa.array([" ".join(d) for d in docs[k:k + 2]]), size) for k in (0, 2, 4)]
        asks = [passages.pair_asks(p) for p in parts]
        replies = passages.shared_bits([a[0] for a in asks], [a[1].tobytes() for a in asks])
        owners = {}
        for d, w in enumerate(docs):
            for k in range(len(w) - size + 1):
                owners.setdefault(tuple(w[k:k + size]), set()).add(d)
        for n, p in enumerate(parts):
            found = set(p.starts[passages.candidates(p, [replies[n]])].tolist())
            for j in (0, 1):
                w = docs[2 * n + j]
                for k in range(len(w) - size + 1):
                    assert len(owners[tuple(w[k:k + size])]) == 1 or int(p.words.starts[j]) + k in found


def test_names_do_not_depend_on_the_order_of_documents():
    texts = [t for _, t, *_ in some_documents(3)]
    one, other = (passages.pair_asks(passages.parse(pa.array(x), 13))[0].tolist() for x in (texts, texts[::-1]))
    assert one == other
