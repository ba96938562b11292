"""Language identification by Bayesian evidence fusion.

The posterior of a language is the product of four parts: the likelihood of the text under character trigrams, the likelihood of the language that
the markup declares, that of the address suffix, and the prior of the host. Trigram counts come from labelled documents. What declarations and
suffixes are worth is learned from all rows: each row adds the posterior of its text alone to its declaration, suffix, host and domain, by grouped
sums. Host priors are smoothed towards their domain, domains towards the whole; a row's own share is taken off its host first.

A long text is no more than ``STRENGTH`` trigrams of evidence, however many it has, so that the other parts are heard; all its trigrams count.
Trigrams are hashed to 2 ** 16 cells, so the model has that many numbers per language.

Defined results. Null and empty texts have no likelihood of their own: the other parts decide. Missing declarations, addresses and hosts add nothing.
Ties go to the first language by name. Without labelled documents the language is null. Repeated rows get equal results, and count as often as
they stand there. Rows with null ids are classified. Other columns come back as they are, whatever their names, but for ``lang`` and ``score``, whose names the
results take. More than ``MOST_LANGUAGES`` labels raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_proven, stored

CELLS = 1 << 16
#: the model has CELLS numbers per language on the driver and in each task
MOST_LANGUAGES = 256
STRENGTH = 60.0
SMOOTH = 4.0
_LETTER = np.array([c if chr(c).isalpha() else 32 for c in range(0x3000)], dtype=np.uint32)


def trigram_cells(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all trigrams of letters and single blanks, text after text, and the text of each."""
    lows = [(x or "").lower() for x in texts]
    code = np.frombuffer("".join(lows).encode("utf-32-le", "replace"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(lows)), [len(x) for x in lows])
    code = np.where(code < 0x3000, _LETTER[np.minimum(code, 0x2FFF)], code)
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32) | (owner[1:] != owner[:-1])
    code, owner = code[keep], owner[keep]
    if len(code) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    inside = owner[2:] == owner[:-2]
    a, b, c = code[:-2][inside], code[1:-1][inside], code[2:][inside]
    h = a * np.uint32(0x9E3779B1) ^ (b * np.uint32(0x85EBCA77) + np.uint32(77)) ^ (c * np.uint32(0xC2B2AE3D))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(16)).astype(np.int64), owner[2:][inside]


def trigram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, cell, n) over rows (lang, text); each task sends a count once."""
    def run(batches):
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column("lang").to_pylist()
            for i in range(0, len(langs), 200):
                cells, owner = trigram_cells(b.column("text").slice(i, 200).to_pylist())
                part = np.array(langs[i:i + 200])
                for lang in set(part.tolist()):
                    seen.setdefault(lang, np.zeros(CELLS, dtype=np.int64))
                    seen[lang] += np.bincount(cells[part[owner] == lang], minlength=CELLS)
        for lang, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at])], ["lang", "cell", "n"])

    return labelled.select("lang", "text").mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def page_text(html: Column) -> Column:
    """The text of a page: scripts, styles, comments and tags are left out."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>|<!--.*?-->", " "), r"<[^>]*>|&[a-zA-Z#0-9]+;", " ")


def declared_language(html: Column) -> Column:
    """The primary subtag of the root element's lang attribute."""
    found = F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-zA-Z]{2,8})""", 1))
    return F.when(found != "", found)


def host_of(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.when(found != "", found)


def address_suffix(url: Column) -> Column:
    """A two-letter first step of the path, else the last label of the host."""
    step = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+/([a-zA-Z]{2})(?:[/?#]|$)", 1))
    return F.when(step != "", F.concat(F.lit("/"), step)).otherwise(F.concat(F.lit("."), F.regexp_extract(host_of(url), r"([^.]+)$", 1)))


def _likelihoods(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """Rows without their text, with ``ll``: a log likelihood per language."""
    names = [c for c in rows.columns if c != "text"]
    n_langs = len(table)
    schema = T.StructType([*rows.select(*names).schema.fields, T.StructField("ll", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 200):
                b = whole.slice(i, 200)
                cells, owner = trigram_cells(b.column("text").to_pylist())
                n = np.bincount(owner, minlength=b.num_rows)
                scale = np.minimum(1.0, STRENGTH / np.maximum(n, 1))
                ll = np.column_stack([np.bincount(owner, row[cells], b.num_rows) * scale for row in table])
                ends = np.arange(0, n_langs * b.num_rows + 1, n_langs, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.ListArray.from_arrays(pa.array(ends), pa.array(ll.ravel()))], [*names, "ll"])

    return rows.select(*names, "text").mapInArrow(run, schema)


def identify(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """Add ``lang`` and ``score`` (its posterior) to rows with text, declared, suffix, domain and host.

    ``labelled`` has the rows (lang, text) that the trigrams are learned from. All columns but the text come back.
    """
    given = [c for c in rows.columns if c not in ("text", "lang", "score")]
    # inside, columns have names of their own, so any other name is free to the caller
    names = [f"in_{i}" for i in range(len(given))]
    keys = [F.col(c).alias(f"k_{c}") for c in ("declared", "suffix", "domain", "host")]
    rows = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(given, names)], *keys, "text")
    back = [F.col(n).alias(c) for c, n in zip(given, names)]
    labelled = labelled.where("lang is not null and text is not null")
    n_langs = labelled.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    if n_langs > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages among the labels: the label column holds something else")
    counts = stored(trigram_counts(labelled), "trigrams").collect()  # CELLS rows per language at most
    langs = sorted({r["lang"] for r in counts})
    if not langs:
        return rows.select(*back, F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("score"))
    table = np.full((len(langs), CELLS), 0.5)
    for r in counts:
        table[langs.index(r["lang"]), r["cell"]] += r["n"]
    table = np.log(table / table.sum(axis=1, keepdims=True))

    ls = range(len(langs))
    def posterior(parts: list[Column]) -> list[Column]:  # noqa: E306
        top = F.greatest(*parts) if len(parts) > 1 else parts[0]
        e = [F.exp(p - top) for p in parts]
        return [x / sum(e[1:], e[0]) for x in e]

    known = stored(_likelihoods(rows, table), "text-likelihoods")
    known = known.select("*", *[p.alias(f"_p{i}") for i, p in zip(ls, posterior([F.element_at("ll", i + 1) for i in ls]))])
    total = known.agg(*[F.sum(f"_p{i}").alias(f"s{i}") for i in ls]).first()
    mass = sum(total[f"s{i}"] or 0.0 for i in ls)
    share = [((total[f"s{i}"] or 0.0) + 1.0) / (mass + len(langs)) for i in ls]

    def sums(key: str, tag: str) -> DataFrame:
        return known.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.sum(f"_p{i}").alias(f"{tag}{i}") for i in ls])

    out = known
    for key, tag in (("k_declared", "_d"), ("k_suffix", "_s")):
        seen = stored(sums(key, tag), key)
        kinds = seen.count() + 1
        all_of = seen.agg(*[F.sum(f"{tag}{i}").alias(f"s{i}") for i in ls]).first()
        # the chance that a page in this language carries this mark
        seen = seen.select(key, *[F.log((F.col(f"{tag}{i}") + SMOOTH / kinds) / ((all_of[f"s{i}"] or 0.0) + SMOOTH)).alias(f"{tag}{i}") for i in ls])
        out = out.join(broadcast_if_proven(seen, 16 * (len(langs) + 4)), key, "left")
    domains = stored(sums("k_domain", "_o"), "domains")
    hosts = stored(sums("k_host", "_h"), "hosts")
    out = out.join(broadcast_if_proven(domains, 16 * (len(langs) + 8)), "k_domain", "left").join(broadcast_if_proven(hosts, 16 * (len(langs) + 8)), "k_host", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    domain_n = sum((zero(F.col(f"_o{i}")) for i in ls), F.lit(0.0))
    host_n = sum((zero(F.col(f"_h{i}")) for i in ls), F.lit(0.0))
    own = lambda i: F.when(F.col("k_host").isNotNull(), F.col(f"_p{i}")).otherwise(0.0)
    own_d = lambda i: F.when(F.col("k_domain").isNotNull(), F.col(f"_p{i}")).otherwise(0.0)
    parts = []
    for i in ls:
        of_domain = (F.greatest(zero(F.col(f"_o{i}")) - own_d(i), F.lit(0.0)) + SMOOTH * share[i]) / (F.greatest(domain_n - 1, F.lit(0.0)) + SMOOTH)
        of_host = (F.greatest(zero(F.col(f"_h{i}")) - own(i), F.lit(0.0)) + SMOOTH * of_domain) / (F.greatest(host_n - 1, F.lit(0.0)) + SMOOTH)
        parts.append(F.element_at("ll", i + 1) + F.log(of_host) + zero(F.col(f"_d{i}")) + zero(F.col(f"_s{i}")))
    final = posterior(parts)
    best = F.greatest(*final) if len(final) > 1 else final[0]
    lang = F.coalesce(*[F.when(p == F.col("score"), F.lit(name)) for p, name in zip([F.col(f"_f{i}") for i in ls], langs)])
    out = out.select(*names, best.alias("score"), *[p.alias(f"_f{i}") for i, p in zip(ls, final)])
    return out.select(*back, lang.alias("lang"), "score")
