"""Near duplicates, nearest neighbours, language model, toxicity and language: brute force or held-out accuracy, and messy input."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewarden.llm import components, language, language_model, near, nearest, toxicity
from tracewarden.llm.queries import QUERIES

from .messy import UPPER_TO_LOWER, documents, sentence, some_documents

SF = "/root/testdata/sf0.001"


# -- near duplicates -----------------------------------------------------------------------------------------

def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(UPPER_TO_LOWER))
    return frozenset(tuple(w[k:k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_components(rows, size, percent):
    sets = [(i, shingles(t, size)) for i, t, *_ in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if sets[a][0] is not None and sets[b][0] is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(s), None if i is None else least[find(k)]) for k, (i, s) in enumerate(sets)), key=repr)


def test_the_order_of_shingles_comes_from_all_texts(spark):
    """Long texts and texts beyond any sample count: the ranks are those of the counts over every text."""
    rng = random.Random(9)
    texts = [sentence(rng, 40, 60) for _ in range(300)] + [sentence(rng, 300_000, 60), "two words", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").repartition(5)
    counts = np.zeros(near.BUCKETS, dtype=np.int64)
    for t in texts:
        np.add.at(counts, (near.shingle_sets(pa.array([t], pa.string()), 3)[0] >> np.uint64(64 - near.BUCKET_BITS)).astype(np.int64), 1)
    assert len(texts[300]) > 1_000_000
    assert near.frequencies(docs, 3).tolist() == np.unique(counts, return_inverse=True)[1].tolist()


def groups_of_near_copies():
    """A centre with copies that differ from each other more than from it, chains, and copies of copies."""
    rng = random.Random(4)
    rows = []
    for g in range(3):
        centre = sentence(rng, 150, 3000).split(" ")
        rows.append((1000 * g + 700, " ".join(centre), "en", "s0"))
        for k in range(30):
            w = list(centre)
            for at in rng.sample(range(150), 3):
                w[at] = f"x{rng.randrange(10**6)}"
            rows.append((1000 * g + k, " ".join(w), "en", "s0"))
    chain = sentence(rng, 150, 3000).split(" ")
    for k in range(8):
        rows.append((5000 - k, " ".join(chain), "de", "s1"))
        chain = [f"y{rng.randrange(10**6)}" if rng.random() < 0.02 else x for x in chain]
    return rows


def test_near_components(spark):
    rows = some_documents() + groups_of_near_copies()
    out = near.near_components(documents(spark, rows), size=3, percent=85).select("id", "n", "component")
    assert sorted(map(tuple, out.collect()), key=repr) == brute_components(rows, 3, 85)


def families_without_centre():
    """Copies of an absent original whose edits partly overlap, and a long shared passage that leaves most pairs just below the threshold."""
    rng = random.Random(11)
    rows = []
    for g in range(3):
        original = sentence(rng, 150, 3000).split(" ")
        edits = [(at, f"e{g}x{at}") for at in range(2, 148, 4)]
        for k in range(150):
            w = list(original)
            for at, x in rng.sample(edits, 4):
                w[at] = x
            rows.append((10_000 * (g + 1) + k, " ".join(w), "en", "s0"))
    passage = sentence(rng, 120, 3000)
    tails = [sentence(rng, 14, 3000) for _ in range(60)]
    rows += [(50_000 + k, f"{passage} {t}", "en", "s1") for k, t in enumerate(tails)]
    return rows + [(60_000 + k, f"{passage} {t} z{k}", "en", "s1") for k, t in enumerate(tails)]


@pytest.mark.parametrize("block, size, percent", [(256, 3, 85), (16, 5, 80)])
def test_near_components_without_centre(spark, monkeypatch, block, size, percent):
    monkeypatch.setattr(near, "BLOCK", block, raising=False)
    rows = families_without_centre()
    out = near.near_components(documents(spark, rows), size=size, percent=percent).select("id", "n", "component")
    assert sorted(map(tuple, out.collect()), key=repr) == brute_components(rows, size, percent)


def test_keep_one_row_of_each_group(spark):
    rows = some_documents(2)
    docs = documents(spark, rows)
    kept = near.keep_one(docs, size=5, percent=80)
    assert kept.columns == docs.columns
    want = {i for i, _, c in brute_components(rows, 5, 80) if i is not None and i == c}
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == sorted(want) and got.count(None) == 2


def test_near_on_no_rows(spark):
    assert near.near_components(documents(spark, []).where("false")).count() == 0


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(139, 200), (7, 7)]
    out = components.components(spark.createDataFrame(edges, "u long, v long"))
    assert {r["node"]: r["component"] for r in out.collect()} == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 100}


# -- nearest neighbours ----------------------------------------------------------------------------------------

def test_nearest_recall_on_the_table(spark):
    got = QUERIES["op3_nearest"](spark, SF).toPandas()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.array(table.embedding.tolist(), dtype=float)
    ids = table.vec_id.to_numpy()
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        want = set(ids[np.argsort(-s)[:20]])
        mine = got[got.query_id == ids[i]].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 21)) and list(mine.score) == sorted(mine.score, reverse=True)
        hits += len(want & set(mine.vec_id))
        total += 20
    assert hits / total >= 0.9


@pytest.mark.parametrize("kind", ["unit", "one doubled", "one ten times", "some long", "log-normal"])
def test_nearest_recall_with_uneven_norms(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "log-normal":
        x *= np.exp(rng.normal(size=(3000, 1)) * 0.5)
    elif kind != "unit":
        x[5:6 if kind != "some long" else 300] *= {"one doubled": 2, "one ten times": 10, "some long": 3}[kind]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest.nearest(df, F.col("id") % 60 == 0).toPandas()
    hits = 0
    for q, mine in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20]) & set(mine.vec_id))
    assert hits / (20 * 50) >= 0.95


def test_nearest_messy(spark):
    rng = np.random.default_rng(1)
    same = [1.0, 2.0, 0.5]
    rows = [(i, same) for i in range(0, 60)] + [(100 + i, rng.normal(size=3).tolist()) for i in range(30)]
    rows += [(100, rows[60][1]), (200, None), (201, [0.0, 0.0, 0.0]), (202, [1.0, None, 1.0]), (203, [float("nan"), 1.0, 1.0]), (204, [float("inf"), 1.0, 1.0]),
             (None, same), (206, []), (220, [1.0]), (221, [3.0]), (222, [3.0]), (222, [4.0]), (240, [2.0] * 5)]
    df = spark.createDataFrame([(i, v, 3, "q") for i, v in rows], "vec_id long, embedding array<double>, id int, axis string")
    got = nearest.nearest(df, F.col("id") % 20 == 0, k=25, tables=10, probes=4).collect()
    fine = {i: np.array(v) for i, v in rows if i is not None and i < 200}
    for q in (0, 20, 40, 100, 120):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert len(mine) == 25 and all(abs(s - float(fine[q] @ fine[v])) < 1e-12 for _, v, s in mine)
        assert [(v, s) for _, v, s in mine] == sorted([(v, s) for _, v, s in mine], key=lambda x: (-x[1], x[0]))
    # a length of its own: one place per id, with its best vector; a vector without others of its length has no neighbours
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == 220) == [(1, 222, 4.0), (2, 221, 3.0)]
    assert {r["query_id"] for r in got} == {0, 20, 40, 100, 120, 220}
    few = nearest.nearest(df.where("vec_id in (0, 100, 101)"), F.col("id") % 20 == 0, tables=2, probes=1).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in few) == [(0, 100), (0, 101), (100, 0), (100, 101)]
    assert nearest.nearest(df.where("false"), F.col("id") % 20 == 0).count() == 0


# -- language model --------------------------------------------------------------------------------------------

def test_language_model(spark):
    rows = some_documents()
    got = language_model.score_documents(documents(spark, rows), chunk_bytes=60_000, bucket_bytes=50_000).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [(i, re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(UPPER_TO_LOWER)) + [None]) for i, t, *_ in rows]
    c = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 4)) for i, ws in tokens), key=repr)
    assert sorted(((r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got), key=repr) == want
    assert all(r["score"] < 0 for r in got)
    assert language_model.score_documents(documents(spark, []).where("false")).count() == 0


def test_language_model_beats_its_base_on_held_out_text(spark):
    got = QUERIES["op4_language_model"](spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("m"), F.sum("base_score").alias("b")).first()
    assert got["m"] > got["b"]


def test_weights_follow_held_out_counts():
    hist = [{"b": 5, "p2": 4, "p1": 40, "n": 1000}, {"b": 1, "p2": language_model.LOW, "p1": 30, "n": 1000}]
    w = language_model.fit_weights(hist, 1e-6)
    assert w[5, 0] > 0.9 and w[1, 1] > 0.8 and w[0, 0] == 0 and np.allclose(w.sum(axis=1), 1)


# -- toxicity ----------------------------------------------------------------------------------------------------

def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    out = QUERIES["op8_score_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert out.score.between(0, 1).all()
    caught, wrong = out[(out.toxic == 1)].predicted.mean(), out[(out.toxic == 0)].predicted.mean()
    assert caught > 0.8 and wrong < 0.01


def test_toxicity_messy(spark):
    rng = random.Random(3)
    rows = some_documents()
    for k in range(200):
        bad = k % 4 == 0
        rows.append((1000 + k, sentence(rng, 40) + (" you idiot moron " * 4 if bad else ""), "en", "s"))
    labels = spark.createDataFrame(
        [(1000 + k, int(k % 4 == 0), 1) for k in range(180)] + [(1000, 0, 1), (1001, None, 1), (None, 1, 1), (99999, 1, 1)], "doc_id long, toxic int, score int")
    docs = documents(spark, rows)
    out = toxicity.score_toxicity(docs, labels)
    assert out.columns == [c for c in docs.columns if c != "_score"] + ["_held_out", "_score", "_predicted"]
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r["_score"] <= 1 for r in got)
    assert all(r["_predicted"] == ((r["doc_id"] - 1000) % 4 == 0) for r in got if r["doc_id"] and 1000 <= r["doc_id"] < 1200)
    assert all(r["_held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    none = toxicity.score_toxicity(docs, labels.where("false")).select("_score", "_predicted").distinct().collect()
    assert [tuple(r) for r in none] == [(0.0, 0)]
    assert toxicity.score_toxicity(docs.where("false"), labels).count() == 0


# -- language ------------------------------------------------------------------------------------------------------

def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op10_identify_language"](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("lang").alias("true"))
    held = out.where("held_out and doc_id is not null").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("true")).cast("int"))).first()[0]
    assert held > 0.97
    assert out.count() == docs.count() + spark.read.parquet(f"{sf}/pages.parquet").count()


def test_language_fuses_evidence(spark):
    labelled = spark.createDataFrame([("en", "the house and the garden with the tree"), ("de", "das haus und der garten mit dem baum"), (None, "x"), ("en", None)] * 5, "lang string, text string")
    rows = [(i, t, d, s, dom, h, "extra") for i, (t, d, s, dom, h) in enumerate(
        [("the garden and the tree", "en", ".com", "a.com", "x.a.com")] * 20 + [("der garten und das haus", "de", ".de", "b.de", "y.b.de")] * 20
        + [("", "de", None, None, None), (None, None, None, "b.de", "y.b.de"), ("zzz", None, ".de", None, None), (None, None, None, None, None), ("the tree " * 5000, None, None, None, None)])]
    df = spark.createDataFrame(rows, "id long, text string, declared string, suffix string, domain string, host string, ll string")
    clash = df
    for c in ("lang", "score", "_p0", "_f1", "_d0", "_h1", "in_0", "k_host", "s0", "a.b"):
        clash = clash.withColumn(c, F.lit("kept"))
    got = {r["id"]: r for r in language.identify(clash, labelled).collect()}
    assert list(got[0].asDict()) == [c for c in clash.columns if c not in ("text", "lang", "score")] + ["lang", "score"] and {r["ll"] for r in got.values()} == {"extra"}
    assert {r[c] for r in got.values() for c in ("_p0", "_f1", "_d0", "_h1", "in_0", "k_host", "s0", "a.b")} == {"kept"}
    with pytest.raises(ValueError):
        language.identify(df, spark.range(300).select(F.col("id").cast("string").alias("lang"), F.lit("x").alias("text")))
    assert [got[i]["lang"] for i in (0, 20, 40, 41, 42, 44)] == ["en", "de", "de", "de", "de", "en"]
    assert got[43]["lang"] in ("de", "en") and len(got) == len(rows)
    assert {r["lang"] for r in language.identify(df, labelled.where("false")).collect()} == {None}
    assert language.identify(df.where("false"), labelled).count() == 0


def test_address_parts(spark):
    df = spark.createDataFrame([("https://u@M.Example.de:80/fr/1?x", '<!DOCTYPE html><HTML class="a" LANG=\'pt-BR\'><p>a</p><script>var t="</p>";</script><!-- b -->c'), (None, None), ("nonsense", "x")], "url string, html string")
    got = df.select(language.host_of(F.col("url")), language.address_suffix(F.col("url")), language.declared_language(F.col("html")), language.page_text(F.col("html"))).collect()
    assert tuple(got[0])[:3] == ("m.example.de", "/fr", "pt") and got[0][3].split() == ["a", "c"]
    assert tuple(got[1])[:3] == (None, None, None)
    assert tuple(got[2])[:3] == (None, None, None)


@pytest.mark.parametrize("texts", [[""], ["a"], [None, "ab"], ["  x  y ", "abc"]])
def test_trigrams_do_not_cross_texts(texts):
    cells, owner = language.trigram_cells(texts)
    apart = [language.trigram_cells([t])[0].tolist() for t in texts]
    assert [cells[owner == k].tolist() for k in range(len(texts))] == apart
