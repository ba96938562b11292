"""Hard negatives, whitening and sharding: brute force, messy input, maps that are edited."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewarden.llm import negatives, sharding, whitening
from tracewarden.llm.queries import QUERIES

from .messy import documents, some_documents

SF = "/root/testdata/sf0.001"


def vectors(spark, rows):
    """(vec_id, embedding, label) with columns whose names the operators use."""
    more = "id int, v string, member string, d int, n int, x int, score int, cluster int, component int, `_r` int"
    return spark.createDataFrame([(i, e, y, 3, "q", "m", 1, 2, 3, 4, 5, 6, 7) for i, e, y in rows],
                                 f"vec_id long, embedding array<double>, label int, {more}").repartition(3)


def messy_vectors(seed=1, n=300, d=6):
    """Clusters, one vector that a third of the rows share, ties, other lengths, nulls, non-finite and zero vectors."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, d))
    rows = [(i, (centres[i % 5] + rng.normal(size=d) * 0.3).tolist(), int(rng.integers(0, 3))) for i in range(n)]
    rows += [(1000 + i, [0.5] * d, i % 2) for i in range(n // 2)]
    rows += [(2000 + i, rng.normal(size=3).tolist(), i % 2) for i in range(20)]
    rows += [(3000, None, 1), (3100, [0.0] * d, 1), (3200, [None] * d, 1), (3300, [float("nan")] * d, 0), (3400, [float("inf")] + [1.0] * (d - 1), 0), (3500, [1.0] * d, None),
             (None, [1.0] * d, 1), (3600, [], 1), (3700, [1e5] * d, 0), (3800, [-1e5] * d, 1)]
    return rows


# -- hard negatives ----------------------------------------------------------------------------------------------------

def brute_negatives(rows, anchor, k=5, m=10, low=30, high=90):
    fine = [(i, [math.floor(256 * c) for c in e], y) for i, e, y in rows
            if i is not None and y is not None and e is not None and all(c is not None and math.isfinite(c) for c in e)]
    out = []
    for a, u, y in fine:
        if not anchor(a):
            continue
        scored = sorted((-sum(p * q for p, q in zip(u, v)), i, z) for i, v, z in fine if i != a and len(v) == len(u))
        for s, p, _ in [x for x in scored if x[2] == y][:k]:
            of = [(i, -t) for t, i, z in scored if z != y and low * -s <= -100 * t <= high * -s][:m]
            out += [(a, p, r + 1, i, -s, t) for r, (i, t) in enumerate(of)]
    return sorted(out)


@pytest.mark.parametrize("chunk, seed, per_cluster", [(16, 30, 4), (64, 10, 2), (4096, 4096, 64)])
def test_hard_negatives(spark, chunk, seed, per_cluster):
    rows = messy_vectors()
    got = negatives.hard_negatives(vectors(spark, rows), F.col("id") % 10 == 0, F.col("label"), chunk_rows=chunk, seed_rows=seed, per_cluster=per_cluster)
    got = sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got.collect())
    assert got and got == brute_negatives(rows, lambda i: i % 10 == 0)


def test_hard_negatives_edges(spark):
    run = lambda rows: negatives.hard_negatives(vectors(spark, rows), F.col("id") % 10 == 0, F.col("label")).collect()
    assert run([(1, None, 1)]) == [] and negatives.hard_negatives(vectors(spark, [(1, None, 1)]).where("false"), F.col("id") == 0, F.col("label")).count() == 0
    assert run([(10, [1.0], 1), (11, [2.0], 2)]) == []  # no positive
    few = [(10, [1.0, 0.0], 1), (10, [1.0, 0.0], 1), (11, [1.0, 0.0], 1), (12, [0.5, 0.0], 2), (13, [0.5, 9.0], 2)]
    assert sorted(tuple(r) for r in run(few)) == [(10, 11, 1, 12, 65536, 32768), (10, 11, 2, 13, 65536, 32768)]


def test_walks_end_before_the_list_does(spark, monkeypatch):
    """Where anchors have neighbours, the bound keeps most of the candidates out of the walk."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 3
    rows = [(i, (centres[i % 40] + rng.normal(size=16) * 0.05).tolist(), int(rng.integers(0, 2))) for i in range(4000)]
    seen = []
    real = negatives.walk

    def spy(members, chunks, same_label, k):
        seen.append((same_label, chunks.count()))
        return real(members, chunks, same_label, k)

    monkeypatch.setattr(negatives, "walk", spy)
    got = negatives.hard_negatives(vectors(spark, rows), F.col("id") % 100 == 0, F.col("label"), low=0, high=100, chunk_rows=64, seed_rows=128, per_cluster=1)
    assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == brute_negatives(
        rows, lambda i: i % 100 == 0, low=0, high=100)
    clusters = 40
    assert all(n < 0.25 * clusters * len(rows) for _, n in seen)


def test_products_are_exact():
    u, m = np.array([[2**40, -3]]), np.array([[2**20, 5], [1, 1]])
    assert negatives.products(u, m).tolist() == [[2**60 - 15, 2**40 - 3]]
    with pytest.raises(OverflowError):
        negatives.products(np.array([[2**40]]), np.array([[2**40]]))


# -- whitening ---------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("kind", ["plain", "graded", "rising", "equal pairs", "low rank", "axes", "one row", "constant"])
def test_solver(kind):
    rng = np.random.default_rng(2)
    a = {"plain": lambda: rng.normal(size=(300, 30)), "graded": lambda: rng.normal(size=(300, 30)) * np.logspace(0, -6, 30), "rising": lambda: rng.normal(size=(300, 30)) * np.logspace(-6, 0, 30),
         "equal pairs": lambda: np.vstack([np.kron(np.eye(5), np.diag([1.0, -1.0])) * s for s in (1, -1)]), "low rank": lambda: rng.normal(size=(40, 3)) @ rng.normal(size=(3, 12)),
         "axes": lambda: np.diag(np.arange(1.0, 13.0)), "one row": lambda: rng.normal(size=(1, 5)), "constant": lambda: np.zeros((9, 5))}[kind]()
    d = a.shape[1]
    r = np.zeros((d, d))
    t = whitening.triangle_of(np.array_split(a, 3)) if len(a) > 2 else np.linalg.qr(a, mode="r")
    r[:len(t)] = t
    values, vectors_ = whitening.principal(r, 8)
    want = np.linalg.svd(a, compute_uv=False) ** 2
    assert len(values) == min(8, int((want > 1e-12 * max(want.max(), 1e-300)).sum()))
    assert np.allclose(values, want[:len(values)], rtol=1e-12, atol=0)
    top = max(want.max(), 1e-300)
    assert np.abs(a.T @ (a @ vectors_) - vectors_ * values).max(initial=0) < 1e-12 * top
    assert np.abs(vectors_.T @ vectors_ - np.eye(len(values))).max(initial=0) < 1e-11


def test_qd_finds_small_values_to_high_relative_accuracy():
    # singular values of a graded bidiagonal matrix: their product is the determinant, though they span 30 decades
    diagonal, above = np.logspace(0, -15, 16), np.logspace(-1, -15, 15) * 0.5
    values = whitening.singular_squares(diagonal, above)
    assert math.isclose(np.log(values).sum(), 2 * np.log(diagonal).sum(), rel_tol=1e-13) and (values > 0).all()


def brute_whitening(x):
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in x], dtype=object)
    n, s = len(x), x.sum(axis=0)
    c = ((x * n - s) / n).astype(float)
    values, vectors_ = np.linalg.eigh(c.T @ c / n)
    values, vectors_ = values[::-1][:8], vectors_[:, ::-1][:, :8]
    return c @ vectors_ / np.sqrt(values), values / np.square(c).sum() * n, ((x * n - s) ** 2).sum(axis=1)


def test_whitening(spark):
    rng = np.random.default_rng(7)
    mix = rng.normal(size=(12, 12)) * np.linspace(1, 3, 12)
    fine = [(i, (rng.normal(size=12) @ mix).tolist(), 1) for i in range(500)]
    fine += [(9, fine[9][1], 1), (None, fine[3][1], None)]
    bad = [(600, None, 1), (601, [None] * 12, 1), (602, [float("nan")] * 12, 1), (603, [float("inf")] * 12, 1), (604, [], 1)]
    other = [(700 + i, rng.normal(size=2).tolist(), 1) for i in range(9)] + [(800, [1.0, 2.0, 3.0], 0)]
    got = whitening.whiten(vectors(spark, fine + bad + other)).toPandas()
    z, explained, deviation = brute_whitening([v for _, v, _ in fine])
    mine = got[got.n == len(fine)]
    assert len(mine) == 8 * len(fine) and set(mine.component) == set(range(1, 9))
    assert len(got) == len(mine) + 2 * 9  # a single vector of its length has no component
    wide = mine[mine.id.notna() & (mine.id != 9)].pivot(index="id", columns="component", values="whitened")
    ref = {i: row for (i, _, _), row in zip(fine, z)}
    ref = np.array([ref[int(i)] for i in wide.index])
    signs = np.sign((wide.to_numpy() * ref).sum(axis=0))
    assert np.abs(wide.to_numpy() - ref * signs).max() < 1e-9
    assert np.allclose(mine.groupby("component").explained.first(), explained, rtol=1e-10) and mine.identity_error.max() < 1e-9
    assert {int(i): int(x) for i, x in zip(mine.id.fillna(-1), mine.deviation)} == {(-1 if i is None else i): x for (i, _, _), x in zip(fine, deviation)}
    assert whitening.whiten(vectors(spark, fine).where("false")).count() == 0


def test_whitening_query(spark):
    got = QUERIES["op12_whiten"](spark, SF).toPandas()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    z, explained, deviation = brute_whitening([[float(c) for c in v] for v in table.embedding])
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[table.vec_id].to_numpy()
    assert np.abs(wide - z * np.sign((wide * z).sum(axis=0))).max() < 1e-9
    assert (got.drop_duplicates("vec_id").set_index("vec_id").loc[table.vec_id].deviation.to_numpy() == deviation.astype(np.int64)).all()
    assert np.allclose(got.groupby("component").explained.first(), explained, rtol=1e-10) and got.identity_error.max() < 1e-9


def test_sums_beyond_64_bits():
    x = np.array([[2**61], [2**61], [-(2**61)]], dtype=np.int64)
    assert whitening.centred(x, 3, [2**61]).tolist() == [[2**62], [2**62], [-(2**63)]]


# -- sharding ----------------------------------------------------------------------------------------------------------

def size_of(text):
    return len((text or "").encode()) + 1


def test_shards_are_even(spark):
    rows = some_documents()
    out, slot_map = sharding.shard_records(documents(spark, rows), 4)
    got = out.collect()
    want = sorted(((i, size_of(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows), key=repr)
    assert sorted(((r["id"], r["size"], r["crc"]) for r in got), key=repr) == want
    for s in range(4):
        assert sorted(r["position"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    load = [sum(r["size"] for r in got if r["shard"] == s) for s in range(4)]
    total, largest = sum(load), max(r["size"] for r in got)
    assert max(load) <= max(largest, total / 4 + 1000)  # one text is larger than a fair share here
    assert {(r["slot"], r["piece"]): r["shard"] for r in got}.items() <= {(r["slot"], r["piece"]): r["shard"] for r in slot_map.collect()}.items()


def test_query_is_near_equal(spark):
    got = QUERIES["op13_shard"](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    assert sorted(zip(got.doc_id, got["size"], got.text_crc32)) == sorted((i, size_of(t), zlib.crc32((t or "").encode())) for i, t in zip(docs.doc_id, docs.text))
    load = got.groupby("shard")["size"].sum()
    assert set(load.index) == set(range(16)) and load.max() - load.min() <= 0.02 * load.mean()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard")) and set(got.law) == {"bytes"} and got.grown_shard.isna().all()


def test_repeated_records_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GRAIN_ROWS", 100)
    df = spark.createDataFrame([(7, "same text")] * 3000 + [(i, f"text {i}") for i in range(3000)] + [(None, None)] * 2000, "doc_id long, text string").repartition(3)
    out, _ = sharding.shard_records(df, 8)
    got = out.toPandas()
    load = got.groupby("shard")["size"].sum()
    assert len(got) == 8000 and load.max() - load.min() <= 0.1 * load.mean()
    assert all(sorted(g.position) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert got[got.id == 7].shard.nunique() > 1


def test_maps_are_edited_by_version(spark, tmp_path):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, "w" * rng.randrange(1, 400)) for i in range(4000)], "doc_id long, text string")
    path = f"{tmp_path}/map"
    first = sharding.first_map(spark, 8, 512)
    sharding.save_map(first, path)
    out, second = sharding.shard_records(docs, 8, slots=512, old=sharding.load_map(spark, path))
    sharding.save_map(second, path)
    more = docs.unionByName(spark.createDataFrame([(10_000 + i, "v" * 300) for i in range(500)], "doc_id long, text string"))
    grown, third = sharding.shard_records(more, 9, slots=512, old=sharding.load_map(spark, path))
    sharding.save_map(third, path)
    assert [sharding.load_map(spark, path, v).count() for v in (1, 2, 3)] == [512] * 3
    home = {v: {r["slot"]: r["shard"] for r in sharding.load_map(spark, path, v).collect()} for v in (1, 2, 3)}
    assert sum(home[1][s] != home[2][s] for s in range(512)) < 128
    moved = [s for s in range(512) if home[2][s] != home[3][s]]
    load = grown.groupBy("shard").agg(F.sum("size").alias("b")).toPandas().b
    assert len(load) == 9 and load.max() <= 1.02 * load.mean()
    # no more leaves a shard than it has too much, but for one slot
    before = {s: 0 for s in range(9)}
    left = dict(before)
    sizes = {r["slot"]: r["b"] for r in grown.groupBy("slot").agg(F.sum("size").alias("b")).collect()}
    for s, b in sizes.items():
        before[home[2][s]] += b
        left[home[2][s]] += b * (s in moved)
    assert all(left[s] <= max(0, before[s] - load.mean()) + max(sizes.values()) for s in range(9))
    # fewer shards: all that lay beyond moves, and nothing is lost
    back, _ = sharding.shard_records(more, 5, slots=512, old=sharding.load_map(spark, path))
    assert back.agg(F.max("shard")).first()[0] == 4 and back.count() == 4500


def test_written_shards_hold_every_record(spark, tmp_path):
    docs = documents(spark, some_documents()).withColumn("shard", F.lit("x"))
    _, slot_map = sharding.shard_records(docs, 4)
    sharding.write_shards(docs, slot_map, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted(back.drop("_shard").columns) == sorted(docs.columns)
    assert sorted(map(repr, back.select(*docs.columns).collect())) == sorted(map(repr, docs.collect()))


def test_sharding_nothing(spark):
    out, slot_map = sharding.shard_records(documents(spark, []).where("false"), 4)
    assert out.count() == 0 and slot_map.count() == sharding.SLOTS
