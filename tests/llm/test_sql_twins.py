"""Queries of the corpus operators give the rows of their SQL twins, on the smallest and on a larger table."""

import glob
import os

import duckdb
import pytest

from tracewarden.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[x] for x in cols)) for r in df.collect())
    cur = c.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == sorted(repr(tuple(r[names.index(x)] for x in cols)) for r in cur.fetchall())


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))


def _compare(spark, name, folder):
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.execute(f"create view {f[:-8]} as select * from '{folder}/{f}/*.parquet'")
    df = QUERIES[name](spark, str(folder))
    cols = sorted(df.columns)
    cur = c.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    want = sorted(repr(tuple(r[names.index(x)] for x in cols)) for r in cur.fetchall())
    assert want and sorted(repr(tuple(r[x] for x in cols)) for r in df.collect()) == want


def test_mixing_twin_where_most_of_a_domain_has_no_weight(spark, tmp_path):
    rows = [(i, "w " * 9 + str(i), "fr" if i % 10 else "en", "source2") for i in range(200)] + [(1000 + i, "v " * 9 + str(i), "en", "source1") for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    _compare(spark, "op1_mix_sources", tmp_path)
    mixed = QUERIES["op1_mix_sources"](spark, str(tmp_path))
    assert mixed.agg({"take": "sum"}).first()[0] == 3750  # all that is budgeted is spent


def test_chat_twin_where_a_turn_is_null(spark, tmp_path):
    rows = [(1, None, "user", "before all"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, None, None, None), (2, 3, "assistant", "[INST] \\ c")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    _compare(spark, "op9_format_chat", tmp_path)
