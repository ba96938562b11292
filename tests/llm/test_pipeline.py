"""The pipeline's stages against what each must do with its own input."""

import re

import corpus_pipeline

from .messy import documents, some_documents
from .test_native import base_spans, brute_hits
from .test_pairs_and_scores import brute_components

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "benchmark decontamination", "secret scan", "mixing"]
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
        seen.append((before.collect(), docs.collect(), docs.columns))
    rows = lambda x: [(r["doc_id"], r["text"], None, None) for r in x]
    assert all(c == columns for _, _, c in seen[:4])
    before, after, _ = seen[1]
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, _, c in brute_components(rows(before), 5, 80) if i == c)
    before, after, _ = seen[2]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, _, h, _ in brute_hits(rows(before), bench) if not h)
    before, after, _ = seen[3]
    texts = {r["doc_id"]: r["text"] for r in after}
    assert len(before) == len(after)
    for r in before:
        assert (texts[r["doc_id"]] == r["text"]) == (not base_spans(r["text"])) and not base_spans(texts[r["doc_id"]])
    before, after, _ = seen[4]
    source = {r["doc_id"]: r["text"] for r in before}
    assert after and all(r["text"] == source[r["doc_id"]] or r["take"] < r["n_tokens"] == len(re.findall(r"[^\x20\x09-\x0d]+", source[r["doc_id"]])) for r in after)


def test_stages_on_messy_rows(spark):
    """Null ids and texts, blanks, a repeated row, a very long text and columns that the operators use themselves go through every stage but the last unharmed."""
    rows = some_documents()
    docs = documents(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        got = out.select("doc_id", "text").collect() if name == "mixing" else out.collect()
        assert stage(spark, docs.where("false"), SF).count() == 0
        if name == "mixing":
            assert got and all(r["text"].split() for r in got)
            continue
        assert out.columns == docs.columns
        kept = [(r["doc_id"], r["text"]) for r in got]
        assert {(20, None), (21, ""), (None, None)} <= set(kept)
        if name == "near duplicates":
            assert sorted(i for i, _ in kept if i is not None) == sorted(i for i, _, c in brute_components(rows, 5, 80) if i is not None and i == c)
        elif name == "secret scan":
            assert len(kept) == len(rows)
            assert all((r["n_chars"] is None) == (r["text"] is None) for r in got)
