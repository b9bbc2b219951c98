"""The pipeline, stage by stage, each judged on its own input."""

import numpy as np
import pytest

import corpus_pipeline
from cellshift.llm import decontaminate, packing
from cellshift.llm.queries import tokenizer
from cellshift.llm.shared import materialise

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # One document with a benchmark passage, planted.
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    planted = [(900_001, f"plain words around {item} plain words behind"), (900_002, "only words " * 5)]
    rows = [(i, t, "en", "src", len(t)) for i, t in planted]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    out = [materialise(docs)]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], SF)))
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages_keep_the_columns(results):
    for df in results[:-1]:
        assert df.columns == results[0].columns


def test_toxic_documents_go(spark, results):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = ids(results[0]) - ids(results[1])
    assert all(labels.get(i, 1) == 1 for i in gone)


def test_repeated_lines_go(results):
    before = {r["doc_id"]: r["text"] for r in results[1].collect()}
    after = {r["doc_id"]: r for r in results[2].collect()}
    seen: set = set()
    for i in sorted(before):
        words = [" ".join(x.split()) for x in before[i].split("\n")]
        if i in after:
            kept = after[i]["text"].split("\n")
            assert after[i]["n_chars"] == len(after[i]["text"])
            assert not {" ".join(x.split()) for x in kept if x.split()} & seen
        else:
            assert any(words)
        if not set(words) & seen and len(words) == len(set(words)) and all(len(w.split()) < 8 for w in words):
            assert after[i]["text"] == before[i]
        seen |= {w for w in words if w}


def test_benchmark_passages_go(spark, results):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    hit = {r["id"] for r in decontaminate.contamination(results[3], items).where("n_hit > 0").collect()}
    assert 900_001 in ids(results[3]) and 900_001 in hit
    assert ids(results[4]) == ids(results[3]) - hit


def test_packed_tokens_are_those_of_the_documents(results):
    own = packing.encoder(tokenizer())
    parts: dict = {}
    for r in results[5].collect():
        parts.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
    expected = {r["doc_id"]: np.array([*own.encode(r["text"]), 0], "<u4").tobytes() for r in results[4].collect()}
    assert {i: b"".join(x for _, x in sorted(p)) for i, p in parts.items()} == expected


def test_an_empty_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []
