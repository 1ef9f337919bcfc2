"""The pipeline against plain versions of its stages, odd tables, and the entry without the optional parts."""

import importlib.util
import os

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from diffsieve.llm import registry

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def entry():
    spec = importlib.util.spec_from_file_location("entry_of_llm_tests", os.path.join(ROOT, "__spark_entry__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "pii_surrogates", "best_fit_packing"]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        if name == "best_fit_packing":
            break
        assert out.dtypes == docs.dtypes
        now = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "language_id":
            assert len(now) > 0.98 * len(texts) and now.items() <= texts.items()
        elif name == "ngram_jaccard_join":
            assert now == {i: t for i, t in texts.items() if brute.jaccard(texts.items())[i][1] == i} if len(texts) < 50 else set(now) == {c for _, c in brute.jaccard(texts.items()).values()}
        elif name == "benchmark_decontamination":
            assert set(now) == {x[0] for x in brute.contamination(texts.items(), bench) if not x[5]}
        else:
            assert set(now) == set(texts)
            assert out.where(F.col("n_chars") != F.char_length("text")).count() == 0
        docs, texts = out, now
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == set(texts)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 4096


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 100


def test_odd_tables(spark, with_null_id, empty):
    for stage in ("language_id", "ngram_jaccard_join", "benchmark_decontamination", "pii_surrogates"):
        done = dict(corpus_pipeline.STAGES)[stage](spark, with_null_id, SF)
        assert done.columns == with_null_id.columns and done.count() > 0
        assert dict(corpus_pipeline.STAGES)[stage](spark, empty, SF).count() == 0
    assert dict(corpus_pipeline.STAGES)["best_fit_packing"](spark, with_null_id, SF).select("doc_id").distinct().count() == 12


def test_entry_with_and_without_the_optional_parts(entry, monkeypatch):
    names = set(entry.queries())
    assert set(registry.QUERIES) | {"pipeline"} <= names
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES) == list(range(1, 14))
    monkeypatch.setattr(entry, "_present", lambda *path: False)
    assert set(entry.queries()) == names - set(registry.QUERIES) - {"pipeline"}
