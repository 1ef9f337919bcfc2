"""Failure capture, hashed vector search, distributed running sums, streams with repeated keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from diffsieve.functions import structure
from diffsieve.operators import datasets, features, lsh, streamtop
from diffsieve.streaming.ingest import augment_stream


def test_a_failing_dialect_row_is_set_aside(spark):
    def picky(text):
        if "bad" in text:
            raise KeyError(text)
        return list(text)

    df = spark.createDataFrame([(1, "ab"), (2, "bad one"), (3, None), (4, "ba")], "id long, text string")
    good, bad = structure.structure_or_error(df, "text", picky, keep=["a"])
    assert {r["id"]: r["seq"] for r in good.collect()} == {1: ["a"], 3: [], 4: ["a"]}
    assert [(r["id"], r["text"], r["reason"]) for r in bad.collect()] == [(2, "bad one", "KeyError: 'bad one'")]


@pytest.mark.parametrize("batch", [1, 3, 100])
def test_a_failing_encoder_row_is_set_aside(spark, batch):
    def encoder(diffs, seqs):
        if any(d is None for d in diffs):
            raise ValueError("no diff")
        return [[float(len(d)), float(len(s))] for d, s in zip(diffs, seqs)]

    df = spark.createDataFrame([(i, None if i % 5 == 3 else "x" * i, None) for i in range(20)], "id long, diff string, ast_seq string")
    good, bad = features.encode_or_error(df, encoder, batch)
    assert sorted(r["id"] for r in bad.collect()) == [3, 8, 13, 18]
    assert {r["reason"] for r in bad.collect()} == {"ValueError: no diff"}
    assert {r["id"]: r["feature_vector"] for r in good.collect()} == {i: [float(i), 0.0] for i in range(20) if i % 5 != 3}


def test_running_sums_match_and_use_no_single_task(spark):
    rng = random.Random(4)
    rows = [(f"g{i:03d}", rng.randrange(0, 9)) for i in range(300)] + [(None, 5)]
    df = spark.createDataFrame(rows, "g string, n long").repartition(6)
    want, before = {}, 0
    for g, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "")):
        want[g], before = before, before + n
    for parts in (1, 4, 16):
        got = datasets.running_before(df, "g", "n", partitions=parts)
        assert {r["g"]: r["_before"] for r in got.collect()} == want
        assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert datasets.running_before(df.limit(0), "g", "n").count() == 0


def test_splits_have_no_unpartitioned_window(spark):
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    for out in (datasets.split_exact(df, (100, 50, 50)), datasets.split_blocked(df, (100, 50, 50), block=60)):
        assert {r["split"]: r["n"] for r in datasets.split_sizes(out).collect()} == {"train": 100, "valid": 50, "test": 50, datasets.SPLIT_NAMES[3]: 300}
        assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


def test_hashed_search_finds_the_nearest(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 16))
    rows = [(i, (centres[i % 40] + 0.3 * rng.standard_normal(16)).tolist()) for i in range(2000)]
    rows += [(5000 + i, rows[0][1]) for i in range(300)] + [(9000, None), (9001, [0.0] * 16)]
    c = spark.createDataFrame(rows, "doc_id long, v array<double>")
    q = spark.createDataFrame([(i, rows[i * 7][1]) for i in range(60)] + [(99, None)], "query_id long, v array<double>")
    found = lsh.lsh_topk(q, c, 3)
    exact = streamtop.cosine_topk(q.where("v is not null"), c, 3)
    r = lsh.recall(found, exact).agg(F.sum("hit"), F.sum("wanted")).first()
    assert r[0] >= 0.9 * r[1]
    scores = {(x["query_id"], x["doc_id"]): x["score"] for x in exact.collect()}
    both = [(x["score"], scores[x["query_id"], x["doc_id"]]) for x in found.collect() if (x["query_id"], x["doc_id"]) in scores]
    assert both and all(abs(a - b) < 1e-9 for a, b in both)
    assert lsh.lsh_topk(q, c.limit(0), 3).count() == 0


def test_stream_answers_a_key_once_over_batches_and_restarts(spark, tmp):
    lookups = []

    def lookup(batch):
        rows = [r["query_id"] for r in batch.collect()]
        lookups.extend(rows)
        return batch.withColumn("answer", F.col("query_id") * 2)

    for start in (0, 0, 3):
        spark.range(start, start + 5).select(F.col("id").alias("query_id")).coalesce(1).write.mode("append").parquet(tmp + "/q")
        stream = spark.readStream.schema("query_id long").option("maxFilesPerTrigger", 1).parquet(tmp + "/q")
        augment_stream(stream, lookup, tmp + "/out", tmp + "/ck")
    got = sorted((r["query_id"], r["answer"]) for r in spark.read.parquet(tmp + "/out").collect())
    assert got == [(i, 2 * i) for i in range(8)]
    assert sorted(lookups) == list(range(8))
