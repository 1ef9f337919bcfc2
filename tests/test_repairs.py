"""Inputs that once gave lost, doubled or swapped rows, or ended a job."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from diffsieve.functions.vectors import parse_vector_text
from diffsieve.operators import dense, lexical, rank
from diffsieve.plans.jobs import dataset_job, sequence_job
from diffsieve.sources.files import scan_commits
from diffsieve.streaming.ingest import ingest_incremental


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)


def plain_profile(queries, corpus, batch):
    rows = {}
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1.0)
    cos = {q: np.array([unit(v) @ unit(c) if v is not None and c is not None else 0.0 for _, c in corpus]) for q, v in queries}
    for a in cos:
        for b in cos:
            if a // batch == b // batch:
                n = np.linalg.norm(cos[a]) * np.linalg.norm(cos[b])
                rows[a, b] = cos[a] @ cos[b] / n if n else 0.0
    return rows


@pytest.mark.parametrize("ids", [range(8), range(10_000, 10_008), [-70, -65, -64, -3, 2**60, 2**60 + 31, 2**60 + 32, 2**62]])
def test_profile_of_any_ids(spark, ids):
    rng = np.random.default_rng(0)
    corpus = [(i, rng.normal(size=4).tolist()) for i in range(20)]
    queries = [(int(i), rng.normal(size=4).tolist()) for i in ids]
    got = dense.cosine_profile(spark.createDataFrame(queries, "query_id long, v array<double>"), spark.createDataFrame(corpus, "doc_id long, v array<double>"), 32, q_rows=32, d_rows=8)
    got = {(r["query_id"], r["other_id"]): r["sim"] for r in got.collect()}
    assert got == pytest.approx(plain_profile(queries, corpus, 32))


def test_lexical_profile_of_any_ids(spark):
    texts = [f"alpha beta w{i % 3} x{i}" for i in range(12)]
    corpus = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, diff string")
    index = lexical.build_index(corpus)
    got = []
    for base in (0, 2**62 - 2**62 % 32, -3200):
        q = spark.createDataFrame([(base + i, t, "") for i, t in enumerate(texts)], "query_id long, diff string, ast_seq string")
        got.append({(r["query_id"] - base, r["other_id"] - base): r["sim"] for r in dense.lexical_profile(index, q, 32).collect()})
    assert len(got[0]) == 144 and any(0 < v < 0.99 for v in got[0].values())
    assert got[1] == pytest.approx(got[0]) and got[2] == pytest.approx(got[0])


@pytest.mark.parametrize("q,d", [(None, [1.0, 0.0]), ([1.0, 0.0], None), (None, None)])
def test_null_vectors_score_zero(spark, q, d):
    queries = spark.createDataFrame([(1, q)], "query_id long, v array<double>")
    corpus = spark.createDataFrame([(1, d), (2, d)], "doc_id long, v array<double>")
    assert [(r["doc_id"], r["score"]) for r in dense.cosine_topk(queries, corpus, 2).orderBy("rank").collect()] == [(1, 0.0), (2, 0.0)]


def test_partitions_stay_bounded(spark):
    for nq, nd in ((7_500, 10**10), (10**9, 10**10)):
        qb, db = dense._layout(spark, nq, nd, dense.Q_ROWS, dense.D_ROWS)
        assert dense._partitions(spark, qb * db) <= max(4 * spark.sparkContext.defaultParallelism, 200)


def test_postings_of_other_terms_are_not_shuffled(spark):
    corpus = spark.createDataFrame([(i, f"alpha w{i} x{i} y{i}") for i in range(50)], "doc_id long, diff string")
    q = spark.createDataFrame([(1, "alpha w7", "")], "query_id long, diff string, ast_seq string")
    index = lexical.build_index(corpus)
    one = F.explode(F.array(F.lit(0)))
    rows = dense._lexical_weights(index, q, "query_id", ("diff", "ast_seq"), F.lit(0), F.lit(0), one.alias("q_block"), one.alias("d_bucket"))
    assert rows.where("kind = 2").count() == 51


def test_picks_without_a_corpus_row_stay(spark):
    picks = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "query_id long, doc_id long")
    corpus = spark.createDataFrame([(5, "d")], "doc_id long, diff string")
    for bounded in (True, False):
        got = rank.lookup_payload(picks, corpus, ("diff",), picks_bounded=bounded).orderBy("query_id").collect()
        assert [(r["query_id"], r["retrieved_diff"]) for r in got] == [(1, "d"), (2, None), (3, None)]


TEXTS = {"[0.1, 0.2]": [0.1, 0.2], "0.1,0.2": [0.1, 0.2], "[[0.1],[.2]]": [0.1, 0.2], "[0.1],[0.2]": [0.1, 0.2], "[1., -2e-3]": [1.0, -0.002], " nan ": [0.0, 0.0], None: [0.0, 0.0],
         "[[0.1,0.2]],[[0.3,0.4]]": None, "[0.1] [0.2]": None, "[0.1, null]": None, "[0.1, x]": None, "[0.1": None, "[[0.1],[0.2]": None, "[0.1,,0.2]": None}


def test_vector_texts_are_whole_or_an_error(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    vec, err = parse_vector_text("t", 2)
    for r in df.select("t", vec.alias("v"), err.alias("e")).collect():
        assert r["e"] == (TEXTS[r["t"]] is None), r
        assert (r["v"] is None) if r["e"] else r["v"] == pytest.approx(TEXTS[r["t"]]), r


def test_columns_by_header_in_every_file(spark, tmp):
    put(f"{tmp}/a_commits.csv", "commit_id,diff,message\nc1,\"d,\n1\",m1\n")
    put(f"{tmp}/b_commits.csv", "message,commit_id,author,diff\nm2,c2,me,d2\n")
    put(f"{tmp}/sub/c_commits.csv", "commit_id,diff,message\nc3,d3,m3\n")
    got = sorted(tuple(r) for r in scan_commits(spark, tmp).collect())
    assert got == [("a", "c1", "d,\n1", "m1"), ("b", "c2", "d2", "m2"), ("c", "c3", "d3", "m3")]
    with pytest.raises(Exception):
        scan_commits(spark, tmp, headers="same").collect()


def test_ingest_stops_at_another_header(spark, tmp):
    put(f"{tmp}/in/a_commits.csv", "commit_id,diff,message\nc1,d1,m1\n")
    assert ingest_incremental(spark, f"{tmp}/in", f"{tmp}/out", f"{tmp}/cp") == 1
    put(f"{tmp}/in/b_commits.csv", "author,commit_id,diff\nme,c2,d2\n")
    with pytest.raises(Exception):
        ingest_incremental(spark, f"{tmp}/in", f"{tmp}/out", f"{tmp}/cp")


def test_repeated_commits_long_scripts_and_a_second_run(spark, tmp):
    put(f"{tmp}/c/p_commits.csv", "commit_id,diff,message\nc1,d,m\nc1,d,m\nc2,d,m\nc3,d,m\n")
    put(f"{tmp}/v/p/x_c1_negative.html", "<a><b><c>")
    put(f"{tmp}/v/p/x_c1_positive.html", "<a><c><d>")
    put(f"{tmp}/v/p/x_c2_negative.html", "<a><b><c><d>")
    put(f"{tmp}/v/p/x_c2_positive.html", "<e><f><g><h>")
    put(f"{tmp}/v/p/odd.html", "")
    for _ in range(2):
        sequence_job(spark, f"{tmp}/c", f"{tmp}/v", f"{tmp}/out", quarantine_dir=f"{tmp}/bad", max_edits=3)
        rows = [tuple(r) for r in spark.read.parquet(f"{tmp}/out").select("commit_id", "ast_seq").collect()]
        assert len(rows) == 2 and len(set(rows)) == 1 and rows[0][0] == "c1" and "!" not in rows[0][1]
        bad = sorted((r["commit_id"], r["reason"]) for r in spark.read.parquet(f"{tmp}/bad").collect())
        assert [b for b, _ in bad] == ["c2", "c3", "odd.html"] and "3 edits" in bad[0][1]


def test_dataset_job_keys_and_encodes_once(spark, tmp):
    calls = spark.sparkContext.accumulator(0)

    def encoder(diffs, seqs):
        calls.add(len(diffs))
        return [[float(len(d)), 1.0] for d in diffs]

    rows = [("p", f"c{i % 30}", f"diff {i}", "s", "m") for i in range(40)]
    df = spark.createDataFrame(rows, "project string, commit_id string, diff string, ast_seq string, message string")
    out = dataset_job(spark, [df], f"{tmp}/out", (10, 5, 5), encoder=encoder)
    assert out.count() == 40 == out.select("doc_id").distinct().count()
    assert {r["split"]: r["n"] for r in out.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 10, "valid": 5, "test": 5, "corpus": 20}
    assert calls.value == 40
