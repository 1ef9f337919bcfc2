"""Streaming and block-max top-k against the joined scores, and the term-clustered store."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from diffsieve.operators import blockmax, dense, lexical, streamtop
from diffsieve.operators.rank import minmax_normalize, top_k
from diffsieve.operators.retrieval import bm25_topk, retrieve_hybrid
from diffsieve.sources.index_store import build_index_tables


def tables(spark, n=300, m=25):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(80)]
    text = lambda: " ".join(rng.choices(words, [1 / (i + 1) for i in range(80)], k=rng.randrange(0, 30)))
    vec = lambda: rng.choice([None, [0.0] * 4, [rng.choice([-1.0, 0.5, 2.0]) for _ in range(4)]])
    docs = [(i * 7 - 300, text(), rng.choice(["", text(), None]), "m", vec()) for i in range(n)]
    docs += [(9000 + i, docs[5][1], docs[5][2], "copy", docs[5][4]) for i in range(40)]
    queries = [(i, text(), rng.choice(["", text()]), vec()) for i in range(m)] + [(500, "absent", "", None), (501, None, None, None)]
    c = spark.createDataFrame(docs, "doc_id long, diff string, ast_seq string, message string, v array<float>").repartition(5)
    q = spark.createDataFrame(queries, "query_id long, diff string, ast_seq string, v array<float>")
    return c.na.fill("", ["diff", "ast_seq"]), q.na.fill("", ["diff", "ast_seq"])


def ranked(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())


@pytest.mark.parametrize("fields", [("diff",), ("diff", "ast_seq")])
def test_lexical_forms_agree(spark, tmp, fields):
    c, q = tables(spark)
    idx = build_index_tables(c, tmp, fields=fields, clustered=True, per_file=200, per_block=8)
    want = ranked(top_k(lexical.bm25_scores(lexical.build_index(c, fields=fields), q), 3))
    assert ranked(top_k(lexical.bm25_scores(idx, q), 3)) == want
    assert ranked(streamtop.lexical_topk(idx, q, c, 3)) == want
    assert ranked(blockmax.blockmax_topk(idx.store, q, 3)) == want
    assert ranked(blockmax.blockmax_topk(idx.store, q, 3, seed_postings=1)) == want
    assert ranked(streamtop.lexical_topk(idx, q, c, 3, limit=0)) == want


def test_blockmax_without_broadcasts(spark, tmp, monkeypatch):
    c, q = tables(spark)
    idx = build_index_tables(c, tmp, clustered=True, per_file=300, per_block=8)
    want = ranked(top_k(lexical.bm25_scores(idx, q), 2))
    monkeypatch.setattr(blockmax, "BROADCAST_ROWS", 0)
    assert ranked(blockmax.blockmax_topk(idx.store, q, 2)) == want


def test_blockmax_leaves_postings_unread(spark, tmp):
    rng = random.Random(1)
    docs = [(i, " ".join([f"c{rng.randrange(6)}" for _ in range(12)] + [f"r{rng.randrange(300)}"])) for i in range(1500)]
    c = spark.createDataFrame(docs, "doc_id long, diff string")
    q = spark.createDataFrame([(i, docs[i * 50][1], "") for i in range(20)], "query_id long, diff string, ast_seq string")
    idx = build_index_tables(c, tmp, clustered=True, per_file=1000)
    top, read = blockmax.blockmax(idx.store, q, 2)
    assert ranked(top) == ranked(top_k(lexical.bm25_scores(idx, q), 2))
    a, r = read.agg(F.sum("postings_all"), F.sum("postings_read")).first()
    assert 2 * r < a


def test_a_lookup_reads_the_files_of_its_terms(spark, tmp):
    docs = [(i, f"common t{i:04d}") for i in range(3000)]
    c = spark.createDataFrame(docs, "doc_id long, diff string")
    idx = build_index_tables(c, tmp, clustered=True, per_file=150)
    files = len(idx.store.manifest)
    assert files > 20
    one = spark.createDataFrame([("diff", "t0042")], "field string, term string")
    assert len(idx.store.files_of(one)) == 1
    # a hot term is split over many files, all of which are found
    hot = spark.createDataFrame([("diff", "common")], "field string, term string")
    assert idx.store.postings(hot).where("term = 'common'").count() == 3000
    assert len(idx.store.files_of(hot)) >= 10
    assert idx.store.postings(spark.createDataFrame([("diff", "zzz"), ("other", "a")], "field string, term string")).count() == 0
    # opened again from its folder
    again = build_index_tables(c, tmp, clustered=True)
    assert again.store.manifest == idx.store.manifest


def test_cosine_and_hybrid_forms_agree(spark):
    c, q = tables(spark)
    assert ranked(streamtop.cosine_topk(q, c, 4)) == ranked(dense.cosine_topk(q, c, 4)) == ranked(streamtop.cosine_topk(q, c, 4, limit=0))
    idx = lexical.build_index(c, fields=("diff", "ast_seq"))
    sparse = minmax_normalize(lexical.bm25_scores(idx, q), idx.n_corpus)
    for w_cos, w_lex in ((0.5, 0.5), (0.0, 1.0), (1.0, 0.0)):
        want = ranked(dense.block_topk(q, c, 2, w_cos=w_cos, sparse=sparse, w_sparse=w_lex))
        assert ranked(streamtop.hybrid_topk(idx, q, c, 2, w_cos=w_cos, w_lex=w_lex)) == want
    assert ranked(streamtop.hybrid_topk(idx, q, c, 2, limit=0)) == ranked(streamtop.hybrid_topk(idx, q, c, 2))


def test_small_chunks_and_outer_products(spark, monkeypatch):
    c, q = tables(spark)
    idx = lexical.build_index(c)
    want = ranked(streamtop.hybrid_topk(idx, q, c, 3))
    monkeypatch.setattr(streamtop, "CELLS", 100)
    monkeypatch.setattr(streamtop, "OUTER", 1)
    assert ranked(streamtop.hybrid_topk(idx, q, c, 3)) == want


def test_identical_keys_are_left_out(spark):
    c, q = tables(spark)
    patch = F.concat(F.lit("+++ b/"), "diff")
    c, q = c.withColumn("diff", patch), q.withColumn("diff", patch)
    forms = [sorted(tuple(r) for r in retrieve_hybrid(c, q, mode="all", lexical=x).collect()) for x in ("stream", "block")]
    assert forms[0] == forms[1]


def test_a_large_corpus_is_not_exchanged(spark):
    c, q = tables(spark)
    plan = streamtop.cosine_topk(q, c.repartition(40), 2)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow"):]
    assert below.count("Exchange") == 1  # the test's own repartition


def test_forms_of_the_composed_retrieval(spark, tmp):
    c, q = tables(spark)
    idx = build_index_tables(c, tmp, clustered=True, per_file=500)
    rows = [sorted((tuple(r) for r in bm25_topk(c, q, index=idx, lexical=x).collect()), key=str) for x in ("stream", "blockmax", "block", "join")]
    assert rows[0] == rows[1] == rows[2] == rows[3]


def test_best_keeps_ties_by_key():
    best = streamtop.Best(2, 2)
    best.add(np.array([[1.0, 3.0, 3.0], [-np.inf, 0.0, -np.inf]]), np.array([9, 8, 7]))
    best.add(np.array([[3.0, 1.0], [0.0, 0.0]]), np.array([2, 1]))
    assert list(zip(best.q.tolist(), best.doc.tolist(), best.score.tolist())) == [(0, 2, 3.0), (0, 7, 3.0), (1, 1, 0.0), (1, 2, 0.0)]
