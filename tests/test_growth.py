"""Steps whose memory or shuffle once grew with the batch, or with queries times documents."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from diffsieve.operators import dense, docside, lexical, rank
from diffsieve.sources import tables


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cosine_profile_makes_no_copies_of_the_corpus(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(40)] + [(40, None), (41, [0.0] * 4)]
    c = spark.createDataFrame(rows, "doc_id long, v array<float>")
    # a key that comes twice counts as the sum of its rows
    q = spark.createDataFrame(rows + rows[3:5], "query_id long, v array<float>")
    df = dense.cosine_profile(q, c, 32)
    assert "Generate" not in plan_of(df)
    got = {(r["query_id"], r["other_id"]): r["sim"] for r in df.collect()}
    unit = lambda v: np.zeros(4) if v is None or not any(v) else np.array(v) / np.linalg.norm(v)
    m = np.array([unit(v) for _, v in rows])
    x = m @ m.T
    norm = np.linalg.norm(x, axis=1)
    assert len(got) == 32 * 32 + 10 * 10
    for (a, b), s in got.items():
        assert s == pytest.approx(x[a] @ x[b] / (norm[a] * norm[b]) if norm[a] * norm[b] else 0.0, abs=1e-6)


def test_cosine_profile_of_two_widths_is_an_error(spark):
    c = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0])], "doc_id long, v array<double>")
    with pytest.raises(Exception, match="different widths"):
        dense.cosine_profile(c.withColumnRenamed("doc_id", "query_id"), c.repartition(2, "doc_id")).collect()


def test_tokens_are_counted_in_slices(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SLICE_TOKENS", 10)
    lists = pa.array([["a"] * n for n in (4, 4, 0, 30, 9, 1, 1)], pa.list_(pa.string()))
    parts = list(lexical.token_slices(pa.record_batch([pa.array(range(7)), lists], ["id", "t"]), 1))
    assert [p.num_rows for p in parts] == [3, 1, 2, 1]
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(7))


def test_tokens_are_counted_without_python_workers(spark):
    rows = [(1, "b a B", "x"), (2, None, ""), (3, " ... ", "Z z \u00c9_1"), (None, "q", None), (1, "b a b", "k"), (4, "w1 w2 w1 " * 5000, "w1")]
    df = lexical._doc_counts(spark.createDataFrame(rows, "doc_id long, diff string, ast_seq string"), "doc_id", ("diff", "ast_seq"))
    # nothing of a text passes through Arrow batches, whose size a worker's memory would follow
    plan = plan_of(df)
    assert "Arrow" not in plan and "Python" not in plan
    got = sorted(((r["doc_id"], r["field"], r["dl"], sorted(map(tuple, r["counts"]))) for r in df.collect()), key=str)
    assert got == sorted([(1, "diff", 3, [("a", 1), ("b", 2)]), (1, "ast_seq", 1, [("x", 1)]), (3, "ast_seq", 3, [("z", 2), ("\u00e9_1", 1)]),
                          (None, "diff", 1, [("q", 1)]), (1, "diff", 3, [("a", 1), ("b", 2)]), (1, "ast_seq", 1, [("k", 1)]),
                          (4, "diff", 15000, [("w1", 10000), ("w2", 5000)]), (4, "ast_seq", 1, [("w1", 1)])], key=str)


def corpus(spark):
    docs = [(i, f"alpha beta{' beta' * (i % 3)} w{i % 5} x{i}") for i in range(60)] + [(7, "alpha w2 again")]
    c = spark.createDataFrame(docs, "doc_id long, diff string")
    q = spark.createDataFrame([(i * 9, t, "") for i, t in docs[:20]] + [(9, "w1 w1", ""), (None, "alpha", ""), (900, "none", "")], "query_id long, diff string, ast_seq string")
    return c, q


def test_scores_are_not_shuffled_by_pair(spark, monkeypatch):
    from diffsieve.operators import streamtop
    c, q = corpus(spark)
    idx = lexical.build_index(c)
    want = sorted(map(tuple, lexical.bm25_scores(idx, q, broadcast_rows=0).collect()), key=str)
    df = lexical.bm25_scores(idx, q)
    assert "MapInArrow" in plan_of(df) and "hashpartitioning(query_id" not in plan_of(df)
    assert sorted(map(tuple, df.collect()), key=str) == want
    monkeypatch.setattr(streamtop, "OUTER", 1)
    monkeypatch.setattr(streamtop, "CELLS", 50)
    assert sorted(map(tuple, lexical.bm25_scores(idx, q).collect()), key=str) == want


def test_lexical_profile_in_passes(spark):
    c, q = corpus(spark)
    q = q.where("query_id IS NOT NULL")
    idx = lexical.build_index(c)
    want = {(r[0], r[1]): r[2] for r in dense.profile_similarity(rank.minmax_normalize(lexical.bm25_scores(idx, q), idx.n_corpus), q, 32, n_docs=idx.n_corpus).collect()}
    one = dense.lexical_profile(idx, q, 32)
    assert "Generate" not in plan_of(one)
    ids = q.select("query_id")
    many = docside.profile(idx, ids, lexical.query_terms(q), 32, lexical.K1, lexical.B, limit=500)
    for df in (one, many):
        got = {(r[0], r[1]): r[2] for r in df.collect()}
        assert set(got) == set(want) and len(got) > 60
        assert got == pytest.approx(want, abs=1e-9)


def test_large_query_tables_take_passes(spark):
    from diffsieve.operators import streamtop
    c, q = corpus(spark)
    q = q.where("query_id IS NOT NULL").dropDuplicates(["query_id"])
    v = lambda df, key: df.withColumn("v", F.array(F.col(key) % 5 + 1.0, F.col(key) % 3 - 1.0))
    c, q = v(c.dropDuplicates(["doc_id"]), "doc_id"), v(q, "query_id")
    idx = lexical.build_index(c)
    rows = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())
    for search in (lambda n: streamtop.cosine_topk(q, c, 2, limit=n), lambda n: streamtop.hybrid_topk(idx, q, c, 2, limit=n),
                   lambda n: streamtop.lexical_topk(idx, q, c, 2, limit=n)):
        some = search(400)
        assert "FlatMapCoGroups" not in plan_of(some) and "Generate" not in plan_of(some)
        assert rows(some) == rows(search(streamtop.BROADCAST_BYTES))
    want = rows(rank.top_k(lexical.bm25_scores(idx, q), 2))
    assert rows(rank.top_k(lexical.bm25_scores(idx, q, broadcast_rows=20), 2)) == want
    few = lexical.bm25_scores(idx, q, broadcast_rows=20, best=2)
    assert rows(rank.top_k(few, 2)) == want


def test_searches_ask_every_row(spark):
    from diffsieve.plans import catalog
    sf = "/root/testdata/sf0.001"
    c, q = catalog._search(spark, sf)
    n = c.count()
    assert sorted(r[0] for r in q.select("query_id").collect()) == sorted(r[0] for r in c.select("doc_id").collect())
    # and their statements ask all of them
    for name in ("fuse_scores", "retrieve_hybrid", "retrieve_lexical_only", "retrieve_cosine_only", "exclude_self_match", "same_key_count", "augment", "augment_stream", "exclude_all_identical", "cosine_topk", "cosine_topk_lsh"):
        assert "% 100" not in catalog.SQL[name]
    asked = catalog.QUERIES["retrieve_lexical_only"](spark, sf)
    assert asked.select("query_id").distinct().count() == asked.count() == n
    # profiles still compare all rows
    assert catalog.QUERIES["mixed_profile"](spark, sf).select("query_id").distinct().count() == n


def test_whole_documents_are_scored_without_an_exchange(spark, monkeypatch):
    c, q = corpus(spark)
    c, q = c.dropDuplicates(["doc_id"]), q.where("query_id IS NOT NULL")
    idx = lexical.build_index(c)
    want = sorted(map(tuple, lexical.bm25_scores(idx, q, broadcast_rows=0).collect()))
    monkeypatch.setattr(lexical, "SLICE_TOKENS", 30)
    for rows in (docside.BROADCAST_ROWS, 0):
        monkeypatch.setattr(docside, "BROADCAST_ROWS", rows)
        df = lexical.bm25_scores(idx, q)
        assert "Exchange" not in plan_of(df)
        assert sorted(map(tuple, df.collect())) == want
    # a key that comes twice, or none, is still one document
    twice = c.unionByName(c.where("doc_id < 9")).unionByName(spark.createDataFrame([(None, "alpha"), (None, "w1")], c.schema))
    idx = lexical.build_index(twice)
    assert idx.docs is None
    assert sorted(map(tuple, lexical.bm25_scores(idx, q).collect()), key=str) == sorted(map(tuple, lexical.bm25_scores(idx, q, broadcast_rows=0).collect()), key=str)


def test_postings_are_exchanged_once_for_the_term_store(spark, tmp, monkeypatch):
    from diffsieve.sources import index_store
    plans = []
    write = index_store._write_sorted
    monkeypatch.setattr(index_store, "_write_sorted", lambda df, path: (plans.append(plan_of(df)), write(df, path)))
    c, _ = corpus(spark)
    store = index_store.build_index_tables(c, tmp, clustered=True, per_file=40, per_block=4).store
    assert plans[0].count("Exchange rangepartitioning") == 1
    assert "Exchange hashpartitioning" not in plans[0]
    rows = store.spark.read.parquet(store.path + "/clustered")
    per = rows.groupBy("field", "term", "block").agg(F.max("tfn"), F.count(F.lit(1)))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(store.block_max()) == key(per) and len(key(per)) > 60
    assert len(store.manifest) > 3


def test_a_search_by_vectors_moves_no_text(spark):
    from diffsieve.plans import catalog
    c, q = catalog._vector_search(spark, "/root/testdata/sf0.001")
    whole, asked = catalog._search(spark, "/root/testdata/sf0.001")
    assert c.columns == ["doc_id", "v"] and q.columns == ["query_id", "v"]
    key = lambda df: sorted(map(str, df.collect()))
    assert key(c) == key(whole.select("doc_id", "v")) and key(q) == key(asked.select("query_id", "v"))


@pytest.mark.parametrize("sent", [tables.SENT_KEYS, 0])
def test_texts_without_a_vector_are_not_exchanged(spark, tmp, monkeypatch, sent):
    monkeypatch.setattr(tables, "SENT_KEYS", sent)
    spark.createDataFrame([(i, f"text {i}", "en", "s") for i in [*range(40), 3]] + [(None, "no key", "en", "s")],
                          "doc_id long, text string, lang string, source string").write.parquet(f"{tmp}/documents.parquet")
    spark.createDataFrame([(3, [1.0]), (5, [2.0]), (5, [3.0]), (90, [4.0]), (None, [5.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp}/embeddings.parquet")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        c = tables.corpus(spark, str(tmp))
        assert ("LeftSemi" in plan_of(c)) == (sent > 0)
        assert sorted((r["doc_id"], r["v"][0]) for r in c.collect()) == [(3, 1.0), (3, 1.0), (5, 2.0), (5, 3.0)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_mixed_queries_ask_every_commit_labelled_toxic(spark, tmp):
    # keys that no hundred divides, one of them labelled and one not
    spark.createDataFrame([(i, f"text {i}", "en", "s") for i in (1, 2, 100, 205, 300)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, 0), (100, 1), (205, 1), (999, 1)], "doc_id long, toxic int").write.parquet(f"{tmp}/labels.parquet")
    spark.createDataFrame([(7, "item")], "item_id long, text string").write.parquet(f"{tmp}/benchmark.parquet")
    spark.createDataFrame([(3,)], "n_nationkey int").write.parquet(f"{tmp}/nation.parquet")
    q = tables.mixed_queries(spark, tmp)
    assert sorted(r["query_id"] for r in q.collect()) == [7, 1_000_000_001, 1_000_000_100, 1_000_000_205, 2_000_000_003]


def test_searches_by_vectors_ask_every_row(spark):
    from diffsieve.plans import catalog
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/embeddings.parquet"), F.expr("doc_id = vec_id")).count()
    assert catalog.QUERIES["cosine_topk"](spark, sf).select("query_id").distinct().count() == n
    r = catalog.QUERIES["cosine_topk_lsh"](spark, sf).first()
    assert (r["queries"], r["wanted"], r["recall_90"]) == (n, 2 * n, True)


def test_fused_queries_take_parts(spark, monkeypatch):
    from diffsieve.operators import retrieval
    c, q = corpus(spark)
    v = lambda df, key: df.withColumn("v", F.array(F.col(key) % 5 + 1.0, F.col(key) % 3 - 1.0))
    c = v(c.dropDuplicates(["doc_id"]), "doc_id")
    q = v(q.where("query_id IS NOT NULL").dropDuplicates(["query_id"]), "query_id")
    idx = lexical.build_index(c)
    rows = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())
    want = rows(dense.block_topk(q, c, 2, w_cos=0.5, sparse=rank.minmax_normalize(lexical.bm25_scores(idx, q), idx.n_corpus), w_sparse=0.5))
    assert rows(retrieval.fused_topk(idx, q, c, 2)) == want and len(want) == 2 * q.count()
    asked = []
    scores = retrieval.bm25_scores
    monkeypatch.setattr(retrieval, "bm25_scores", lambda index, own: (asked.append(own.count()), scores(index, own))[1])
    monkeypatch.setattr(retrieval, "PART_QUERIES", 6)
    monkeypatch.setattr(retrieval, "PART_PAIRS", 0)
    assert rows(retrieval.fused_topk(idx, q, c, 2)) == want
    # the hits of a part alone are exchanged at a time, and no query is left out
    assert len(asked) == -(-q.count() // 6) and sum(asked) == q.count()


def test_block_scores_are_those_of_single_postings():
    from diffsieve.operators import streamtop
    rng = np.random.default_rng(3)
    nq, nd, n_terms = 700, 40, 60
    # terms of all queries, of some and of few; a document that holds a term twice
    share = np.r_[np.full(20, 0.9), np.full(20, 0.3), np.full(20, 0.01)]
    who, term = np.nonzero(rng.random((nq, n_terms)) < share)
    q = streamtop.Queries(np.arange(nq), None, None)
    weight = rng.random(len(who)) * 9
    q.set_terms(who, term, weight, n_terms)
    doc, at = np.nonzero(rng.random((nd, n_terms)) < 0.4)
    doc, at = np.r_[doc, doc[:50]], np.r_[at, at[:50]]
    w = rng.random(len(doc)) * 2.0 ** 32
    w[:9] = 1e-3  # rounded to nothing, still a hit
    full = np.zeros((nq, n_terms))
    full[who, term] = weight
    want, met = np.zeros((nq, nd)), np.zeros((nq, nd), bool)
    for d, t, x in zip(doc, at, w):
        want[:, d] += np.floor(full[:, t] * x + 0.5)
        met[:, d] |= full[:, t] > 0
    s, h = streamtop.lexical_block(q, doc, at, w, nd)
    assert (s == want / 2.0 ** 32).all() and (h == met).all()
    products = streamtop.Products(q)
    assert 0 < len(products.weights) < n_terms
    s, h = products.block(doc, at, w, nd)
    assert np.abs(s - want / 2.0 ** 32).max() < 1e-6 and (h == met).all()
    empty = streamtop.lexical_block(q, doc[:0], at[:0], w[:0], 3)
    assert not empty[0].any() and not empty[1].any() and empty[0].shape == (nq, 3)
