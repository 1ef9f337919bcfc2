import pytest
import math

import numpy as np
from pyspark.sql import functions as F

from diffsieve.functions.text import patch_key
from diffsieve.functions.vectors import flatten_vector
from diffsieve.operators import dense, lexical, rank, retrieval

# FIXTURES.md 2.3 (the reference's 4-row sample corpus and 3 queries)
CORPUS = [
    (0, "This is the first diff" + "/" * 45, "AST1" + "/" * 27, [[0.4, 0.5, 0.6]] * 3, "Message1" + "/" * 29),
    (1, "This is the second diff", "AST2", [[0.7, 0.8, 0.9]] * 3, "Message2"),
    (2, "This is the third diff", "AST3", [[0.7, 0.8, 0.9]] * 3, "Message3"),
    (3, "This is the fourth diff", "AST4", [[1.0, 1.1, 1.2]] * 3, "Message4"),
]
QUERIES = [
    (0, "This is the first diff", "AST1", [[0.7, 0.8, 0.9]] * 3),
    (1, "This is the second diff", "AST2", [[0.7, 0.8, 0.9]] * 3),
    (2, "This is a new diff", "AST5", [[1.0, 1.1, 1.2]] * 3),
]
BM25 = {0: [.738825, .191565, .191565, .191565], 1: [.191565, .738825, .191565, .191565],
        2: [.143673] * 4}
MINMAX = {0: [1, 0, 0, 0], 1: [0, 1, 0, 0], 2: [0, 0, 0, 0]}
COS = {0: [.998191, 1, 1, .999619], 1: [.998191, 1, 1, .999619], 2: [.99615, .999619, .999619, 1]}


def _frames(spark):
    c = spark.createDataFrame(CORPUS, "doc_id long, diff string, ast_seq string, "
                                      "fv array<array<float>>, message string")
    q = spark.createDataFrame(QUERIES, "query_id long, diff string, ast_seq string, fv array<array<float>>")
    return (c.withColumn("v", flatten_vector("fv")).drop("fv"),
            q.withColumn("v", flatten_vector("fv")).drop("fv"))


def _dense(df, col="score"):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, {})[r.doc_id] = r[col]
    return out


def test_bm25_golden(spark):
    c, q = _frames(spark)
    idx = lexical.build_index(c)
    s = _dense(lexical.bm25_scores(idx, q))
    for qid, want in BM25.items():
        for d, w in enumerate(want):
            assert round(s[qid].get(d, 0.0), 6) == w
    n = _dense(rank.minmax_normalize(lexical.bm25_scores(idx, q), idx.n_corpus))
    for qid, want in MINMAX.items():
        assert [round(n[qid].get(d, 0.0), 6) for d in range(4)] == want


def test_cosine_golden(spark):
    c, q = _frames(spark)
    t = dense.cosine_topk(q, c, 4)
    s = _dense(t)
    for qid, want in COS.items():
        assert [round(s[qid][d], 6) for d in range(4)] == want


def test_hybrid_golden(spark):
    c, q = _frames(spark)
    r = {x.query_id: x for x in retrieval.retrieve_hybrid(c, q).collect()}
    assert [r[i].doc_id for i in range(3)] == [0, 1, 3]
    assert not any(r[i].same_key for i in range(3))
    assert r[3 - 3].retrieved_message.startswith("Message1")


def test_single_signal_modes(spark):
    c, q = _frames(spark)
    cos_only = {x.query_id: x.doc_id for x in retrieval.retrieve_hybrid(c, q, w_lex=0).collect()}
    # cosine ties (keys 1 and 2 both 1.0) go to the smaller key
    assert cos_only == {0: 1, 1: 1, 2: 3}
    lex_only = {x.query_id: x.doc_id for x in retrieval.retrieve_hybrid(c, q, w_cos=0).collect()}
    # query 2 normalises to all zeros: the first corpus row wins
    assert lex_only == {0: 0, 1: 1, 2: 0}


def test_patch_key(spark):
    df = spark.createDataFrame([("aa +++ b/x\ny",), ("no marker",), (None,)], "t string")
    assert [r.k for r in df.select(patch_key("t").alias("k")).collect()] == ["+++ b/xy", "", ""]


def test_self_match_exclusion(spark):
    rows = [(i, f"diff --git\n+++ b/p{i % 3}\nword{i} common text", [float(i + 1), 1.0]) for i in range(12)]
    c = spark.createDataFrame([(i, d, "", v, f"m{i}") for i, d, v in rows],
                              "doc_id long, diff string, ast_seq string, v array<float>, message string")
    q = c.select(F.col("doc_id").alias("query_id"), "diff", "ast_seq", "v")
    r = retrieval.retrieve_hybrid(c, q).collect()
    assert all(x.same_key and x.rank1_id == x.query_id and x.doc_id != x.query_id for x in r)


def _brute_topk(qv, dv, k):
    out = {}
    for qi, a in qv.items():
        sc = []
        for di, b in dv.items():
            na, nb = np.linalg.norm(a), np.linalg.norm(b)
            sc.append((-(a @ b / (na * nb)) if na and nb else 0.0, di))
        out[qi] = [d for _s, d in sorted(sc)[:k]]
    return out


def test_block_layouts_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    dv = {i: rng.normal(size=8).round(1) for i in range(300)}
    dv[5] = dv[6].copy()  # exact tie: smaller key first
    dv[7] = np.zeros(8)   # zero vector: cosine 0
    qv = {i: rng.normal(size=8).round(1) for i in range(40)}
    c = spark.createDataFrame([(i, v.tolist()) for i, v in dv.items()], "doc_id long, v array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in qv.items()], "query_id long, v array<double>")
    want = _brute_topk(qv, dv, 3)
    for qr, dr in [(512, 2048), (7, 50), (1, 1)]:
        t = dense.cosine_topk(q, c, 3, q_rows=qr, d_rows=dr)
        got = {}
        for r in t.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.doc_id)
        assert got == want, (qr, dr)


def test_salted_and_shuffled_paths_equal(spark):
    from diffsieve.sources import tables as T
    sf = "/root/testdata/sf0.001"
    c, q = T.commits(spark, sf), T.benchmark_queries(spark, sf)
    base = {(r.query_id, r.doc_id): r.score for r in
            lexical.bm25_scores(lexical.build_index(c), q).collect()}
    salted = lexical.build_index(c, salt_rows=3)  # every frequent term spread over salts
    assert salted.terms.where("n_salt > 1").count() > 0
    for bc in (0, 10**9):
        other = {(r.query_id, r.doc_id): r.score for r in
                 lexical.bm25_scores(salted, q, broadcast_rows=bc).collect()}
        assert other == base


def test_idf_formula():
    assert math.isclose(lexical.idf_value(4, 1), math.log(1 + 3.5 / 1.5))


def test_hybrid_block_and_join_paths_equal(spark):
    from diffsieve.sources import tables as T
    c = T.corpus(spark, "/root/testdata/sf0.001")
    q = c.select(F.col("doc_id").alias("query_id"), "diff", "ast_seq", "v")
    idx = lexical.build_index(c)
    want = {(r.query_id, r.doc_id, r.score, r.same_key) for r in
            retrieval.retrieve_hybrid(c, q, index=idx, lexical="join").collect()}
    for qr, dr in [(512, 2048), (7, 40)]:
        top = dense.hybrid_topk(idx, q, c, 2, q_rows=qr, d_rows=dr)
        ref = dense.block_topk(q, c, 2, w_cos=0.5, w_sparse=0.5, n_docs=idx.n_corpus, q_rows=qr,
                               d_rows=dr, sparse=rank.minmax_normalize(lexical.bm25_scores(idx, q),
                                                                       idx.n_corpus))
        a = {(r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in top.collect()}
        b = {(r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in ref.collect()}
        assert a == b
    got = {(r.query_id, r.doc_id, r.score, r.same_key) for r in
           retrieval.retrieve_hybrid(c, q, index=idx).collect()}
    assert got == want


def test_hybrid_salted_index_same_result(spark):
    from diffsieve.sources import tables as T
    c = T.corpus(spark, "/root/testdata/sf0.001")
    q = c.select(F.col("doc_id").alias("query_id"), "diff", "ast_seq", "v")
    base = {(r.query_id, r.doc_id) for r in retrieval.retrieve_hybrid(c, q).collect()}
    salted = lexical.build_index(c, salt_rows=5)
    assert {(r.query_id, r.doc_id) for r in
            retrieval.retrieve_hybrid(c, q, index=salted).collect()} == base


def test_mode_all_skips_every_copy(spark):
    # doc 0..2 are copies (same patch key); docs 3.. differ
    rows = [(i, "diff\n+++ b/p\nsame words here", [1.0, 0.0]) for i in range(3)]
    rows += [(i, f"diff\n+++ b/q{i}\nsame words there", [0.9, 0.1 * i]) for i in range(3, 8)]
    c = spark.createDataFrame([(i, d, "", v, f"m{i}") for i, d, v in rows],
                              "doc_id long, diff string, ast_seq string, v array<float>, message string")
    q = c.where("doc_id = 0").select(F.col("doc_id").alias("query_id"), "diff", "ast_seq", "v")
    second = retrieval.retrieve_hybrid(c, q).first()
    assert second.same_key and second.doc_id in (1, 2)  # rank 2 is another copy
    for lex in ("block", "join"):
        every = retrieval.retrieve_hybrid(c, q, mode="all", lexical=lex).first()
        assert every.same_key and every.doc_id >= 3
    lexical_all = retrieval.bm25_topk(c, q, mode="all").first()
    assert lexical_all.doc_id >= 3 and lexical_all.same_key


def test_index_tables_reuse_and_rebuild(spark, tmp):
    from diffsieve.sources.index_store import build_index_tables
    c, _q = _frames(spark)
    a = build_index_tables(c, tmp + "/idx")
    files = sorted(a.terms.inputFiles())
    b = build_index_tables(c, tmp + "/idx")  # same corpus: tables reused, not rewritten
    assert sorted(b.terms.inputFiles()) == files
    assert b.stats == a.stats and b.n_corpus == 4
    changed = c.union(c.where("doc_id = 3").withColumn("doc_id", F.lit(9).cast("long")))
    d = build_index_tables(changed, tmp + "/idx")  # fingerprint differs: a folder of its own
    assert d.n_corpus == 5 and not set(d.terms.inputFiles()) & set(files)


def test_two_field_index(spark):
    c, q = _frames(spark)
    one = _dense(lexical.bm25_scores(lexical.build_index(c, fields=("diff",)), q))
    two = _dense(lexical.bm25_scores(lexical.build_index(c, fields=("diff", "ast_seq")), q))
    # "ast1" only matches the ast_seq field of key 0: the second field adds to that score
    assert two[0][0] > one[0][0]
    assert round(two[1][1], 6) > round(one[1][1], 6)


def test_edge_cases_empty_and_null(spark):
    c, q = _frames(spark)
    empty_q = q.limit(0)
    assert retrieval.retrieve_hybrid(c, empty_q).count() == 0
    assert retrieval.bm25_topk(c, empty_q).count() == 0
    # an empty corpus: every query gets a row without a match
    r = retrieval.retrieve_hybrid(c.limit(0), q).collect()
    assert len(r) == 3 and all(x.doc_id is None for x in r)
    # null vectors score cosine 0 instead of failing
    cn = c.withColumn("v", F.when(F.col("doc_id") == 3, F.lit(None)).otherwise(F.col("v")))
    got = {x.query_id: x.doc_id for x in retrieval.retrieve_hybrid(cn, q, w_lex=0).collect()}
    assert got[2] in (1, 2)


def test_cosine_profile_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    dv = {i: rng.normal(size=6) for i in range(90)}
    qv = {i: rng.normal(size=6) for i in range(70)}
    qv[5] = np.zeros(6)
    c = spark.createDataFrame([(i, v.tolist()) for i, v in dv.items()], "doc_id long, v array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in qv.items()], "query_id long, v array<double>")

    def unit(x):
        n = np.linalg.norm(x)
        return x / n if n else x
    D = np.array([unit(dv[i]) for i in range(90)])
    C = {i: D @ unit(qv[i]) for i in qv}
    for qr, dr in [(512, 2048), (64, 20)]:
        got = {(r.query_id, r.other_id): r.sim for r in
               dense.cosine_profile(q, c, 32, q_rows=qr, d_rows=dr).collect()}
        assert len(got) == 32 * 32 * 2 + 6 * 6
        for (a, b), s in got.items():
            x, y = C[a], C[b]
            want = float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y))) if x.any() and y.any() else 0.0
            assert abs(s - want) < 1e-9


def test_fused_pick_equals_separate_operators(spark):
    rows = [(i, f"diff\n+++ b/p{i % 4}\nword{i % 5} common text", [float(i % 3 + 1), 1.0])
            for i in range(24)]
    c = spark.createDataFrame([(i, d, "", v, f"m{i}") for i, d, v in rows],
                              "doc_id long, diff string, ast_seq string, v array<float>, message string")
    q = c.select(F.col("doc_id").alias("query_id"), "diff", "ast_seq", "v")
    idx = lexical.build_index(c)
    for top, fb in [(rank.top_k(lexical.bm25_scores(idx, q), 2), idx.min_key),
                    (dense.hybrid_topk(idx, q, c, 2), None)]:
        a = rank.lookup_payload(rank.pick_with_exclusion(top, q, c, fallback_key=fb), c)
        b = rank.pick_and_attach(top, q, c, fallback_key=fb)
        key = ["query_id", "doc_id", "rank1_id", "score", "same_key", "is_fallback",
               "retrieved_diff", "retrieved_message"]
        assert {tuple(r) for r in a.select(*key).collect()} == {tuple(r) for r in b.select(*key).collect()}
        assert b.where("same_key").count() > 0


def test_lexical_profile_equals_score_table_profile(spark):
    from diffsieve.sources import tables as T
    sf = "/root/testdata/sf0.001"
    c, q = T.commits(spark, sf), T.benchmark_queries(spark, sf)
    idx = lexical.build_index(c)
    want = {(r.query_id, r.other_id): r.sim for r in dense.profile_similarity(
        rank.minmax_normalize(lexical.bm25_scores(idx, q), idx.n_corpus), q, 32,
        n_docs=idx.n_corpus).collect()}
    for qr, dr in [(512, 2048), (32, 40)]:
        got = {(r.query_id, r.other_id): r.sim for r in
               dense.lexical_profile(idx, q, 32, q_rows=qr, d_rows=dr).collect()}
        assert set(got) == set(want)
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_layout_bounds_groups(spark):
    import math
    for nq, nd in [(1, 1), (40, 1000), (2000, 2000), (7500, 10**8), (10**6, 10**6)]:
        qb, db = dense._layout(spark, nq, nd, 512, 2048)
        assert math.ceil(nq / qb) <= 512 and math.ceil(nd / db) <= 2048
        assert qb <= max(nq, 1) and db <= max(nd, 1)


def test_hash_features_zero_rows(spark):
    from diffsieve.operators.features import hash_features
    df = spark.createDataFrame([(1, "alpha beta alpha"), (2, "!!! ..."), (3, None)],
                               "doc_id long, diff string")
    v = {r.doc_id: r.v for r in hash_features(df, "diff", 8).collect()}
    assert len(v) == 3 and all(len(x) == 8 for x in v.values())
    assert sum(x * x for x in v[1]) == pytest.approx(1.0, abs=1e-6)
    assert v[2] == [0.0] * 8 and v[3] == [0.0] * 8


def test_lexical_topk_equals_join_path(spark):
    from diffsieve.sources import tables as T
    sf = "/root/testdata/sf0.001"
    c, q = T.commits(spark, sf), T.benchmark_queries(spark, sf)
    idx = lexical.build_index(c)
    want = {(r.query_id, r.rank, r.doc_id, r.score) for r in rank.top_k(lexical.bm25_scores(idx, q), 2).collect()}
    for qr, dr in [(512, 2048), (8, 30)]:
        got = {(r.query_id, r.rank, r.doc_id, r.score) for r in
               dense.lexical_topk(idx, q, 2, q_rows=qr, d_rows=dr).collect()}
        assert got == want
    a = {tuple(r) for r in retrieval.bm25_topk(c, q, index=idx).collect()}
    b = {tuple(r) for r in retrieval.bm25_topk(c, q, index=idx, lexical="join").collect()}
    assert a == b


def test_bm25_topk_fallback_both_paths(spark):
    c, _q = _frames(spark)
    q = spark.createDataFrame([(10, "zzz qqq", ""), (11, "fourth", ""), (12, "This is the second diff", "")],
                              "query_id long, diff string, ast_seq string")
    for lex in ("block", "join"):
        r = {x.query_id: x for x in retrieval.bm25_topk(c, q, lexical=lex).collect()}
        # no hit at all: row 0 (smallest key) as a fallback, score 0
        assert r[10].doc_id == 0 and r[10].is_fallback and r[10].score == 0.0
        # one hit: rank 1 is that hit
        assert r[11].doc_id == 3 and not r[11].is_fallback
        assert r[12].doc_id == 1 and r[12].score == 0.738825
