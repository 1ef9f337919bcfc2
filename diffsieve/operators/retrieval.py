"""Retrieval compositions: lexical top-k (W2) and the hybrid flagship."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffsieve.functions.text import require_columns
from diffsieve.operators import streamtop
from diffsieve.operators.blockmax import blockmax_topk
from diffsieve.operators.dense import block_topk, hybrid_topk, lexical_topk
from diffsieve.operators.lexical import LexicalIndex, bm25_scores, build_index
from diffsieve.functions.text import patch_key_hashes
from diffsieve.operators.rank import (DIGITS, lookup_payload, minmax_normalize,
                                      pick_and_attach, pick_first_distinct, top_k)
from diffsieve.session import materialize, release_shuffles, shared_dir

# A query table up to this many rows (counted first) is broadcast into the joins that
# attach per-query statistics and payload (a few tens of bytes per row), so the corpus
# side is streamed; above it those joins shuffle and AQE re-plans from runtime sizes.
BROADCAST_QUERIES = 200_000


def _prepare_queries(queries: DataFrame, query_key: str, fields) -> DataFrame:
    require_columns(queries, [query_key, *fields])
    return queries.na.fill("", subset=list(fields))


def bm25_topk(corpus: DataFrame, queries: DataFrame, k: int = 2, *,
              index: LexicalIndex | None = None, query_key: str = "query_id",
              fields=("diff",), query_fields=("diff", "ast_seq"),
              payload=("diff", "message"), mode: str = "second",
              lexical: str = "stream") -> DataFrame:
    """Lexical retrieval with the reference's fallback and self-match rules.

    Ranks 1 and 2 by BM25; a missing rank falls back to the smallest corpus key;
    a rank-1 row with the query's own patch key is replaced by rank 2
    (``mode='second'``, as the reference does), or every row with that key is removed
    before ranking (``mode='all'``). Output:
    ``(query_id, doc_id, rank1_id, score, same_key, is_fallback, retrieved_*)``.
    With ``lexical='stream'`` (default for ``mode='second'``) the corpus is streamed once
    past the broadcast queries (``streamtop``; larger query tables go to the blocks);
    ``'blockmax'`` reads the term-clustered postings that bounds can't rule out (``blockmax``,
    for an index built with ``clustered=True``), ``'block'`` takes the shuffled similarity
    blocks and ``'join'`` ranks the joined BM25 table. All give the same rows.
    """
    queries = _prepare_queries(queries, query_key, query_fields)
    corpus = corpus.na.fill("", subset=[c for c in ("diff", "ast_seq") if c in corpus.columns])
    idx = index or build_index(corpus, fields=fields)
    bounded = queries.count() <= BROADCAST_QUERIES
    # the k best rows per query and the picks are small (k rows / one row per query) and
    # each is read by two joins: written once so that no branch recomputes the scoring
    if mode == "all":
        lex = _drop_identical(bm25_scores(idx, queries, query_key, query_fields), queries,
                              corpus, query_key, idx.n_corpus, bounded)
        picks = pick_first_distinct(materialize(top_k(lex, 1), "topk"), queries, corpus,
                                    query_key=query_key, fallback_key=idx.min_key,
                                    queries_bounded=bounded)
        out = lookup_payload(materialize(picks, "picks"), corpus, payload, picks_bounded=bounded)
    else:
        if lexical == "stream":
            top = streamtop.lexical_topk(idx, queries, corpus, k, query_key=query_key, query_fields=query_fields)
        elif lexical == "blockmax":
            top = blockmax_topk(idx.store, queries, k, query_key=query_key, query_fields=query_fields)
        elif lexical == "block":
            top = lexical_topk(idx, queries, k, query_key=query_key, query_fields=query_fields)
        else:
            top = top_k(bm25_scores(idx, queries, query_key, query_fields), k)
        out = pick_and_attach(materialize(top, "topk"), queries, corpus,
                              query_key=query_key, payload=payload, fallback_key=idx.min_key,
                              queries_bounded=bounded)
    return out.withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), DIGITS))


# A corpus identity table (doc key + two hashes, 24 bytes a row) up to this many rows
# is broadcast into the hits; above it the hits are joined by document key.
BROADCAST_DOCS = 1_000_000


def _drop_identical(hits: DataFrame, queries: DataFrame, corpus: DataFrame, query_key: str,
                    n_corpus: int, queries_bounded: bool) -> DataFrame:
    """Hits without the pairs whose document has the query's own non-empty patch key."""
    dk = corpus.select(F.col("doc_id").cast("long").alias("doc_id"),
                       *[c.alias("d" + n) for c, n in zip(patch_key_hashes("diff")[:2], ("pk1", "pk2"))])
    qk = queries.select(F.col(query_key).cast("long").alias("query_id"),
                        *[c.alias("q" + n) for c, n in zip(patch_key_hashes("diff"), ("pk1", "pk2", "set"))])
    h = hits.join(F.broadcast(dk) if n_corpus <= BROADCAST_DOCS else dk, "doc_id")
    h = h.join(F.broadcast(qk) if queries_bounded else qk, "query_id")
    same = (F.col("dpk1") == F.col("qpk1")) & (F.col("dpk2") == F.col("qpk2")) & F.col("qset")
    return h.where(~same).select("query_id", "doc_id", "score")


# ``fused_topk`` takes queries in parts of so many, or of so many (query, document) pairs if those
# are more queries: the table of hits that a part exchanges grows with the corpus alone.
PART_QUERIES = 1024
PART_PAIRS = 100_000_000


def fused_topk(index: LexicalIndex, queries: DataFrame, corpus: DataFrame, k: int = 2, *,
               w_cos: float = 0.5, w_lex: float = 0.5, queries_bounded: bool = False) -> DataFrame:
    """Top ``k`` by ``w_cos * cosine + w_lex * minmax(BM25)`` from the table of all hits (A2, A3, A5).

    A row per hit is exchanged, so shuffled rows grow with queries times documents. The queries
    are therefore taken in parts of bounded size: each part's ``k`` best rows are written and its shuffle
    files deleted before the next one, and the disk holds one part's hits at a time. All
    queries are asked against all documents, whatever the number of parts.
    """
    spark = queries.sparkSession
    n = queries.count()
    parts = max(1, math.ceil(n / max(PART_QUERIES, PART_PAIRS // max(1, index.n_corpus))))
    path = shared_dir(spark, "fused")
    for i in range(parts):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) if parts > 1 else queries
        sparse = minmax_normalize(bm25_scores(index, own), index.n_corpus, broadcast_stats=queries_bounded)
        top = block_topk(own, corpus, k, w_cos=w_cos, sparse=sparse, w_sparse=w_lex, n_docs=index.n_corpus)
        top.write.parquet(f"{path}/part={i}")
        del sparse, top
        release_shuffles(spark)
    return spark.read.parquet(path).drop("part")


def retrieve_hybrid(corpus: DataFrame, queries: DataFrame, k: int = 2, *,
                    w_cos: float = 0.5, w_lex: float = 0.5,
                    index: LexicalIndex | None = None, query_key: str = "query_id",
                    vec: str = "v", fields=("diff",), query_fields=("diff", "ast_seq"),
                    payload=("diff", "ast_seq", "message"), lexical: str = "stream",
                    mode: str = "second") -> DataFrame:
    """Hybrid retrieval: ``w_cos * cosine + w_lex * minmax(BM25)`` over the whole
    corpus, top ``k`` per query, rank-1 self match skipped, payload attached (W4).

    ``w_lex = 0`` gives pure cosine retrieval and ``w_cos = 0`` pure normalised BM25
    over the dense row (the reference's single-signal modes). ``lexical='stream'``
    (default) streams the corpus past the broadcast queries: it is neither copied nor
    shuffled, and query tables over ``streamtop.BROADCAST_BYTES`` go to the blocks.
    ``'block'`` computes BM25 inside the similarity blocks, so no query x document table
    exists; ``'join'`` computes the sparse BM25 table by joins, writes it once
    and feeds it to the blocks. All give the same scores. ``mode='second'`` skips a
    rank-1 self match as the reference does; ``mode='all'`` removes every corpus row
    with the query's own patch key before ranking.
    """
    if w_cos == 0 and w_lex == 0:
        raise ValueError("at least one of cosine or bm25 must be used")
    queries = _prepare_queries(queries, query_key, query_fields)
    corpus = corpus.na.fill("", subset=[c for c in ("diff", "ast_seq") if c in corpus.columns])
    idx = index or build_index(corpus, fields=fields)
    nq = queries.count()
    bounded = nq <= BROADCAST_QUERIES
    excl = "diff" if mode == "all" else None
    if lexical == "stream":
        top = streamtop.hybrid_topk(idx, queries, corpus, k, w_cos=w_cos, w_lex=w_lex, query_key=query_key, vec=vec,
                                    query_fields=query_fields, n_queries=nq, stats_bounded=bounded, exclude_identical=excl)
    elif lexical == "block":
        top = hybrid_topk(idx, queries, corpus, k, w_cos=w_cos, w_lex=w_lex,
                          query_key=query_key, vec=vec, query_fields=query_fields,
                          n_queries=nq, stats_bounded=bounded, exclude_identical=excl)
    else:
        sparse = None
        if w_lex != 0:
            # the hits feed both the per-query statistics and the fused scores: written
            # once instead of joined twice
            lex = materialize(bm25_scores(idx, queries, query_key, query_fields), "bm25")
            sparse = minmax_normalize(lex, idx.n_corpus, broadcast_stats=bounded)
        top = block_topk(queries, corpus, k, query_key=query_key, vec=vec, w_cos=w_cos,
                         sparse=sparse, w_sparse=w_lex, n_queries=nq, n_docs=idx.n_corpus,
                         exclude_identical=excl)
    # the k best rows per query and the picks are small and each feeds two joins:
    # written once so that no branch recomputes the similarity blocks
    top = materialize(top, "topk")
    if mode == "all":
        picks = pick_first_distinct(top, queries, corpus, query_key=query_key,
                                    queries_bounded=bounded)
        out = lookup_payload(materialize(picks, "picks"), corpus, payload, picks_bounded=bounded)
    else:
        # the rank-1 patch keys and the payload come from one pass over the corpus texts
        out = pick_and_attach(top, queries, corpus, query_key=query_key, payload=payload,
                              queries_bounded=bounded)
    return out.withColumn("score", F.round("score", DIGITS))
