"""Score normalisation, fusion, top-k, self-match exclusion, payload.

Every ranking orders by score descending and then by key ascending, so a result never
depends on partitioning. Scores are reported rounded to ``DIGITS`` decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffsieve.functions.text import patch_key

DIGITS = 6


def minmax_normalize(scores: DataFrame, n_corpus: int, broadcast_stats: bool = False) -> DataFrame:
    """Per-query min-max of a sparse score table to [0, 1] (A3).

    The reference normalises the dense row, where every corpus row without a hit holds
    0, so the minimum is 0 unless all ``n_corpus`` rows were hit. A row whose maximum
    equals its minimum becomes all zeros. The per-query statistics come from a partial
    + final aggregate; they are joined back by broadcast when the caller has counted the
    queries and passes ``broadcast_stats=True``, so the hit table itself is never
    shuffled by query.
    """
    st = (scores.groupBy("query_id")
          .agg(F.max("score").alias("mx"), F.min("score").alias("mn0"),
               F.count(F.lit(1)).alias("hits"))
          .select("query_id", "mx",
                  F.when(F.col("hits") < F.lit(n_corpus), F.lit(0.0))
                  .otherwise(F.col("mn0")).alias("mn")))
    if broadcast_stats:
        st = F.broadcast(st)
    span = F.col("mx") - F.col("mn")
    return (scores.join(st, "query_id")
            .select("query_id", "doc_id",
                    F.when(span > 0, (F.col("score") - F.col("mn")) / span)
                    .otherwise(F.lit(0.0)).alias("score")))


def fuse(cos: Column, lex: Column, w_cos: float = 0.5, w_lex: float = 0.5) -> Column:
    """Weighted sum of a cosine and a normalised lexical score (A5)."""
    if w_cos == 0 and w_lex == 0:
        raise ValueError("at least one of the cosine and lexical weights must be non-zero")
    return F.lit(w_cos) * F.coalesce(cos, F.lit(0.0)) + F.lit(w_lex) * F.coalesce(lex, F.lit(0.0))


def top_k(scores: DataFrame, k: int = 2, group: str = "query_id", key: str = "doc_id",
          score: str = "score") -> DataFrame:
    """Best ``k`` rows per group by (score desc, key asc) with their rank.

    ``row_number() <= k`` lets Catalyst insert a partial window group limit before the
    shuffle, so at most ``k`` rows per group and input partition are exchanged.
    """
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(key).asc())
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _stream_join(big: DataFrame, small: DataFrame, key: str, bounded: bool) -> DataFrame:
    """``small`` left-joined to ``big`` on ``key`` without shuffling ``big``.

    An outer join cannot build on its preserved side, so the matching rows come from an
    inner join (broadcasting ``small`` when it is bounded). Rows of ``small`` whose key is
    null or not in ``big`` are added back; they are found by a pass over ``big``'s key
    column alone, which keeps at most the keys of ``small``.
    """
    hint = F.broadcast if bounded else (lambda df: df)
    matched = big.join(hint(small), key)
    found = big.select(key).join(hint(small.select(key).distinct()), key, "left_semi").distinct()
    missing = small.join(found, key, "left_anti")
    for c in big.columns:
        if c != key:
            missing = missing.withColumn(c, F.lit(None).cast(big.schema[c].dataType))
    return matched.unionByName(missing)


def pick_with_exclusion(top: DataFrame, queries: DataFrame, corpus: DataFrame,
                        query_key: str = "query_id", doc_key: str = "doc_id",
                        text: str = "diff", fallback_key=None,
                        queries_bounded: bool = False) -> DataFrame:
    """Choose one corpus row per query, skipping a rank-1 self match.

    ``top`` holds ranks 1 and 2 per query. If the rank-1 row has the query's own
    non-empty patch key, rank 2 is taken. Texts are joined for these two rows only
    (late materialisation): with ``queries_bounded`` (the caller counted the queries)
    the per-query rows are broadcast and the corpus is only streamed, never shuffled;
    patch keys are computed after the join. With ``fallback_key`` set, missing ranks take that key
    (the reference's "row 0" rule of the lexical path); ``is_fallback`` records it.
    Output: ``(query_id, doc_id, rank1_id, score, same_key, is_fallback)``.
    """
    r = (top.groupBy("query_id")
         .agg(F.max(F.when(F.col("rank") == 1, F.col("doc_id"))).alias("id1"),
              F.max(F.when(F.col("rank") == 2, F.col("doc_id"))).alias("id2"),
              F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"),
              F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2")))
    q = queries.select(F.col(query_key).cast("long").alias("query_id"),
                       patch_key(text).alias("qkey"))
    r = q.join(r, "query_id", "left")
    fb1 = F.col("id1").isNull()
    fb2 = F.col("id2").isNull()
    if fallback_key is not None:
        r = (r.withColumn("id1", F.coalesce("id1", F.lit(fallback_key)))
             .withColumn("id2", F.coalesce("id2", F.lit(fallback_key))))
    c = corpus.select(F.col(doc_key).cast("long").alias("id1"), F.col(text).alias("dtext"))
    r = r.withColumn("fb1", fb1).withColumn("fb2", fb2)
    r = _stream_join(c, r, "id1", queries_bounded)
    same = F.coalesce((patch_key("dtext") == F.col("qkey")) & (F.col("qkey") != ""), F.lit(False))
    r = r.withColumn("same_key", same)
    return r.select(
        "query_id",
        F.when(F.col("same_key"), F.col("id2")).otherwise(F.col("id1")).alias("doc_id"),
        F.col("id1").alias("rank1_id"),
        F.when(F.col("same_key"), F.col("s2")).otherwise(F.col("s1")).alias("score"),
        "same_key",
        F.when(F.col("same_key"), F.col("fb2")).otherwise(F.col("fb1")).alias("is_fallback"),
    )


def lookup_payload(picks: DataFrame, corpus: DataFrame, cols=("diff", "ast_seq", "message"),
                   doc_key: str = "doc_id", prefix: str = "retrieved_",
                   picks_bounded: bool = False) -> DataFrame:
    """Attach the chosen corpus row's columns, renamed with ``prefix``.

    Only the picked rows' texts are read into the result (late materialisation); a
    counted, bounded pick table is broadcast so the corpus is streamed, not shuffled.
    """
    c = corpus.select(F.col(doc_key).cast("long").alias("doc_id"),
                      *[F.col(x).alias(prefix + x) for x in cols])
    out = _stream_join(c, picks, "doc_id", picks_bounded)
    return out.select(*picks.columns, *[prefix + x for x in cols])


def attach_results(queries: DataFrame, results: DataFrame, query_key: str = "query_id",
                   cols=("retrieved_diff", "retrieved_ast_seq", "retrieved_message")) -> DataFrame:
    """Query rows with the retrieved columns added, joined by key."""
    r = results.select(F.col("query_id").alias(query_key), *cols)
    return queries.join(r, query_key, "left")


def same_key_count(picks: DataFrame) -> DataFrame:
    """``(same_key_count, total)``: how many queries had a rank-1 self match."""
    return picks.agg(F.sum(F.col("same_key").cast("long")).alias("same_key_count"),
                     F.count(F.lit(1)).alias("total"))


def pick_first_distinct(top: DataFrame, queries: DataFrame, corpus: DataFrame,
                        query_key: str = "query_id", doc_key: str = "doc_id",
                        text: str = "diff", fallback_key=None,
                        queries_bounded: bool = False) -> DataFrame:
    """Rank 1 of a candidate list from which every row carrying the query's own patch
    key was already removed (W3, ``mode='all'``).

    ``same_key`` tells whether the corpus holds a row with the query's non-empty patch
    key at all (such rows were skipped): the query keys are broadcast when bounded and
    the corpus is streamed past them once. Output as ``pick_with_exclusion``.
    """
    from diffsieve.functions.text import patch_key_hashes

    first = top.where(F.col("rank") == 1).select("query_id", F.col("doc_id").alias("id1"),
                                                  F.col("score").alias("s1"))
    qk = queries.select(F.col(query_key).cast("long").alias("query_id"), *patch_key_hashes(text))
    ck = corpus.select(*patch_key_hashes(F.col(text))[:2])
    hit = (ck.join(F.broadcast(qk.where("pk_set")) if queries_bounded else qk.where("pk_set"),
                   ["pk1", "pk2"])
           .select("query_id").distinct().withColumn("same_key", F.lit(True)))
    r = (qk.select("query_id").join(first, "query_id", "left")
         .join(hit, "query_id", "left"))
    fb = F.col("id1").isNull()
    doc = F.col("id1") if fallback_key is None else F.coalesce("id1", F.lit(fallback_key))
    return r.select("query_id", doc.alias("doc_id"), doc.alias("rank1_id"), F.col("s1").alias("score"),
                    F.coalesce("same_key", F.lit(False)).alias("same_key"), fb.alias("is_fallback"))


def pick_and_attach(top: DataFrame, queries: DataFrame, corpus: DataFrame, *,
                    query_key: str = "query_id", doc_key: str = "doc_id", text: str = "diff",
                    payload=("diff", "ast_seq", "message"), prefix: str = "retrieved_",
                    fallback_key=None, queries_bounded: bool = False) -> DataFrame:
    """W3 and J6 with one pass over the corpus texts.

    The (at most two) candidate rows per query are joined to their texts once -- the
    candidate table is broadcast when the queries were counted and bounded, so the
    corpus is streamed -- then rank 1's patch key is compared with the query's and the
    payload of the chosen row is kept. Same output as ``pick_with_exclusion`` followed
    by ``lookup_payload``.
    """
    r = (top.groupBy("query_id")
         .agg(F.max(F.when(F.col("rank") == 1, F.col("doc_id"))).alias("id1"),
              F.max(F.when(F.col("rank") == 2, F.col("doc_id"))).alias("id2"),
              F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"),
              F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2")))
    q = queries.select(F.col(query_key).cast("long").alias("query_id"),
                       patch_key(text).alias("qkey"))
    r = (q.join(r, "query_id", "left")
         .withColumn("fb1", F.col("id1").isNull()).withColumn("fb2", F.col("id2").isNull()))
    if fallback_key is not None:
        r = (r.withColumn("id1", F.coalesce("id1", F.lit(fallback_key)))
             .withColumn("id2", F.coalesce("id2", F.lit(fallback_key))))
    slots = F.explode(F.array(F.struct(F.lit(1).alias("slot"), F.col("id1").alias("doc_id")),
                              F.struct(F.lit(2).alias("slot"), F.col("id2").alias("doc_id"))))
    cand = (r.select("query_id", slots.alias("c"))
            .select("query_id", "c.slot", "c.doc_id").where(F.col("doc_id").isNotNull()))
    texts = corpus.select(F.col(doc_key).cast("long").alias("doc_id"), F.col(text).alias("_t"),
                          *[F.col(c).alias(prefix + c) for c in payload])
    j = texts.join(F.broadcast(cand) if queries_bounded else cand, "doc_id")
    body = F.struct(*[F.col(prefix + c) for c in payload])
    per_q = (j.groupBy("query_id")
             .agg(F.max(F.when(F.col("slot") == 1, patch_key("_t"))).alias("k1"),
                  F.max(F.when(F.col("slot") == 1, body)).alias("p1"),
                  F.max(F.when(F.col("slot") == 2, body)).alias("p2")))
    out = r.join(per_q, "query_id", "left")
    same = F.coalesce((F.col("k1") == F.col("qkey")) & (F.col("qkey") != ""), F.lit(False))
    out = out.withColumn("same_key", same)
    chosen = F.when(F.col("same_key"), F.col("p2")).otherwise(F.col("p1"))
    return out.select(
        "query_id",
        F.when(F.col("same_key"), F.col("id2")).otherwise(F.col("id1")).alias("doc_id"),
        F.col("id1").alias("rank1_id"),
        F.when(F.col("same_key"), F.col("s2")).otherwise(F.col("s1")).alias("score"),
        "same_key",
        F.when(F.col("same_key"), F.col("fb2")).otherwise(F.col("fb1")).alias("is_fallback"),
        *[chosen[prefix + c].alias(prefix + c) for c in payload])
