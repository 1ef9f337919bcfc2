"""Block similarity: exact per-query top-k over all corpus rows (A4, J5, and the fused
scores of W4) without materialising the query x corpus matrix as rows.

Layout: queries are hashed into ``qb`` blocks and corpus rows into ``db`` buckets. The
vectors of query block ``i`` are replicated to every bucket and the corpus vectors of
bucket ``j`` to every block, so group ``(i, j)`` holds at most ``q_rows x d_rows`` pairs
whatever the data. An optional sparse score table ``(query_id, doc_id, score)`` (for
example normalised BM25) is shuffled into the same groups. Each group computes the
dense cosine block with numpy, adds the sparse scores, and emits only its top ``k`` per
query; a final window picks the global top ``k``. Hashing spreads a hot query or a hot
document evenly, and no group grows with the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffsieve.operators.rank import top_k
from diffsieve.session import default_parallelism

Q_ROWS = 512
D_ROWS = 2048
CAND_SCHEMA = "query_id long, doc_id long, score double"


def _width(*columns: pd.Series) -> int:
    """Common width of all non-null vectors of the columns; 0 without any."""
    dims = {len(v) for c in columns for v in c if v is not None}
    if len(dims) > 1:
        raise ValueError(f"vectors of different widths in one table: {sorted(dims)}")
    return dims.pop() if dims else 0


def _unit_rows(vectors: pd.Series, dim: int) -> np.ndarray:
    """Stack a column of vectors into rows of unit length; null or zero rows stay zero."""
    m = np.zeros((len(vectors), dim), dtype=np.float64)
    there = np.flatnonzero(vectors.notna().to_numpy())
    if len(there) and dim:
        m[there] = np.stack(vectors.to_numpy()[there])
    norm = np.sqrt((m * m).sum(axis=1))
    nz = norm > 0
    m[nz] /= norm[nz][:, None]
    return m


def _cosines(qs: pd.Series, docs: pd.Series) -> np.ndarray:
    """Cosine block; a side without any vector gives zeros."""
    dim = _width(qs, docs)
    return _unit_rows(qs, dim) @ _unit_rows(docs, dim).T


def _group_topk(qids: np.ndarray, dids: np.ndarray, s: np.ndarray, k: int) -> pd.DataFrame:
    """Per row of ``s`` the ``k`` best columns by (score desc, doc id asc)."""
    order = np.argsort(dids, kind="stable")
    dids, s = dids[order], s[:, order]
    kk = min(k, len(dids))
    if len(dids) > 4 * kk:
        # Partition first: only columns scoring at least the k-th best value can win.
        kth = -np.partition(-s, kk - 1, axis=1)[:, kk - 1]
        rows, cols, scores = [], [], []
        for i in range(s.shape[0]):
            cand = np.nonzero(s[i] >= kth[i])[0]
            pick = cand[np.lexsort((cand, -s[i, cand]))][:kk]
            rows.append(np.full(len(pick), i))
            cols.append(pick)
            scores.append(s[i, pick])
        r, c, v = np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)
    else:
        pick = np.argsort(-s, axis=1, kind="stable")[:, :kk]
        r = np.repeat(np.arange(s.shape[0]), kk)
        c = pick.ravel()
        v = s[r, c]
    return pd.DataFrame({"query_id": qids[r].astype("int64"), "doc_id": dids[c].astype("int64"),
                         "score": v.astype("float64")})


def _mask_identical(out: np.ndarray, qs: pd.DataFrame, docs: pd.DataFrame) -> None:
    """Set pairs whose document carries the query's own (non-empty) patch key to -inf."""
    if "pk1" not in qs.columns:
        return
    same = ((qs["pk1"].to_numpy()[:, None] == docs["pk1"].to_numpy()[None, :])
            & (qs["pk2"].to_numpy()[:, None] == docs["pk2"].to_numpy()[None, :])
            & qs["pk_set"].to_numpy(dtype=bool)[:, None])
    out[same] = -np.inf


def _drop_excluded(top: pd.DataFrame) -> pd.DataFrame:
    return top[np.isfinite(top["score"].to_numpy())]


def _kernel(k: int, w_cos: float, w_sparse: float):
    def run(_key, vec, sparse):
        docs = vec[vec["side"] == 0]
        qs = vec[vec["side"] == 1]
        if len(docs) == 0 or len(qs) == 0:
            return pd.DataFrame({"query_id": [], "doc_id": [], "score": []}).astype(
                {"query_id": "int64", "doc_id": "int64", "score": "float64"})
        qids = qs["id"].to_numpy(dtype=np.int64)
        dids = docs["id"].to_numpy(dtype=np.int64)
        if w_cos != 0:
            s = _cosines(qs["v"], docs["v"]) * w_cos
        else:
            s = np.zeros((len(qids), len(dids)))
        if len(sparse) and w_sparse != 0:
            qi = pd.Index(qids).get_indexer(sparse["query_id"].to_numpy())
            di = pd.Index(dids).get_indexer(sparse["doc_id"].to_numpy())
            ok = (qi >= 0) & (di >= 0)
            # (query, doc) pairs are unique in a score table: plain fancy-index add
            s[qi[ok], di[ok]] += w_sparse * sparse["score"].to_numpy()[ok]
        _mask_identical(s, qs, docs)
        return _drop_excluded(_group_topk(qids, dids, s, k))
    return run


MIN_PAIRS = 250_000


def _identity(text: str | None) -> list:
    if not text:
        return []
    from diffsieve.functions.text import patch_key_hashes
    return list(patch_key_hashes(text))


def _layout(spark, nq: int, nd: int, q_rows: int, d_rows: int):
    """Query blocks ``qb`` and document buckets ``db``.

    A group never holds more than ``q_rows`` queries or ``d_rows`` documents (memory
    bound, whatever the data size). Beyond that, work of at least ``MIN_PAIRS`` pairs is
    split into up to four groups per task slot, so that uneven placement of groups
    on partitions evens out. Query-side rows are copied ``db`` times and document-side
    rows ``qb`` times, so the split follows ``qb / db ~ nq / nd``.
    """
    nq, nd = max(nq, 1), max(nd, 1)
    need_q, need_d = math.ceil(nq / q_rows), math.ceil(nd / d_rows)
    want = min(4 * default_parallelism(spark), max(1, (nq * nd) // MIN_PAIRS))
    groups = max(need_q * need_d, want)
    qb = min(nq, max(need_q, round(math.sqrt(groups * nq / nd))))
    db = min(nd, max(need_d, math.ceil(groups / qb)))
    return qb, db


def _partitions(spark, groups: int) -> int:
    """Shuffle partitions for ``groups`` blocks: one each while there are few, else as many as
    keep the slots busy; a task then works off many groups, one after the other."""
    most = max(4 * default_parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return min(groups, most)


def _batch(key: str, batch_size: int):
    """Number of the batch that a key belongs to, by exact integer floor division."""
    return F.expr(f"({key} - pmod({key}, {batch_size}L)) div {batch_size}L")


# Distinct query terms up to this many (counted first; a string and a field name each) are
# broadcast to filter the postings; beyond it both sides are shuffled by term.
BROADCAST_TERMS = 1_000_000


def _lexical_weights(index, queries: DataFrame, query_key: str, query_fields, qblk, dbkt, all_q, all_d) -> DataFrame | None:
    """``(kind, id, key, w, q_block, d_bucket)``: query-term weights (kind 3, ``qtf * idf``) and the
    scaled weights of the postings of queried terms (kind 2), dealt to their blocks.

    Postings of terms that no query has are dropped before any copy or shuffle of them.
    """
    from diffsieve.operators.lexical import B, K1, SCORE_SCALE, query_terms, term_key

    key = term_key(index)
    qt = query_terms(queries, query_key, query_fields)
    asked = qt.select("term").distinct()
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_TERMS else asked
    out = None
    for f in index.fields:
        n, avgdl = index.stats[f]
        if n == 0:
            continue
        idf = F.log(F.lit(1.0) + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        norm = F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * F.col("dl") / F.lit(avgdl))
        for part in (qt.join(index.terms.where(F.col("field") == f), "term")
                     .select(F.lit(3).alias("kind"), F.col("query_id").alias("id"), key.alias("key"),
                             (F.col("qtf") * idf).alias("w"))
                     .select("kind", "id", "key", "w", qblk.alias("q_block"), all_d),
                     index.postings.where(F.col("field") == f).join(asked, "term", "left_semi")
                     .select(F.lit(2).alias("kind"), F.col("doc_id").alias("id"), key.alias("key"),
                             (F.col("tf") / (F.col("tf") + norm) * F.lit(SCORE_SCALE)).alias("w"))
                     .select("kind", "id", "key", "w", all_q, dbkt.alias("d_bucket"))):
            out = part if out is None else out.unionByName(part)
    return out


def block_topk(queries: DataFrame, corpus: DataFrame, k: int = 2, *,
               query_key: str = "query_id", doc_key: str = "doc_id", vec: str = "v",
               w_cos: float = 1.0, sparse: DataFrame | None = None, w_sparse: float = 0.0,
               n_queries: int | None = None, n_docs: int | None = None,
               q_rows: int = Q_ROWS, d_rows: int = D_ROWS,
               exclude_identical: str | None = None) -> DataFrame:
    """Exact top ``k`` corpus rows per query by ``w_cos * cosine + w_sparse * sparse``.

    Returns ``(query_id, doc_id, score, rank)``. Every corpus row is scored against
    every query (rows absent from ``sparse`` contribute 0 there); ties go to the
    smaller ``doc_id``. Zero or null vectors have cosine 0. With
    ``exclude_identical`` naming a text column of both tables, corpus rows with the
    query's own non-empty patch key are never candidates.
    """
    spark = queries.sparkSession
    nq = n_queries if n_queries is not None else queries.count()
    nd = n_docs if n_docs is not None else corpus.count()
    qb, db = _layout(spark, nq, nd, q_rows, d_rows)

    qv = queries.select(F.col(query_key).cast("long").alias("id"), F.col(vec).alias("v"),
                        *_identity(exclude_identical))
    dv = corpus.select(F.col(doc_key).cast("long").alias("id"), F.col(vec).alias("v"),
                       *_identity(exclude_identical))
    qblk = F.pmod(F.xxhash64("id"), F.lit(qb)).cast("int")
    dbkt = F.pmod(F.xxhash64("id"), F.lit(db)).cast("int")
    ident = ["pk1", "pk2", "pk_set"] if exclude_identical else []
    vecs = (dv.select(F.lit(0).alias("side"), "id", "v", *ident, dbkt.alias("d_bucket"),
                      F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("q_block"))
            .unionByName(
                qv.select(F.lit(1).alias("side"), "id", "v", *ident, qblk.alias("q_block"),
                          F.explode(F.sequence(F.lit(0), F.lit(db - 1))).alias("d_bucket"))))
    if sparse is None:
        sparse = spark.createDataFrame([], "query_id long, doc_id long, score double")
    sp = sparse.select(
        F.col("query_id").cast("long").alias("query_id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("score").cast("double").alias("score"),
        F.pmod(F.xxhash64(F.col("query_id").cast("long")), F.lit(qb)).cast("int").alias("q_block"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(db)).cast("int").alias("d_bucket"))
    # A fixed number of partitions: AQE would merge these small shuffle partitions and run
    # the numpy kernels of all groups one after another in a single task.
    g = _partitions(spark, qb * db)
    if g > 1:
        vecs = vecs.repartition(g, "q_block", "d_bucket")
        sp = sp.repartition(g, "q_block", "d_bucket")
    cand = (vecs.groupBy("q_block", "d_bucket")
            .cogroup(sp.groupBy("q_block", "d_bucket"))
            .applyInPandas(_kernel(k, w_cos, w_sparse), CAND_SCHEMA))
    return top_k(cand, k)


def cosine_topk(queries: DataFrame, corpus: DataFrame, k: int = 2, **kw) -> DataFrame:
    """Per-query top ``k`` corpus rows by cosine similarity (A4 through J5)."""
    return block_topk(queries, corpus, k, w_cos=1.0, **kw)


GRAM_SCHEMA = "query_id long, other_id long, dot double"


def _gram(_key, pdf):
    q = pd.Index(np.unique(pdf["query_id"].to_numpy()))
    d = pd.Index(np.unique(pdf["doc_id"].to_numpy()))
    m = np.zeros((len(q), len(d)))
    m[q.get_indexer(pdf["query_id"]), d.get_indexer(pdf["doc_id"])] = pdf["score"].to_numpy()
    g = m @ m.T
    i, j = np.nonzero(g)
    return pd.DataFrame({"query_id": q.to_numpy()[i].astype("int64"),
                         "other_id": q.to_numpy()[j].astype("int64"), "dot": g[i, j]})


def profile_similarity(scores: DataFrame, queries: DataFrame, batch_size: int = 32,
                       query_key: str = "query_id", n_docs: int | None = None,
                       d_rows: int = D_ROWS) -> DataFrame:
    """Cosine similarity between the score rows of queries of the same batch.

    The reference compares the rows of its query x corpus score matrices inside each
    batch of ``batch_size`` queries (batches by key: ``query_id div batch_size``);
    absent scores are zeros. Partial Gram matrices are computed per ``(batch, doc
    bucket)`` with numpy and summed by Spark, so no group holds more than one batch and
    one bucket (at most ``d_rows`` documents of ``n_docs``, so a group does not grow with
    the corpus). Output ``(query_id, other_id, sim)`` for every ordered pair of a batch.
    """
    spark = scores.sparkSession
    if n_docs is None:
        n_docs = scores.select("doc_id").distinct().count()
    nb = max(default_parallelism(spark), math.ceil(n_docs / d_rows))
    batch = _batch("query_id", batch_size)
    s = (scores.where(F.col("score") != 0)
         .select(F.col("query_id").cast("long").alias("query_id"),
                 F.col("doc_id").cast("long").alias("doc_id"),
                 F.col("score").cast("double").alias("score"))
         .withColumn("batch", batch)
         .withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(nb))))
    dots = (s.repartition(_partitions(spark, nb), "bucket").groupBy("batch", "bucket").applyInPandas(_gram, GRAM_SCHEMA)
            .groupBy("query_id", "other_id").agg(F.sum("dot").alias("dot")))
    norms = (dots.where(F.col("query_id") == F.col("other_id"))
             .select("query_id", F.sqrt("dot").alias("nrm")))
    q = queries.select(F.col(query_key).cast("long").alias("query_id")).distinct()
    q = q.withColumn("batch", batch)
    pairs = q.join(q.select(F.col("query_id").alias("other_id"), "batch"), "batch")
    n1 = norms.withColumnRenamed("nrm", "n1")
    n2 = norms.select(F.col("query_id").alias("other_id"), F.col("nrm").alias("n2"))
    r = (pairs.join(dots, ["query_id", "other_id"], "left").join(n1, "query_id", "left")
         .join(n2, "other_id", "left"))
    ok = (F.coalesce("n1", F.lit(0.0)) > 0) & (F.coalesce("n2", F.lit(0.0)) > 0)
    return r.select("query_id", "other_id",
                    F.when(ok, F.coalesce("dot", F.lit(0.0)) / (F.col("n1") * F.col("n2")))
                    .otherwise(F.lit(0.0)).alias("sim"))


# ------------------------------------------------- hybrid with the lexical part in blocks

STATS_SCHEMA = "query_id long, mx double, mn0 double, hits long"
CHUNK_PAIRS = 4_000_000


def _lexical_block(qids, dids, qt: pd.DataFrame, po: pd.DataFrame, scale: float):
    """BM25 of a query block against a document bucket, from term weights.

    ``qt`` holds ``(id, key, w)`` query-term weights, ``po`` ``(id, key, w)`` posting
    weights (already scaled). Every contribution is rounded to an integer unit exactly
    as the join path does, ``floor(qw * tfn + 0.5)``; sums of integers below 2**53 are
    exact in doubles in any order. Returns the score matrix and the hit mask.
    """
    nq, nd = len(qids), len(dids)
    total = np.zeros(nq * nd)
    hits = np.zeros(nq * nd)
    if len(qt) == 0 or len(po) == 0:
        return total.reshape(nq, nd), hits.reshape(nq, nd) > 0
    codes, _ = pd.factorize(pd.concat([qt["key"], po["key"]], ignore_index=True))
    qc, pc = codes[:len(qt)], codes[len(qt):]
    order = np.argsort(pc, kind="stable")
    pc = pc[order]
    pd_idx = pd.Index(dids).get_indexer(po["id"].to_numpy())[order]
    pw = po["w"].to_numpy()[order]
    q_idx = pd.Index(qids).get_indexer(qt["id"].to_numpy())
    qw = qt["w"].to_numpy()
    start = np.searchsorted(pc, qc, "left")
    cnt = np.searchsorted(pc, qc, "right") - start
    keep = cnt > 0
    q_idx, qw, start, cnt = q_idx[keep], qw[keep], start[keep], cnt[keep]
    cum = np.cumsum(cnt)
    lo = 0
    while lo < len(cnt):
        # a slice of query terms whose matches fit one chunk (at least one term)
        base = cum[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(cum, base + CHUNK_PAIRS, "right")))
        c = cnt[lo:hi]
        rep = np.repeat(np.arange(lo, hi), c)
        first = np.repeat(cum[lo:hi] - c - base, c)
        offs = start[rep] + (np.arange(len(rep)) - first)
        flat = q_idx[rep] * nd + pd_idx[offs]
        fx = np.floor(qw[rep] * pw[offs] + 0.5)
        total += np.bincount(flat, weights=fx, minlength=nq * nd)
        hits += np.bincount(flat, minlength=nq * nd)
        lo = hi
    return (total / scale).reshape(nq, nd), hits.reshape(nq, nd) > 0


def _stats_kernel(scale: float):
    def run(pdf):
        po = pdf[pdf["kind"].to_numpy() == 2]
        qt = pdf[pdf["kind"].to_numpy() == 3]
        qids = np.unique(qt["id"].to_numpy()).astype(np.int64)
        dids = np.unique(po["id"].to_numpy()).astype(np.int64)
        if len(qids) == 0 or len(dids) == 0:
            return pd.DataFrame({"query_id": pd.Series([], dtype="int64"),
                                 "mx": pd.Series([], dtype="float64"),
                                 "mn0": pd.Series([], dtype="float64"),
                                 "hits": pd.Series([], dtype="int64")})
        s, h = _lexical_block(qids, dids, qt, po, scale)
        n = h.sum(axis=1)
        mx = np.where(h, s, -np.inf).max(axis=1)
        mn = np.where(h, s, np.inf).min(axis=1)
        ok = n > 0
        return pd.DataFrame({"query_id": qids[ok], "mx": mx[ok], "mn0": mn[ok],
                             "hits": n[ok].astype("int64")})
    return run


def _fuse_kernel(k: int, w_cos: float, w_lex: float, scale: float):
    def run(_key, vec, lex):
        kinds = vec["kind"].to_numpy()
        docs, qs = vec[kinds == 0], vec[kinds == 1]
        if len(docs) == 0 or len(qs) == 0:
            return pd.DataFrame({"query_id": pd.Series([], dtype="int64"),
                                 "doc_id": pd.Series([], dtype="int64"),
                                 "score": pd.Series([], dtype="float64")})
        qids = qs["id"].to_numpy(dtype=np.int64)
        dids = docs["id"].to_numpy(dtype=np.int64)
        if w_cos != 0:
            out = _cosines(qs["v"], docs["v"]) * w_cos
        else:
            out = np.zeros((len(qids), len(dids)))
        if w_lex != 0 and len(lex):
            lk = lex["kind"].to_numpy()
            s, h = _lexical_block(qids, dids, lex[lk == 3], lex[lk == 2], scale)
            # per-query statistics travel on the query rows
            mx = qs["mx"].to_numpy(dtype=np.float64)[:, None]
            mn = qs["mn"].to_numpy(dtype=np.float64)[:, None]
            span = mx - mn
            with np.errstate(divide="ignore", invalid="ignore"):
                bn = np.where(span > 0, (s - mn) / span, 0.0)
            out[h] += w_lex * bn[h]
        _mask_identical(out, qs, docs)
        return _drop_excluded(_group_topk(qids, dids, out, k))
    return run


def hybrid_topk(index, queries: DataFrame, corpus: DataFrame, k: int = 2, *,
                w_cos: float = 0.5, w_lex: float = 0.5, query_key: str = "query_id",
                doc_key: str = "doc_id", vec: str = "v", query_fields=("diff", "ast_seq"),
                n_queries: int | None = None, stats_bounded: bool = False,
                q_rows: int = Q_ROWS, d_rows: int = D_ROWS,
                exclude_identical: str | None = None) -> DataFrame:
    """Exact top ``k`` per query by ``w_cos * cosine + w_lex * minmax(BM25)`` with the
    lexical part computed inside the blocks (W4 at scale). ``exclude_identical`` as in
    ``block_topk``.

    Spark computes the weights -- ``qtf * idf`` per query term and the scaled document
    factor per posting, as in ``lexical.match_postings`` -- and shuffles them into
    ``(query block, document bucket)`` groups. Pass A sums BM25 per group and emits
    per-query maximum, minimum and hit count; Spark combines them per query. Pass B
    cogroups the vectors (with the statistics on the query rows) and the weights,
    normalises, adds the cosine part and emits the group's top ``k``. No table of
    query x document scores is ever formed as rows, written or shuffled; scores equal
    the join path bit for bit.
    """
    from diffsieve.operators.lexical import SCORE_SCALE

    spark = queries.sparkSession
    nq = n_queries if n_queries is not None else queries.count()
    nd = index.n_corpus
    qb, db = _layout(spark, nq, nd, q_rows, d_rows)
    g = _partitions(spark, qb * db)
    qblk = F.pmod(F.xxhash64("id"), F.lit(qb)).cast("int")
    dbkt = F.pmod(F.xxhash64("id"), F.lit(db)).cast("int")
    all_q = F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("q_block")
    all_d = F.explode(F.sequence(F.lit(0), F.lit(db - 1))).alias("d_bucket")

    qv = queries.select(F.col(query_key).cast("long").alias("id"), F.col(vec).alias("v"),
                        *_identity(exclude_identical))
    lex_rows = (_lexical_weights(index, queries, query_key, query_fields, qblk, dbkt, all_q, all_d)
                if w_lex != 0 else None)
    if lex_rows is not None:
        if g > 1:
            lex_rows = lex_rows.repartition(g, "q_block", "d_bucket")
        stats = (lex_rows.groupBy("q_block", "d_bucket")
                 .applyInPandas(_stats_kernel(SCORE_SCALE), STATS_SCHEMA)
                 .groupBy("query_id")
                 .agg(F.max("mx").alias("mx"), F.min("mn0").alias("mn0"), F.sum("hits").alias("hits"))
                 .select(F.col("query_id").alias("id"), "mx",
                         F.when(F.col("hits") < F.lit(nd), F.lit(0.0)).otherwise(F.col("mn0")).alias("mn")))
        qv = qv.join(F.broadcast(stats) if stats_bounded else stats, "id", "left")
    else:
        lex_rows = spark.createDataFrame([], "kind int, id long, key long, w double, "
                                             "q_block int, d_bucket int")
        qv = qv.withColumn("mx", F.lit(None).cast("double")).withColumn("mn", F.lit(None).cast("double"))
    # a query without any hit has an all-zero lexical row
    qv = qv.na.fill(0.0, subset=["mx", "mn"])
    nul = F.lit(None).cast("double")
    dv = corpus.select(F.col(doc_key).cast("long").alias("id"), F.col(vec).alias("v"),
                       *_identity(exclude_identical))
    ident = ["pk1", "pk2", "pk_set"] if exclude_identical else []
    vecs = (dv.select(F.lit(0).alias("kind"), "id", "v", *ident, nul.alias("mx"), nul.alias("mn"),
                      dbkt.alias("d_bucket"), all_q)
            .unionByName(qv.select(F.lit(1).alias("kind"), "id", "v", *ident, "mx", "mn",
                                   qblk.alias("q_block"), all_d)))
    if g > 1:
        vecs = vecs.repartition(g, "q_block", "d_bucket")
    cand = (vecs.groupBy("q_block", "d_bucket")
            .cogroup(lex_rows.groupBy("q_block", "d_bucket"))
            .applyInPandas(_fuse_kernel(k, w_cos, w_lex, SCORE_SCALE), CAND_SCHEMA))
    return top_k(cand, k)


# ------------------------------------------------- profile similarity of cosine rows

PROFILE_SCHEMA = "query_id long, other_id long, sim double"


def _unit_sums(df: DataFrame, key: str, vec: str) -> DataFrame:
    """``(id, v)``: unit vectors, those of one key in an Arrow batch added up; null vectors are empty."""
    from diffsieve.operators.streamtop import _vector_matrix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _vector_matrix(batch.column(1))
            ids, at = np.unique(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), return_inverse=True)
            total = np.zeros((len(ids), m.shape[1]))
            np.add.at(total, at, m)
            off = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * np.int32(m.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(off, pa.array(total.ravel()))], ["id", "v"])

    return df.select(F.col(key).cast("long").alias("id"), F.col(vec).alias("v")).mapInArrow(run, "id long, v array<double>")


def _moments(corpus: DataFrame, vec: str) -> tuple[int, np.ndarray]:
    """Row count, and the sum over the corpus of ``u u^T`` of its unit vectors (width x width,
    whatever the corpus): a partial matrix per task, added up by cell."""
    from diffsieve.operators.streamtop import _vector_matrix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = 0, np.zeros((0, 0))
        for batch in batches:
            rows += batch.num_rows
            m = _vector_matrix(batch.column(0))
            if not m.shape[1]:
                continue
            if not len(total):
                total = np.zeros((m.shape[1],) * 2)
            if len(total) != m.shape[1]:
                raise ValueError(f"vectors of different widths in one table: {sorted({len(total), m.shape[1]})}")
            total += m.T @ m
        n = total.size
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[0, np.full(n, len(total))].astype(np.int32)), pa.array(np.r_[-1, np.arange(n)].astype(np.int64)),
                                          pa.array(np.r_[float(rows), total.ravel()])], ["width", "cell", "x"])

    t = corpus.select(F.col(vec).alias("v")).mapInArrow(run, "width int, cell long, x double").groupBy("width", "cell").agg(F.sum("x").alias("x"))
    t = t.orderBy("width", "cell").toArrow().combine_chunks()
    width, x = t.column("width").to_numpy(), t.column("x").to_numpy()
    widths = sorted(set(width.tolist()) - {0})
    if len(widths) > 1:
        raise ValueError(f"vectors of different widths in one table: {widths}")
    dim = widths[0] if widths else 0
    return int(x[width == 0].sum()), x[width > 0].reshape(dim, dim)


def _cos_gram_kernel(moments: np.ndarray):
    def run(pdf):
        ids, at = np.unique(pdf["id"].to_numpy(dtype=np.int64), return_inverse=True)
        dim = _width(pdf["v"][pdf["v"].str.len() > 0])
        if dim and len(moments) and dim != len(moments):
            raise ValueError(f"vectors of different widths: {sorted({dim, len(moments)})}")
        q = np.zeros((len(ids), len(moments)))
        for i, v in zip(at, pdf["v"]):
            if len(v) and len(moments):
                q[i] += v
        g = q @ moments @ q.T
        g = (g + g.T) / 2
        norm = np.sqrt(np.maximum(np.diag(g), 0.0))
        both = np.multiply.outer(norm, norm)
        sim = np.divide(g, both, out=np.zeros_like(g), where=both > 0)
        return pd.DataFrame({"query_id": np.repeat(ids, len(ids)), "other_id": np.tile(ids, len(ids)), "sim": sim.ravel()})
    return run


def cosine_profile(queries: DataFrame, corpus: DataFrame, batch_size: int = 32, *,
                   query_key: str = "query_id", doc_key: str = "doc_id", vec: str = "v",
                   n_queries: int | None = None, n_docs: int | None = None,
                   q_rows: int = Q_ROWS, d_rows: int = D_ROWS) -> DataFrame:
    """A6 on the cosine matrix: cosine similarity between the query x corpus cosine rows
    of queries in the same batch (``query_id div batch_size``).

    The product of two queries' cosine rows is ``sum_d (a.d)(b.d) = a (sum_d d d^T) b``. The
    middle matrix has the width of the vectors whatever the corpus; one pass adds it up, and
    each batch of queries then needs only its own vectors: work and shuffle grow with
    queries plus corpus rows, not with their product. Copies of a key add up. No blocks are
    formed, so the block sizes change nothing. Output ``(query_id, other_id, sim)``.
    """
    n, moments = _moments(corpus, vec)
    if not n:
        return queries.sparkSession.createDataFrame([], PROFILE_SCHEMA)
    return (_unit_sums(queries, query_key, vec).withColumn("batch", _batch("id", batch_size))
            .groupBy("batch").applyInPandas(_cos_gram_kernel(moments), PROFILE_SCHEMA))


# ------------------------------------------- profile similarity of normalised BM25 rows

def lexical_profile(index, queries: DataFrame, batch_size: int = 32, *,
                    query_key: str = "query_id", query_fields=("diff", "ast_seq"),
                    n_queries: int | None = None, stats_bounded: bool = False,
                    q_rows: int = Q_ROWS, d_rows: int = D_ROWS) -> DataFrame:
    """A6 on the min-max normalised BM25 matrix (no Q x N rows, no copies of postings).

    Same result as ``profile_similarity(minmax_normalize(bm25_scores(..)))``: the documents'
    postings of queried terms are brought together by document and written once
    (``docside``); passes over them give per-query maximum, minimum and hit count, then the
    partial Gram matrix of each batch, and the partials are added up. Query tables above a
    broadcast take several such passes; no blocks are formed, so the block sizes change
    nothing. Output ``(query_id, other_id, sim)`` for every ordered pair of a batch.
    """
    from diffsieve.operators import docside
    from diffsieve.operators.lexical import B, K1, query_terms

    ids = queries.select(F.col(query_key).cast("long").alias("query_id"))
    return docside.profile(index, ids, query_terms(queries, query_key, query_fields), batch_size, K1, B)


# ------------------------------------------------------- lexical top-k in blocks

def _lex_topk_kernel(k: int, scale: float):
    def run(pdf):
        kinds = pdf["kind"].to_numpy()
        po, qt = pdf[kinds == 2], pdf[kinds == 3]
        empty = pd.DataFrame({"query_id": pd.Series([], dtype="int64"),
                              "doc_id": pd.Series([], dtype="int64"),
                              "score": pd.Series([], dtype="float64")})
        if len(po) == 0 or len(qt) == 0:
            return empty
        qids = np.unique(qt["id"].to_numpy()).astype(np.int64)
        dids = np.unique(po["id"].to_numpy()).astype(np.int64)
        s, h = _lexical_block(qids, dids, qt, po, scale)
        s = np.where(h, s, -np.inf)          # only documents sharing a term are hits
        return _drop_excluded(_group_topk(qids, dids, s, k))
    return run


def lexical_topk(index, queries: DataFrame, k: int = 2, *, query_key: str = "query_id",
                 query_fields=("diff", "ast_seq"), n_queries: int | None = None,
                 q_rows: int = Q_ROWS, d_rows: int = D_ROWS) -> DataFrame:
    """Top ``k`` hits per query by raw BM25 (ties by key), computed in blocks (W1 on A2).

    Equal to ``top_k(bm25_scores(..), k)``, without shuffling the table of all hits:
    each (query block, document bucket) group sums BM25 from the term weights and emits
    only its top ``k`` hits per query; the final window keeps the global top ``k``.
    """
    from diffsieve.operators.lexical import SCORE_SCALE

    spark = queries.sparkSession
    nq = n_queries if n_queries is not None else queries.count()
    nd = index.n_corpus
    qb, db = _layout(spark, nq, nd, q_rows, d_rows)
    qblk = F.pmod(F.xxhash64("id"), F.lit(qb)).cast("int")
    dbkt = F.pmod(F.xxhash64("id"), F.lit(db)).cast("int")
    all_q = F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("q_block")
    all_d = F.explode(F.sequence(F.lit(0), F.lit(db - 1))).alias("d_bucket")
    rows = _lexical_weights(index, queries, query_key, query_fields, qblk, dbkt, all_q, all_d)
    if rows is None:
        return spark.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    g = _partitions(spark, qb * db)
    if g > 1:
        rows = rows.repartition(g, "q_block", "d_bucket")
    cand = (rows.groupBy("q_block", "d_bucket")
            .applyInPandas(_lex_topk_kernel(k, SCORE_SCALE), CAND_SCHEMA))
    return top_k(cand, k)
