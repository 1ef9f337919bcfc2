"""Streaming top-k: the corpus is read once per pass and never copied or shuffled.

The queries -- unit vectors and weighted terms -- are broadcast after their size was
counted; every task streams its corpus partition past them in chunks and keeps the best
``k`` rows per query, so it holds one chunk of scores and ``k`` rows a query whatever the
partition's size. Only those rows are exchanged. Query tables above ``BROADCAST_BYTES`` are
sent in parts, a pass over the corpus each; above ``MAX_PASSES`` of them they take the
shuffled blocks of ``dense``. All give the same rows.

For the lexical part the corpus is tokenised in the JVM and restricted to the queries'
terms in one pass (``restricted``), written as Parquet: a document is then its key, its
vector and the weights of the terms it shares with any query. The minima and maxima of
the scores and the fused ranking are further passes over that table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffsieve.functions.text import null_to_empty, patch_key_hashes, tokenize
from diffsieve.operators import dense
from diffsieve.operators.lexical import B, K1, SCORE_SCALE, query_terms, spread, token_slices
from diffsieve.operators.rank import top_k
from diffsieve.session import materialize

# Query vectors and terms up to this size (counted first) are sent to every task.
BROADCAST_BYTES = 128 << 20
# A larger query side takes up to this many passes over the corpus, each with a part of it.
MAX_PASSES = 64
UNBOUNDED = 1 << 62
# Score cells (queries x documents of a chunk) and term matches a task holds at a time.
CELLS = 1_000_000
# A posting whose term fewer queries have is counted together with others like it.
OUTER = 200
# A term that one in so many queries has is added as a row of all queries; in ``Products`` it may be a
# column of the matrix, of which there are at most ``COLUMNS``.
ROW_SHARE, COLUMN_SHARE, COLUMNS = 10, 20, 512
IDENTITY = ("pk1", "pk2", "pk_set")


def query_bytes(queries: DataFrame, vec: str | None, weighted: DataFrame | None) -> int:
    """Counted size of the broadcast side: vectors as doubles, and 40 bytes a query and a query term."""
    cols = [F.count(F.lit(1)).alias("n")]
    if vec:
        cols.append(F.sum(F.greatest(F.size(vec), F.lit(0)).cast("long")).alias("values"))
    r = queries.agg(*cols).first()
    return 40 * (r["n"] + (weighted.count() if weighted is not None else 0)) + 8 * ((r["values"] or 0) if vec else 0)


def _vector_type(corpus: DataFrame, vec: str | None) -> str:
    return corpus.schema[vec].dataType.simpleString() if vec else "array<double>"


class Queries:
    """Broadcast side: keys, unit vectors, terms as sorted arrays, identity of patch keys."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray | None, identity: dict | None):
        order = np.argsort(ids, kind="stable")
        self.ids, self.order = ids[order], order
        self.vectors = vectors[order] if vectors is not None else None
        self.identity = {k: v[order] for k, v in identity.items()} if identity else None
        self.term = self.who = self.weight = np.zeros(0, np.int64)
        self.n_terms = 0
        self.low = self.high = None

    def set_terms(self, query_id: np.ndarray, term: np.ndarray, weight: np.ndarray, n_terms: int) -> None:
        who = np.searchsorted(self.ids, query_id)
        by = np.lexsort((who, term))
        self.who, self.weight = who[by], weight[by].astype(np.float64)
        self.begin = np.searchsorted(term[by], np.arange(n_terms + 1))
        self.n_terms = n_terms


def _vector_matrix(column: pa.Array) -> np.ndarray:
    """Unit rows of a list column; null vectors are zero rows."""
    if len(column) and not column.null_count:
        size = np.asarray(pc.list_value_length(column))
        flat = pc.list_flatten(column)
        if (size == size[0]).all() and not flat.null_count:
            m = flat.to_numpy().astype(np.float64).reshape(len(column), -1)
            norm = np.sqrt((m * m).sum(axis=1))
            some = norm > 0
            m[some] /= norm[some][:, None]
            return m
    rows = column.to_pandas()
    return dense._unit_rows(rows, dense._width(rows))


def collect_queries(queries: DataFrame, query_key: str, vec: str | None, exclude: str | None) -> Queries:
    """The query side as arrays on the driver; the caller has counted its size."""
    cols = [F.col(query_key).cast("long").alias("id")]
    if vec:
        cols.append(F.col(vec).alias("v"))
    if exclude:
        cols += list(patch_key_hashes(exclude))
    t = queries.select(*cols).toArrow().combine_chunks()
    ids = t.column("id").to_numpy()
    vectors = _vector_matrix(t.column("v").combine_chunks()) if vec else None
    ident = {c: t.column(c).to_numpy(zero_copy_only=False) for c in IDENTITY} if exclude else None
    return Queries(ids, vectors, ident)


def _add_postings(q: Queries, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, total: np.ndarray, mark) -> None:
    """Add a chunk's postings, each contribution rounded, to ``total`` (documents x queries).

    A term of many queries is a row of all of them, added to its documents one by one; one of
    some is added at their places; the others are counted all at once. ``mark``: called with the
    flat places of every match, unless None.
    """
    n_docs, nq = total.shape
    begin, end = q.begin[term], q.begin[term + 1]
    count = end - begin
    full = (count >= OUTER) & (count * ROW_SHARE >= nq)
    by = np.flatnonzero(full)
    by = by[np.argsort(term[by], kind="stable")]
    own, last = np.empty(nq), -1
    for i, t, d, w in zip(by.tolist(), term[by].tolist(), doc[by].tolist(), weight[by].tolist()):
        if t != last:
            row, last = np.zeros(nq), t
            row[q.who[begin[i]:end[i]]] = q.weight[begin[i]:end[i]]
        np.multiply(row, w, out=own)
        np.add(own, 0.5, out=own)
        np.floor(own, out=own)
        total[d] += own
        if mark is not None:
            mark(d * nq + q.who[begin[i]:end[i]])
    at = np.flatnonzero((count >= OUTER) & ~full)
    for b, e, d, w in zip(begin[at].tolist(), end[at].tolist(), doc[at].tolist(), weight[at].tolist()):
        who = q.who[b:e]
        own = q.weight[b:e] * w
        own += 0.5
        np.floor(own, out=own)
        scores = total[d]
        scores[who] += own  # a query has a term once
        if mark is not None:
            mark(d * nq + who)
    rest = count < OUTER
    doc, weight, first, count = doc[rest], weight[rest], begin[rest], count[rest]
    total = total.reshape(-1)
    cum = np.cumsum(count)
    lo = 0
    while lo < len(count):
        base = cum[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(cum, base + CELLS, "right")))
        c = count[lo:hi]
        at = np.arange(c.sum()) + np.repeat(first[lo:hi] - (cum[lo:hi] - c - base), c)
        flat = q.who[at] + np.repeat(doc[lo:hi] * nq, c)
        own = q.weight[at] * np.repeat(weight[lo:hi], c)
        own += 0.5
        np.floor(own, out=own)
        np.add.at(total, flat, own)
        if mark is not None:
            mark(flat)
        lo = hi


def lexical_block(q: Queries, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """BM25 in whole units of a chunk's documents against all queries, and the hit mask.

    doc, term, weight: the chunk's postings of queried terms. Contributions are rounded as
    in ``lexical.match_postings``; sums of whole numbers below 2**53 are exact in doubles.
    """
    # documents are rows here, so that the queries of a term lie side by side
    total, hits = np.zeros((n_docs, len(q.ids))), None
    if not len(term) or q.weight.min(initial=1.0) * weight.min() < 0.5:
        hits = np.zeros(total.size, bool)  # a match may be rounded to 0: hits are marked one by one
    _add_postings(q, doc, term, weight, total, hits if hits is None else lambda at: np.put(hits, at, True))
    hits = total > 0 if hits is None else hits.reshape(total.shape)
    total /= SCORE_SCALE
    return np.ascontiguousarray(total.T), np.ascontiguousarray(hits.T)


class Products:
    """``lexical_block`` by matrix products, for sums that no rank depends on (profiles).

    The terms of most queries are columns of a matrix of at most ``COLUMNS`` terms, and their
    contributions aren't rounded: a score differs by less than half a unit of ``SCORE_SCALE`` a term.
    """

    def __init__(self, q: Queries):
        self.q = q
        # a term of more postings than documents (repeated keys) weighs less than 0: then a sum doesn't tell hits
        self.above = not len(q.weight) or q.weight.min() > 0
        count = np.diff(q.begin) if q.n_terms else np.zeros(0, np.int64)
        most = np.argsort(-count, kind="stable")[:COLUMNS]
        most = most[(count[most] >= OUTER) & (count[most] * COLUMN_SHARE >= len(q.ids))]
        self.column = np.full(q.n_terms, -1)
        self.column[most] = np.arange(len(most))
        self.weights = np.zeros((len(most), len(q.ids)))
        for i, t in enumerate(most.tolist()):
            self.weights[i, q.who[q.begin[t]:q.begin[t + 1]]] = q.weight[q.begin[t]:q.begin[t + 1]]

    def block(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        if not self.above:
            return lexical_block(self.q, doc, term, weight, n_docs)
        column = self.column[term]
        known = column >= 0
        d = np.bincount(doc[known] * len(self.weights) + column[known], weights=weight[known], minlength=n_docs * len(self.weights)).reshape(n_docs, -1)
        total = d @ self.weights if len(self.weights) else np.zeros((n_docs, len(self.q.ids)))
        _add_postings(self.q, doc[~known], term[~known], weight[~known], total, None)
        # a sum is above 0 where a term is shared
        hits = total > 0
        total /= SCORE_SCALE
        return np.ascontiguousarray(total.T), np.ascontiguousarray(hits.T)


class Best:
    """The best ``k`` documents of every query so far, by (score desc, document key asc)."""

    def __init__(self, n_queries: int, k: int):
        self.k, self.floor = k, np.full(n_queries, -np.inf)
        self.q = self.doc = np.zeros(0, np.int64)
        self.score = np.zeros(0)

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        """scores: queries x documents; -inf for pairs that are no candidates."""
        kk = min(self.k, scores.shape[1])
        if not kk:
            return
        # a document below the chunk's own k-th best can't win either
        least = np.maximum(self.floor, -np.partition(-scores, kk - 1, axis=1)[:, kk - 1])
        q, d = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        self.q, self.doc, self.score = np.r_[self.q, q], np.r_[self.doc, docs[d]], np.r_[self.score, scores[q, d]]
        order = np.lexsort((self.doc, -self.score, self.q))
        first = np.searchsorted(self.q[order], np.arange(len(self.floor) + 1))
        rank = np.arange(len(order)) - first[self.q[order]]
        order = order[rank < self.k]
        self.q, self.doc, self.score = self.q[order], self.doc[order], self.score[order]
        last = np.searchsorted(self.q, np.arange(len(self.floor)), "right") - 1
        full = np.bincount(self.q, minlength=len(self.floor)) >= self.k
        self.floor[full] = self.score[last[full]]

    def batch(self, ids: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids[self.q]), pa.array(self.doc), pa.array(self.score)], ["query_id", "doc_id", "score"])


def weighted_terms(index, queries: DataFrame, query_key: str, query_fields) -> DataFrame | None:
    """``(query_id, field, term, w)``: ``qtf * idf`` of the query terms that the index knows."""
    terms = None
    for f in index.fields:
        n, _ = index.stats[f]
        if n:
            idf = F.log(F.lit(1.0) + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
            part = index.terms.where(F.col("field") == f).select("field", "term", idf.alias("idf"))
            terms = part if terms is None else terms.unionByName(part)
    if terms is None:
        return None
    asked = query_terms(queries, query_key, query_fields).join(terms, "term")
    return materialize(asked.select("query_id", "field", "term", (F.col("qtf") * F.col("idf")).alias("w")), "asked")


def restricted(index, weighted: DataFrame, corpus: DataFrame, q: Queries, *, doc_key: str, vec: str | None,
               exclude: str | None) -> DataFrame:
    """``(doc_id, v, identity, terms, weights)`` of every corpus row, restricted to queried terms.

    Sets the queries' terms on ``q`` as well. A narrow pass: rows keep their partition.
    """
    spark = corpus.sparkSession
    t = weighted.toArrow().combine_chunks()
    coded = pc.binary_join_element_wise(t.column("field"), t.column("term"), "|").combine_chunks().dictionary_encode()
    number = np.asarray(coded.indices, np.int64)
    q.set_terms(t.column("query_id").to_numpy(), number, t.column("w").to_numpy(), len(coded.dictionary))
    known = {}
    for f in index.fields:
        mine = np.asarray(pc.starts_with(coded.dictionary, f + "|"), bool)
        known[f] = (pc.utf8_slice_codeunits(coded.dictionary.filter(pa.array(mine)), len(f) + 1), np.flatnonzero(mine))
    sent = spark.sparkContext.broadcast(known)
    stats = {f: index.stats[f] for f in index.fields}
    fields = tuple(index.fields)

    corpus = spread(corpus.select(*{doc_key, *([vec] if vec else []), *([exclude] if exclude else []), *index.fields}))
    cols = [F.col(doc_key).cast("long").alias("doc_id")]
    kind = _vector_type(corpus, vec)
    cols.append(F.col(vec).alias("v") if vec else F.lit(None).cast(kind).alias("v"))
    cols += list(patch_key_hashes(exclude)) if exclude else [F.lit(None).cast("long").alias("pk1"), F.lit(None).cast("long").alias("pk2"), F.lit(False).alias("pk_set")]
    cols += [tokenize(null_to_empty(f)).alias(f"tokens_{i}") for i, f in enumerate(fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in token_slices(whole, 5)):
            doc, term, weight = [], [], []
            for i, f in enumerate(fields):
                values, numbers = sent.value[f]
                avgdl = stats[f][1]
                column = batch.column(5 + i)
                size = np.asarray(pc.list_value_length(column), np.int64)
                row = np.repeat(np.arange(len(size)), size)
                at = np.asarray(pc.fill_null(pc.index_in(pc.list_flatten(column), value_set=values), -1), np.int64)
                hit = at >= 0
                key, tf = np.unique(row[hit] * np.int64(max(1, len(numbers))) + at[hit], return_counts=True)
                r = key // max(1, len(numbers))
                doc.append(r)
                term.append(numbers[key % max(1, len(numbers))])
                weight.append(tf / (tf + K1 * ((1.0 - B) + B * size[r] / avgdl)) * SCORE_SCALE if len(r) else np.zeros(0))
            doc, term, weight = np.concatenate(doc), np.concatenate(term), np.concatenate(weight)
            by = np.argsort(doc, kind="stable")
            off = pa.array(np.searchsorted(doc[by], np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.ListArray.from_arrays(off, pa.array(term[by].astype(np.int32))), pa.ListArray.from_arrays(off, pa.array(weight[by]))],
                ["doc_id", "v", *IDENTITY, "terms", "weights"])

    return corpus.select(*cols).mapInArrow(run, f"doc_id long, v {kind}, pk1 long, pk2 long, pk_set boolean, terms array<int>, weights array<double>")


def _chunks(batches: Iterator[pa.RecordBatch], nq: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, CELLS // max(1, nq))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _lexical_chunk(q: Queries, part: pa.RecordBatch, terms: int, weights: int, block=None) -> tuple[np.ndarray, np.ndarray]:
    """``lexical_block`` of a chunk, or a ``Products.block`` of it."""
    lists = part.column(terms)
    doc = np.repeat(np.arange(part.num_rows), np.asarray(pc.list_value_length(lists), np.int64))
    own = doc, np.asarray(pc.list_flatten(lists), np.int64), np.asarray(pc.list_flatten(part.column(weights))), part.num_rows
    return block(*own) if block else lexical_block(q, *own)


def lexical_stats(rows: DataFrame, sent, products: bool = False) -> DataFrame:
    """``(query_id, mx, mn0, hits)``: largest and smallest BM25 of the hits of every query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        mx, mn, n = np.full(len(q.ids), -np.inf), np.full(len(q.ids), np.inf), np.zeros(len(q.ids), np.int64)
        block = Products(q).block if products else None
        for part in _chunks(batches, len(q.ids)):
            s, h = _lexical_chunk(q, part, 0, 1, block)
            if part.num_rows:
                mx = np.maximum(mx, np.where(h, s, -np.inf).max(axis=1))
                mn = np.minimum(mn, np.where(h, s, np.inf).min(axis=1))
                n += h.sum(axis=1)
        ok = n > 0
        yield pa.RecordBatch.from_arrays([pa.array(q.ids[ok]), pa.array(mx[ok]), pa.array(mn[ok]), pa.array(n[ok])], ["query_id", "mx", "mn0", "hits"])

    return (rows.select("terms", "weights").mapInArrow(run, "query_id long, mx double, mn0 double, hits long")
            .groupBy("query_id").agg(F.max("mx").alias("mx"), F.min("mn0").alias("mn0"), F.sum("hits").alias("hits")))


def _best_rows(rows: DataFrame, sent, k: int, w_cos: float, w_lex: float, hits_only: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        best = Best(len(q.ids), k)
        for part in _chunks(batches, len(q.ids)):
            n = part.num_rows
            out = np.zeros((len(q.ids), n))
            if w_cos != 0:
                v = _vector_matrix(part.column(1))
                if v.shape[1] and q.vectors.shape[1]:
                    if v.shape[1] != q.vectors.shape[1]:
                        raise ValueError(f"vectors of different widths: {sorted({v.shape[1], q.vectors.shape[1]})}")
                    out = (q.vectors @ v.T) * w_cos
            if w_lex != 0 and q.n_terms:
                s, h = _lexical_chunk(q, part, 5, 6)
                if hits_only:
                    out = np.where(h, s, -np.inf)
                else:
                    span = (q.high - q.low)[:, None]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        out[h] += (w_lex * np.where(span > 0, (s - q.low[:, None]) / span, 0.0))[h]
            elif hits_only:
                out[:] = -np.inf
            if q.identity is not None:
                same = ((q.identity["pk1"][:, None] == part.column(2).to_numpy()[None, :])
                        & (q.identity["pk2"][:, None] == part.column(3).to_numpy()[None, :])
                        & q.identity["pk_set"].astype(bool)[:, None])
                out[same] = -np.inf
            best.add(out, part.column(0).to_numpy())
        yield best.batch(q.ids)

    return rows.mapInArrow(run, dense.CAND_SCHEMA)


def cosine_rows(corpus: DataFrame, doc_key: str, vec: str, exclude: str | None) -> DataFrame:
    """Corpus rows of a pure vector search, in the layout of ``restricted``."""
    ident = list(patch_key_hashes(exclude)) if exclude else [F.lit(None).cast("long").alias("pk1"), F.lit(None).cast("long").alias("pk2"), F.lit(False).alias("pk_set")]
    return spread(corpus.select(F.col(doc_key).cast("long").alias("doc_id"), F.col(vec).alias("v"), *ident))


def _passes(size: int, limit: int) -> int:
    """Passes over the corpus for a query side of this size; 0 if blocks take it."""
    n = max(1, math.ceil(size / limit)) if limit > 0 else 0
    return n if n <= MAX_PASSES else 0


def _in_passes(search, queries: DataFrame, query_key: str, passes: int) -> DataFrame:
    """The results of a search for disjoint parts of the queries; a part is sent whatever its size."""
    queries = materialize(queries, "queries")
    part = F.pmod(F.xxhash64(F.col(query_key).cast("long")), F.lit(passes))
    out = None
    for i in range(passes):
        own = queries.where(part == i)
        if not own.isEmpty():
            found = search(own)
            out = found if out is None else out.unionByName(found)
    return out


def cosine_topk(queries: DataFrame, corpus: DataFrame, k: int = 2, *, query_key: str = "query_id", doc_key: str = "doc_id",
                vec: str = "v", exclude_identical: str | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Exact top ``k`` by cosine: one pass over the corpus, no exchange below the candidates."""
    passes = _passes(query_bytes(queries, vec, None), limit)
    if not passes:
        return dense.block_topk(queries, corpus, k, query_key=query_key, doc_key=doc_key, vec=vec, exclude_identical=exclude_identical)
    if passes > 1:
        return _in_passes(lambda q: cosine_topk(q, corpus, k, query_key=query_key, doc_key=doc_key, vec=vec, exclude_identical=exclude_identical, limit=UNBOUNDED),
                          queries, query_key, passes)
    q = collect_queries(queries, query_key, vec, exclude_identical)
    sent = corpus.sparkSession.sparkContext.broadcast(q)
    return top_k(_best_rows(cosine_rows(corpus, doc_key, vec, exclude_identical), sent, k, 1.0, 0.0, False), k)


def hybrid_topk(index, queries: DataFrame, corpus: DataFrame, k: int = 2, *, w_cos: float = 0.5, w_lex: float = 0.5,
                query_key: str = "query_id", doc_key: str = "doc_id", vec: str = "v", query_fields=("diff", "ast_seq"),
                exclude_identical: str | None = None, limit: int = BROADCAST_BYTES,
                n_queries: int | None = None, stats_bounded: bool = False) -> DataFrame:
    """Exact top ``k`` by ``w_cos * cosine + w_lex * minmax(BM25)`` over a streamed corpus.

    Same rows as ``dense.hybrid_topk``, to which query tables above ``limit`` bytes go.
    """
    spark = corpus.sparkSession
    weighted = weighted_terms(index, queries, query_key, query_fields) if w_lex != 0 else None
    passes = _passes(query_bytes(queries, vec if w_cos else None, weighted), limit)
    if passes > 1:
        return _in_passes(lambda q: hybrid_topk(index, q, corpus, k, w_cos=w_cos, w_lex=w_lex, query_key=query_key, doc_key=doc_key, vec=vec,
                                                query_fields=query_fields, exclude_identical=exclude_identical, limit=UNBOUNDED), queries, query_key, passes)
    if not passes:
        return dense.hybrid_topk(index, queries, corpus, k, w_cos=w_cos, w_lex=w_lex, query_key=query_key, doc_key=doc_key, vec=vec,
                                 query_fields=query_fields, exclude_identical=exclude_identical, n_queries=n_queries, stats_bounded=stats_bounded)
    q = collect_queries(queries, query_key, vec if w_cos else None, exclude_identical)
    if weighted is None:
        rows = cosine_rows(corpus, doc_key, vec, exclude_identical)
        return top_k(_best_rows(rows, spark.sparkContext.broadcast(q), k, w_cos, 0.0, False), k)
    rows = materialize(restricted(index, weighted, corpus, q, doc_key=doc_key, vec=vec if w_cos else None, exclude=exclude_identical), "restricted")
    # a row per query: no larger than the query side that was counted
    found = lexical_stats(rows, spark.sparkContext.broadcast(q)).toArrow().combine_chunks()
    q.low, q.high = np.zeros(len(q.ids)), np.zeros(len(q.ids))
    at = np.searchsorted(q.ids, found.column("query_id").to_numpy())
    dense_row = found.column("hits").to_numpy() >= index.n_corpus
    q.high[at] = found.column("mx").to_numpy()
    q.low[at] = np.where(dense_row, found.column("mn0").to_numpy(), 0.0)
    return top_k(_best_rows(rows, spark.sparkContext.broadcast(q), k, w_cos, w_lex, False), k)


def lexical_topk(index, queries: DataFrame, corpus: DataFrame, k: int = 2, *, query_key: str = "query_id", doc_key: str = "doc_id",
                 query_fields=("diff", "ast_seq"), limit: int = BROADCAST_BYTES) -> DataFrame:
    """Top ``k`` hits per query by raw BM25 over a streamed corpus (W1 on A2)."""
    spark = corpus.sparkSession
    weighted = weighted_terms(index, queries, query_key, query_fields)
    passes = _passes(query_bytes(queries, None, weighted), limit) if weighted is not None else 0
    if not passes:
        return dense.lexical_topk(index, queries, k, query_key=query_key, query_fields=query_fields)
    if passes > 1:
        return _in_passes(lambda q: lexical_topk(index, q, corpus, k, query_key=query_key, doc_key=doc_key, query_fields=query_fields, limit=UNBOUNDED),
                          queries, query_key, passes)
    q = collect_queries(queries, query_key, None, None)
    rows = restricted(index, weighted, corpus, q, doc_key=doc_key, vec=None, exclude=None)
    return top_k(_best_rows(rows, spark.sparkContext.broadcast(q), k, 0.0, 1.0, True), k)
