"""Lexical scores from the side of the documents: the postings of the queries' terms are brought
together by document once, and every document is then scored against all broadcast queries where
it lies (A2, A6 at scale).

An index of which a row is a whole document is read as it lies, and nothing is exchanged. Else
(several fields, repeated keys, term-clustered postings) postings of queried terms are, a row each,
not (query, document) pairs: it grows with the corpus, whatever the number of queries. A task holds
one chunk of ``CELLS`` scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffsieve.operators import streamtop
from diffsieve.operators.lexical import BROADCAST_ROWS, SCORE_SCALE, term_key, token_slices
from diffsieve.session import materialize

SCORE_SCHEMA = "query_id long, doc_id long, score double"
PROFILE_SCHEMA = "query_id long, other_id long, sim double"


def keyed(index, qt: DataFrame) -> DataFrame:
    """``(query_id, field, term, key, w)`` of query terms ``(query_id, term, qtf)`` that the index knows."""
    parts = None
    for f in index.fields:
        n = index.stats[f][0]
        if n:
            idf = F.log(F.lit(1.0) + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
            part = index.terms.where(F.col("field") == f).select("field", "term", idf.alias("idf"))
            parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return qt.select("query_id", F.lit("").alias("field"), "term", F.lit(None).cast("long").alias("key"), F.lit(0.0).alias("w")).where(F.lit(False))
    return qt.join(parts, "term").select("query_id", "field", "term", term_key(index).alias("key"), (F.col("qtf") * F.col("idf")).alias("w"))


def doc_rows(index, asked: DataFrame, k1: float, b: float, rows: int) -> DataFrame:
    """``(doc_id, keys, weights)``: a row per document with the postings of the ``asked`` terms.

    ``rows``: counted size of ``asked``; up to ``BROADCAST_ROWS`` its keys are broadcast.
    """
    if index.docs is not None and index.store is None:
        return _whole_docs(index, asked if rows <= BROADCAST_ROWS else None, k1, b)
    postings = index.postings if index.store is None else index.store.postings(asked)
    weight = F.lit(None).cast("double")
    for f in index.fields:
        n, avgdl = index.stats[f]
        if n:
            # the document side of a term's weight, as in ``lexical.match_postings``
            norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.lit(avgdl))
            weight = F.when(F.col("field") == f, F.col("tf") / (F.col("tf") + norm) * F.lit(SCORE_SCALE)).otherwise(weight)
    known = asked.select("key").distinct()
    hits = (postings.select("doc_id", term_key(index).alias("key"), weight.alias("weight"))
            .join(F.broadcast(known) if rows <= BROADCAST_ROWS else known, "key", "left_semi"))
    return hits.groupBy("doc_id").agg(F.collect_list("key").alias("keys"), F.collect_list("weight").alias("weights"))


def _whole_docs(index, asked: DataFrame | None, k1: float, b: float) -> DataFrame:
    """``doc_rows`` of an index that holds whole documents; without ``asked`` the postings of all terms."""
    n, avgdl = index.stats[index.fields[0]]
    key = term_key(index)
    known = asked.select("term", "key") if asked is not None else None
    if asked is None:
        own = F.expr("transform(counts, c -> c.term)")
        kind = "xxhash64(field, t)" if index.hash_unique else "concat(field, '|', t)"
        norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.lit(avgdl))
        rows = index.docs.select("doc_id", "field", own.alias("terms"), "counts", norm.alias("norm"))
        weight = F.transform("counts", lambda c: c["tf"] / (c["tf"] + F.col("norm")) * F.lit(SCORE_SCALE))
        return rows.select("doc_id", F.expr(f"transform(terms, t -> {kind})").alias("keys"), weight.alias("weights"))
    t = known.distinct().toArrow().combine_chunks()
    sent = index.docs.sparkSession.sparkContext.broadcast(t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, keys = (sent.value.column(i).combine_chunks() for i in range(2))
        for batch in (part for whole in batches for part in token_slices(whole, 2)):
            lists = batch.column(2)
            row = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(lists), np.int64))
            term, tf = pc.list_flatten(lists).flatten()
            at = pc.index_in(term, value_set=terms)
            hit = np.asarray(at.is_valid())
            row, tf, dl = row[hit], np.asarray(tf)[hit], np.asarray(batch.column(1), np.int64)
            # the document side of a term's weight, as in ``lexical.match_postings``
            weight = tf / (tf + k1 * ((1.0 - b) + b * dl[row] / avgdl)) * SCORE_SCALE
            off = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(off, keys.take(at.drop_null())), pa.ListArray.from_arrays(off, pa.array(weight))],
                                             ["doc_id", "keys", "weights"]).filter(pa.array(np.diff(np.asarray(off)) > 0))

    kind = asked.schema["key"].dataType.simpleString().replace("bigint", "long")
    return index.docs.select("doc_id", "dl", "counts").mapInArrow(run, f"doc_id long, keys array<{kind}>, weights array<double>")


def numbered(rows: DataFrame, keys) -> DataFrame:
    """``(doc_id, terms, weights)``: keys replaced by their place in the broadcast ``keys``; others go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            row = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(lists), np.int64))
            at = np.asarray(pc.fill_null(pc.index_in(pc.list_flatten(lists), value_set=keys.value), -1), np.int32)
            hit = at >= 0
            off = pa.array(np.searchsorted(row[hit], np.arange(batch.num_rows + 1)).astype(np.int32))
            weight = pc.list_flatten(batch.column(2)).filter(pa.array(hit))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(off, pa.array(at[hit])), pa.ListArray.from_arrays(off, weight)],
                                             ["doc_id", "terms", "weights"])

    return rows.mapInArrow(run, "doc_id long, terms array<int>, weights array<double>")


def _coded(asked: pa.Table, slot: np.ndarray, n_slots: int) -> tuple[streamtop.Queries, pa.Array]:
    """Query side with a slot per query, and the distinct keys in the order of their numbers."""
    key = asked.column("key").combine_chunks().dictionary_encode()
    q = streamtop.Queries(np.arange(n_slots), None, None)
    q.set_terms(slot, np.asarray(key.indices, np.int64), asked.column("w").to_numpy(), len(key.dictionary))
    return q, key.dictionary


def _scores_slice(rows: DataFrame, asked: DataFrame, best: int | None) -> DataFrame:
    spark = rows.sparkSession
    t = asked.select("query_id", "key", "w").toArrow().combine_chunks()
    if not t.num_rows:
        return spark.createDataFrame([], SCORE_SCHEMA)
    ids = t.column("query_id").combine_chunks()
    ids, column = ids.unique(), ids
    q, keys = _coded(t, np.asarray(pc.index_in(column, value_set=ids), np.int64), len(ids))
    context = spark.sparkContext
    sent = context.broadcast((q, ids))
    null = np.iinfo(np.int64).min  # stands first, as null does

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, ids = sent.value
        top = streamtop.Best(len(q.ids), best) if best else None
        for part in streamtop._chunks(batches, len(q.ids)):
            s, h = streamtop._lexical_chunk(q, part, 1, 2)
            if top:
                top.add(np.where(h, s, -np.inf), part.column(0).fill_null(null).to_numpy())
                continue
            who, doc = np.nonzero(h)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(who)), part.column(0).take(pa.array(doc)), pa.array(s[who, doc])], ["query_id", "doc_id", "score"])
        if top:
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(top.q)), pa.array(top.doc, mask=top.doc == null), pa.array(top.score)], ["query_id", "doc_id", "score"])

    return numbered(rows, context.broadcast(keys)).mapInArrow(run, SCORE_SCHEMA)


def scores(index, qt: DataFrame, k1: float, b: float, passes: int = 1, best: int | None = None) -> DataFrame:
    """``(query_id, doc_id, score)`` of the hits of counted query terms ``qt``: of all, or of
    each task's ``best`` a query. With several ``passes`` the document rows are written once."""
    asked = materialize(keyed(index, qt), "asked")
    rows = doc_rows(index, asked, k1, b, asked.count())
    if passes == 1:
        return _scores_slice(rows, asked, best)
    rows = materialize(rows, "documents")
    out = None
    for i in range(passes):
        part = _scores_slice(rows, asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i), best)
        out = part if out is None else out.unionByName(part)
    return out


def _slots(ids: np.ndarray, batch_size: int) -> tuple[np.ndarray, int, int]:
    """Slot of each sorted distinct id -- ``width`` of them a batch --, the width, and the batches."""
    batch = ids // batch_size
    _, first, inverse, size = np.unique(batch, return_index=True, return_inverse=True, return_counts=True)
    width = int(size.max()) if len(ids) else 1
    return inverse * width + np.arange(len(ids)) - first[inverse], width, len(first)


def _profile_slice(index, rows: DataFrame, queries: DataFrame, asked: DataFrame, batch_size: int) -> DataFrame:
    """Profile of whole batches of queries that fit a broadcast: one pass for their statistics, one
    for a partial Gram matrix of every batch a task."""
    spark = queries.sparkSession
    context = spark.sparkContext
    ids = np.unique(queries.toArrow().column("query_id").to_numpy())
    t = asked.select("query_id", "key", "w").toArrow().combine_chunks()
    slot, width, n = _slots(ids, batch_size)
    q, keys = _coded(t, slot[np.searchsorted(ids, t.column("query_id").to_numpy())], n * width)
    docs = numbered(rows, context.broadcast(keys))
    found = streamtop.lexical_stats(docs, context.broadcast(q), products=True).toArrow().combine_chunks()
    q.low, q.high = np.zeros(n * width), np.zeros(n * width)
    at = found.column("query_id").to_numpy()
    q.high[at] = found.column("mx").to_numpy()
    q.low[at] = np.where(found.column("hits").to_numpy() >= index.n_corpus, found.column("mn0").to_numpy(), 0.0)
    sent = context.broadcast(q)
    names = np.full(n * width, -1)
    names[slot] = np.arange(len(ids))
    place = context.broadcast((names, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        gram = np.zeros((n, width, width))
        span = (q.high - q.low)[:, None]
        # scores that are equal but for less than their unit are equal
        some = span > 0.5 / SCORE_SCALE
        block = streamtop.Products(q).block
        for part in streamtop._chunks(batches, len(q.ids)):
            s, h = streamtop._lexical_chunk(q, part, 1, 2, block)
            x = np.divide(s - q.low[:, None], span, out=np.zeros_like(s), where=h & some).reshape(n, width, -1)
            gram += x @ x.transpose(0, 2, 1)
        some = np.flatnonzero(gram.any(axis=(1, 2)))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * np.int32(width * width)), pa.array(gram[some].ravel()))],
                                         ["batch", "gram"])

    def whole(table: pa.Table) -> pa.Table:
        names, ids = place.value
        g = np.zeros((width, width))
        for part in table.column("gram").chunks:
            g += np.asarray(pc.list_flatten(part)).reshape(-1, width, width).sum(axis=0)
        own = names[table.column("batch")[0].as_py() * width:][:width]
        used = own >= 0
        g, own = g[np.ix_(used, used)], ids[own[used]]
        norm = np.sqrt(np.diag(g))
        both = np.multiply.outer(norm, norm)
        sim = np.divide(g, both, out=np.zeros_like(g), where=both > 0)
        return pa.table({"query_id": np.repeat(own, len(own)), "other_id": np.tile(own, len(own)), "sim": sim.ravel()})

    # a batch without any hit gets an empty matrix, so that its pairs are there with 0
    every = spark.range(n).select(F.col("id").alias("batch"), F.array_repeat(F.lit(0.0), width * width).alias("gram"))
    grams = docs.mapInArrow(run, "batch long, gram array<double>").unionByName(every)
    return grams.groupBy("batch").applyInArrow(whole, PROFILE_SCHEMA)


def profile(index, queries: DataFrame, qt: DataFrame, batch_size: int, k1: float, b: float, limit: int | None = None) -> DataFrame:
    """``(query_id, other_id, sim)``: cosine of the min-max normalised BM25 rows of all pairs of a batch.

    ``queries (query_id)``, ``qt (query_id, term, qtf)``. Query tables over ``limit`` bytes (counted)
    take several passes over the document rows, which are written once; nothing is copied per pass.
    """
    limit = streamtop.BROADCAST_BYTES if limit is None else limit
    asked = materialize(keyed(index, qt.where(F.col("query_id").isNotNull())), "asked")
    queries = materialize(queries.where(F.col("query_id").isNotNull()).distinct(), "queries")
    n_asked, n = asked.count(), queries.count()
    if not n:
        return queries.sparkSession.createDataFrame([], PROFILE_SCHEMA)
    rows = materialize(doc_rows(index, asked, k1, b, n_asked), "documents")
    parts = max(1, math.ceil(40 * (n_asked + n) / max(1, limit)))
    out = None
    for i in range(parts):
        mine = F.pmod(F.xxhash64(F.expr(f"(query_id - pmod(query_id, {batch_size}L)) div {batch_size}L")), F.lit(parts)) == i
        own = queries.where(mine)
        if parts > 1 and own.isEmpty():
            continue
        part = _profile_slice(index, rows, own, asked.where(mine), batch_size)
        out = part if out is None else out.unionByName(part)
    return out
