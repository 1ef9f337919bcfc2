"""Lexical retrieval: index tables, term statistics, BM25."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffsieve.functions.text import null_to_empty, tokenize
from diffsieve.session import default_parallelism, materialize

# BM25 parameters of the similarity the reference uses.
K1 = 1.2
B = 0.75

# Scores are summed as integers in units of 2**-32 so that a sum does not depend on the
# order in which partitions arrive: equal documents get bit-equal scores and ties are
# then broken by key, whatever the partitioning. A binary unit keeps every score exact
# in a double and off the decimal grid, so rounding a score for display never meets an
# exact half.
SCORE_SCALE = float(2 ** 32)

# A query-term side up to this many rows is broadcast (the count is taken first).
BROADCAST_ROWS = 1_000_000
# A larger one takes up to this many passes over the documents, each with a part of the queries.
MAX_PASSES = 64
# Postings of one (field, term) are spread over ceil(df / SALT_ROWS) salt groups, so a
# term found in a third of all documents is still joined by many tasks.
SALT_ROWS = 1_000_000


def term_key(index) -> "F.Column":
    """A join key for ``(field, term)`` inside the block kernels.

    ``xxhash64(field, term)`` when it is unique over the index vocabulary (checked
    exactly, once per index, by one aggregate over the term table); otherwise the text
    ``field|term`` (terms never contain ``|``). Query terms outside the vocabulary are
    dropped by their join with the term table first, so uniqueness over the
    vocabulary is all that exactness needs.
    """
    if index.hash_unique is None:
        r = index.terms.agg(F.count(F.lit(1)).alias("n"),
                            F.countDistinct(F.xxhash64("field", "term")).alias("u")).first()
        index.hash_unique = r["n"] == r["u"]
    if index.hash_unique:
        return F.xxhash64("field", "term")
    return F.concat(F.col("field"), F.lit("|"), F.col("term"))


def _salt_rows(index) -> int:
    return getattr(index, "salt_rows", SALT_ROWS)


@dataclass
class LexicalIndex:
    """Index tables over a corpus.

    ``postings(field, term, doc_id, tf, dl, salt)`` and ``terms(field, term, df, cf,
    n_salt)`` are DataFrames (lazy or read back from Parquet); ``stats`` maps each field
    to ``(docs_with_field, avgdl)``; ``n_corpus`` is the corpus row count and
    ``min_key`` its smallest key (the reference's "row 0").
    """

    postings: DataFrame
    terms: DataFrame
    stats: dict
    n_corpus: int
    min_key: int | None
    fields: tuple
    salt_rows: int = SALT_ROWS
    hash_unique: bool | None = None
    store: object = None  # term-clustered postings (``sources.index_store.TermStore``), if built
    # ``(doc_id, field, dl, counts)``, if a row of it is a whole document: one field, and no key twice or null
    docs: DataFrame | None = None


def spread(corpus: DataFrame, partitions: int | None = None) -> DataFrame:
    """The corpus as it is if it fills the task slots; a smaller one is dealt out first.

    Counted over the partition numbers alone. On data worth distributing the scan has far
    more partitions than slots, and nothing is exchanged.
    """
    slots = partitions or default_parallelism(corpus.sparkSession)
    filled = corpus.select(F.spark_partition_id().alias("p")).distinct().count()
    return corpus if filled >= slots else corpus.repartition(slots)


# Tokens or postings that a Python worker takes at a time; a longer text is taken by itself.
SLICE_TOKENS = 200_000


def token_slices(batch: pa.RecordBatch, first: int) -> Iterator[pa.RecordBatch]:
    """An Arrow batch in runs of rows of about ``SLICE_TOKENS`` tokens, counted over its token
    lists (the columns from ``first`` on), so that a worker's arrays don't grow with the batch."""
    size = sum(np.asarray(pc.fill_null(pc.list_value_length(c), 0), np.int64) for c in batch.columns[first:])
    end = np.cumsum(size)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(end, (end[lo - 1] if lo else 0) + SLICE_TOKENS, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _doc_counts(corpus: DataFrame, key: str, fields) -> DataFrame:
    """``(doc_id, field, dl, counts)``, a row per text with tokens and its ``(term, tf)`` in one
    list: the tokens are sorted and counted in the JVM inside the text's own row, so no worker
    holds more than one text at a time, however many a batch or partition has."""
    texts = F.array(*[F.struct(F.lit(f).alias("field"), F.sort_array(tokenize(null_to_empty(f))).alias("t")) for f in fields])
    rows = corpus.select(F.col(key).cast("long").alias("doc_id"), F.inline(texts)).where(F.size("t") > 0)
    # the first place of each term (outside the list ``get`` is null, and no token is); the array of
    # one element makes the places a variable, so that they are found once a text
    first = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: ~F.get("t", i).eqNullSafe(F.get("t", i - 1)))
    tf = lambda p, i, n: (F.coalesce(F.get(p, n + 1), F.size("t")) - i).cast("long")
    counts = F.get(F.transform(F.array(first), lambda p: F.transform(p, lambda i, n: F.struct(F.get("t", i).alias("term"), tf(p, i, n).alias("tf")))), 0)
    return rows.select("doc_id", "field", F.size("t").alias("dl"), counts.alias("counts"))


def flat(docs: DataFrame) -> DataFrame:
    """``(doc_id, field, term, dl, tf)``: a row per posting of ``_doc_counts``."""
    return docs.select("doc_id", "field", "dl", F.inline("counts")).select("doc_id", "field", "term", "dl", "tf")


def salted_postings(tf: DataFrame, terms: DataFrame, stats: dict, salt_rows: int) -> DataFrame:
    """Postings with their salt group: ``pmod(xxhash64(doc_id), n_salt)``.

    Only terms in more than ``salt_rows`` documents have ``n_salt > 1``. There are at
    most (number of postings / salt_rows) of them -- a proven bound -- so their table
    is broadcast and the postings are never shuffled by term. When no field has more
    than ``salt_rows`` documents no term can be hot and every salt is 0.
    """
    if not any(st[0] > salt_rows for st in stats.values()):
        return tf.withColumn("salt", F.lit(0))
    hot = F.broadcast(terms.where(F.col("n_salt") > 1).select("field", "term", "n_salt"))
    return (tf.join(hot, ["field", "term"], "left")
            .withColumn("salt", F.pmod(F.xxhash64("doc_id"),
                                       F.coalesce(F.col("n_salt"), F.lit(1))).cast("int"))
            .drop("n_salt"))


def build_index(corpus: DataFrame, key: str = "doc_id", fields=("diff",),
                salt_rows: int = SALT_ROWS, partitions: int | None = None,
                path: str | None = None) -> LexicalIndex:
    """Index tables of a corpus (A1), written once and read back.

    Every text is counted where it lies, inside its row, so no text is shuffled, and all its
    postings stand in one row of ``docs``; whether keys are unique is counted.
    ``docs`` and ``terms`` are written as Parquet under ``path`` (default: a fresh folder
    in the shared checkpoint folder), so the corpus is tokenised exactly once however
    many branches read the index, and a lost executor does not re-tokenise it.
    """
    from diffsieve.session import shared_dir

    fields = tuple(fields)
    spark = corpus.sparkSession
    path = path or shared_dir(spark, "index")
    _doc_counts(spread(corpus.select(key, *fields), partitions), key, fields).write.mode("overwrite").parquet(path + "/docs")
    docs = spark.read.parquet(path + "/docs")
    tf = flat(docs)
    (tf.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
     .withColumn("n_salt", F.greatest(F.lit(1), F.ceil(F.col("df") / F.lit(salt_rows)))
                 .cast("int"))
     .write.mode("overwrite").parquet(path + "/terms"))
    terms = spark.read.parquet(path + "/terms")

    # all statistics in one job: per-field document count and length, corpus rows and
    # smallest key, and whether xxhash64(field, term) is unique over the vocabulary
    nul_s = F.lit(None).cast("string")
    nul_n = F.lit(None).cast("long").alias("rows")
    parts = (docs.groupBy("field").agg(F.countDistinct("doc_id").alias("a"), F.sum("dl").alias("b"), F.count(F.lit(1)).alias("rows"))
             .select(F.lit("field").alias("what"), "field", "a", "b", "rows")
             .unionByName(corpus.agg(F.count(F.lit(1)).alias("a"),
                                     F.min(F.col(key).cast("long")).alias("b"))
                          .select(F.lit("corpus").alias("what"), nul_s.alias("field"), "a", "b", nul_n))
             .unionByName(terms.agg(F.count(F.lit(1)).alias("a"),
                                    F.countDistinct(F.xxhash64("field", "term")).alias("b"))
                          .select(F.lit("terms").alias("what"), nul_s.alias("field"), "a", "b", nul_n))
             .collect())
    per_field = {r["field"]: r for r in parts if r["what"] == "field"}
    rows = next(r for r in parts if r["what"] == "corpus")
    vocab = next(r for r in parts if r["what"] == "terms")
    stats = {}
    for f in fields:
        r = per_field.get(f)
        n_docs = int(r["a"]) if r else 0
        stats[f] = (n_docs, float(r["b"]) / n_docs if n_docs else 0.0)

    postings = salted_postings(tf, terms, stats, salt_rows)
    whole = len(fields) == 1 and all(r["a"] == r["rows"] for r in per_field.values())
    return LexicalIndex(postings, terms, stats, int(rows["a"]), rows["b"], fields, salt_rows,
                        vocab["a"] == vocab["b"], docs=docs if whole else None)


def term_stats(index: LexicalIndex) -> DataFrame:
    """``(field, term, df, cf)``: document and collection frequency per term (A1)."""
    return index.terms.select("field", "term", "df", "cf")


def query_terms(queries: DataFrame, key: str = "query_id",
                fields=("diff", "ast_seq")) -> DataFrame:
    """``(query_id, term, qtf)``: bag of query terms over all query text columns.

    Repeated terms count (each occurrence is one clause of the reference's query).
    """
    toks = F.concat(*[tokenize(null_to_empty(f)) for f in fields])
    return (queries.select(F.col(key).cast("long").alias("query_id"), F.explode(toks).alias("term"))
            .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")))


def match_postings(index: LexicalIndex, queries: DataFrame, key: str = "query_id",
                   query_fields=("diff", "ast_seq"), k1: float = K1, b: float = B,
                   broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per-term BM25 contributions ``(query_id, doc_id, fx)`` in fixed point.

    The query-term side is joined with the term table (idf, salt count), replicated
    once per salt group and joined with the postings on ``(field, term, salt)``. It is
    broadcast when its counted size is at most ``broadcast_rows``; otherwise both sides
    are shuffled on the salted key, which spreads frequent terms over many tasks.
    """
    qt = query_terms(queries, key, query_fields)
    # Size bound of the replicated query side without computing the term table:
    # query terms x the largest possible salt count (df <= documents).
    max_salt = max([1] + [-(-st[0] // _salt_rows(index)) for st in index.stats.values()])
    bounded = qt.count() * max_salt * len(index.fields) <= broadcast_rows
    postings = index.postings
    if index.store is not None:
        # only the files of the queried terms are read
        asked = qt.select("term").distinct().withColumn("field", F.explode(F.array(*[F.lit(f) for f in index.fields])))
        postings = salted_postings(index.store.postings(asked), index.terms, index.stats, _salt_rows(index))
    parts = []
    for f in index.fields:
        n, avgdl = index.stats[f]
        if n == 0:
            continue
        idf = F.log(F.lit(1.0) + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        qside = (qt.join(index.terms.where(F.col("field") == f), "term")
                 .select("term", "query_id", (F.col("qtf") * idf).alias("qw"),
                         F.explode(F.sequence(F.lit(0), F.col("n_salt") - 1)).alias("salt")))
        if bounded:
            qside = F.broadcast(qside)
        # the document side of a term's weight is computed once per posting, below the
        # join; the join output only multiplies
        norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.lit(avgdl))
        post = (postings.where(F.col("field") == f)
                .select("term", "salt", "doc_id",
                        (F.col("tf") / (F.col("tf") + norm) * F.lit(SCORE_SCALE)).alias("tfn")))
        # contributions are positive: floor(x + 0.5) is round-half-up, without the
        # decimal arithmetic of round()
        parts.append(post.join(qside, ["term", "salt"])
                     .select("query_id", "doc_id",
                             F.floor(F.col("qw") * F.col("tfn") + F.lit(0.5)).cast("long").alias("fx")))
    if not parts:
        return qt.sparkSession.createDataFrame([], "query_id long, doc_id long, fx long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bm25_scores(index: LexicalIndex, queries: DataFrame, key: str = "query_id",
                query_fields=("diff", "ast_seq"), k1: float = K1, b: float = B,
                broadcast_rows: int = BROADCAST_ROWS, best: int | None = None) -> DataFrame:
    """Sparse BM25 table ``(query_id, doc_id, score)``; absent pairs score 0 (A2).

    Query terms are broadcast, ``broadcast_rows`` (counted) a pass, and documents are scored where
    their postings lie (``docside``): no (query, document) pair is shuffled. Without
    ``broadcast_rows``, or with ``MAX_PASSES`` of them exceeded, the tables are joined. With
    ``best``, for a ranking that follows, a task may leave out hits below its ``best`` of a query.
    """
    from diffsieve.operators import docside

    qt = materialize(query_terms(queries, key, query_fields), "terms")
    n = qt.count() * len(index.fields)
    if n <= broadcast_rows * MAX_PASSES:
        return docside.scores(index, qt, k1, b, max(1, math.ceil(n / max(1, broadcast_rows))), best)
    m = match_postings(index, queries, key, query_fields, k1, b, broadcast_rows)
    return (m.groupBy("query_id", "doc_id").agg(F.sum("fx").alias("fx"))
            .select("query_id", "doc_id", (F.col("fx") / F.lit(SCORE_SCALE)).alias("score")))


def idf_value(n_docs: int, df: int) -> float:
    """The idf formula as a plain function (used by tests)."""
    return math.log(1.0 + (n_docs - df + 0.5) / (df + 0.5))
