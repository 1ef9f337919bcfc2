"""Benchmark decontamination by a distributed positional inverted index (operator 7).

Words are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters, known by
64-bit hashes. A test window is ``WINDOW`` consecutive words of a benchmark item; a shorter item is
one window. The benchmark is the query set; it is worked off in blocks of items, so that a block's
vocabulary and windows (``BLOCK_TERMS``, ``BLOCK_WINDOWS``) can be sent to every task.

1. One pass counts how often each test term occurs in the training texts. Windows with a term
   that never occurs are dropped.
2. The ``RAREST`` rarest terms of each window are its anchors. A second pass stores the anchors'
   postings, (term, id, positions), as a table.
3. Postings are joined with the anchors on the term; position minus offset is the window's start.
   Starts that the lists of all anchors agree on are candidates (counted per id, start and window).
4. Candidate rows meet their texts once; a window is an exact match if the 128-bit hash of
   all its words is found at the start. ``proximity_matches`` returns looser ones: all
   anchors of a window, each displaced by at most ``slop`` words from the first.

A hot term's postings are a row per text, never one list. Defined results: null or empty text
has no words and no hit; items without words match nothing; repeated items count by distinct
item id (null reads as ''); repeated rows and rows that share an id are judged each by its own
text; texts and items are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._io import read, saved
from ._words import NON_ALNUM, Words, slices, window_hash

WINDOW, RAREST = 13, 2
BLOCK_TERMS, BLOCK_WINDOWS = 1 << 20, 1 << 20


def _words(column: pa.Array) -> Words:
    return Words(column, NON_ALNUM, lower=True)


def test_windows(bench: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """(item, h1, h2, width, terms): a row per window of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = _words(part.column(1))
                n = np.diff(w.first)
                for size in np.unique(np.minimum(n[n > 0], width)):
                    at = w.whole(size)
                    at = at[(n[w.row[at]] == size) | (size == width)]
                    terms = w.hash[at[:, None] + np.arange(size)[None, :]].view(np.int64)
                    yield pa.RecordBatch.from_arrays([
                        part.column(0).take(pa.array(w.row[at])), *[pa.array(window_hash(w.hash, int(size), s)[at].view(np.int64)) for s in (1, 2)],
                        pa.array(np.full(len(at), size, np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * size), pa.array(terms.ravel()))],
                        ["item", "h1", "h2", "width", "terms"])

    rows = bench.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "item string, h1 long, h2 long, width int, terms array<long>")


def _sent(df: DataFrame, column: str):
    """A column's distinct values as a sorted array in every task; callers bound their number."""
    values = np.sort(df.select(column).distinct().toArrow().column(0).to_numpy().astype(np.int64))
    return df.sparkSession.sparkContext.broadcast(values)


def _find(values: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Index in sorted ``values`` of each key, -1 where there is none; a bit table rules out most."""
    bits = 22
    slot = lambda x: (x.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
    table = np.zeros(1 << bits, bool)
    table[slot(values)] = True
    out = np.full(len(key), -1)
    may = np.flatnonzero(table[slot(key)])
    if len(values):
        at = np.minimum(np.searchsorted(values, key[may]), len(values) - 1)
        out[may] = np.where(values[at] == key[may], at, -1)
    return out


def word_and_term_counts(docs: DataFrame, kind: str, vocabulary) -> DataFrame:
    """Two kinds of rows: (id, n_words) of every text, and (term, n) sums of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = vocabulary.value
        total = np.zeros(len(values), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                w = _words(part.column(1))
                at = _find(values, w.hash.view(np.int64))
                total += np.bincount(at[at >= 0], minlength=len(values))
                none = pa.nulls(part.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(w.first).astype(np.int64)), none, none], ["id", "n_words", "term", "n"])
        seen = np.flatnonzero(total)
        if len(seen):
            ids = batch.column(0).type
            yield pa.RecordBatch.from_arrays([pa.nulls(len(seen), ids), pa.nulls(len(seen), pa.int64()), pa.array(values[seen]), pa.array(total[seen])], ["id", "n_words", "term", "n"])

    return docs.mapInArrow(run, f"id {kind}, n_words long, term long, n long")


def anchors(windows: DataFrame, counts: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(term, offset, rank, needed, h1, h2, width): the rarest terms of each distinct window."""
    distinct = windows.select("h1", "h2", "width", "terms").dropDuplicates(["h1", "h2", "width"])
    terms = distinct.select("h1", "h2", "width", F.posexplode("terms").alias("offset", "term")).join(counts, "term")
    own = Window.partitionBy("h1", "h2", "width")
    terms = terms.withColumn("found", F.count("*").over(own)).where(F.col("found") == F.col("width"))
    terms = terms.withColumn("rank", F.row_number().over(own.orderBy("n", "offset"))).where(F.col("rank") <= rarest)
    return terms.select("term", "offset", "rank", F.least(F.lit(rarest), "width").alias("needed"), "h1", "h2", "width")


def postings(docs: DataFrame, kind: str, vocabulary) -> DataFrame:
    """(term, id, at array<int>): where each anchor term stands in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = vocabulary.value
        for batch in batches:
            for part in slices(batch, "text"):
                w = _words(part.column(1))
                term = _find(values, w.hash.view(np.int64))
                at = np.flatnonzero(term >= 0)
                at = at[np.lexsort((at, term[at], w.row[at]))]
                row, term, pos = w.row[at], term[at], w.pos[at].astype(np.int32)
                new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (term[1:] != term[:-1])])) if len(at) else np.zeros(0, int)
                lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(at)).astype(np.int32)), pa.array(pos))
                yield pa.RecordBatch.from_arrays([pa.array(values[term[new]]), part.column(0).take(pa.array(row[new])), lists], ["term", "id", "at"])

    return docs.mapInArrow(run, f"term long, id {kind}, at array<int>")


def candidates(index: DataFrame, anchor: DataFrame) -> DataFrame:
    """(id, start, h1, h2, width) that the offset-adjusted lists of all anchors of a window agree on."""
    hits = index.join(F.broadcast(anchor), "term").select("id", "needed", "h1", "h2", "width", F.explode("at").alias("at"), "offset")
    hits = hits.withColumn("start", F.col("at") - F.col("offset")).where(F.col("start") >= 0)
    lists = hits.groupBy("id", "start", "h1", "h2", "width", "needed").agg(F.count("*").alias("n"))
    return lists.where(F.col("n") >= F.col("needed")).drop("n", "needed")


def exact_matches(docs: DataFrame, kind: str, found: DataFrame, windows: DataFrame) -> DataFrame:
    """(id, text, n_words, n_hit, items, starts, widths) of each row with candidates, by its own text."""
    spark = docs.sparkSession
    pairs = windows.select("h1", "h2", "item").distinct().toArrow().to_pydict()
    named: dict[tuple[int, int], list[str]] = {}
    for a, b, item in zip(pairs["h1"], pairs["h2"], pairs["item"]):
        named.setdefault((a, b), []).append(item)
    items = spark.sparkContext.broadcast(named)
    by_id = found.groupBy(F.col("id").alias("found_id")).agg(F.collect_list(F.struct("start", "width", "h1", "h2")).alias("c"))
    joined = docs.join(by_id, docs["id"].eqNullSafe(by_id["found_id"]))
    joined = joined.select("id", "text", *[F.col("c." + x).alias(x) for x in ("start", "width", "h1", "h2")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = items.value
        for batch in batches:
            for part in slices(batch, "text"):
                w = _words(part.column(1))
                n = np.diff(w.first)
                size = part.column(2).value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(part.num_rows), size)
                start, width, h1, h2 = (part.column(k).flatten().to_numpy(zero_copy_only=False) for k in (2, 3, 4, 5))
                good = start + width <= n[row]
                for k in np.unique(width):
                    own = np.flatnonzero(good & (width == k))
                    at = w.first[row[own]] + start[own]
                    good[own] = (window_hash(w.hash, int(k), 1)[at].view(np.int64) == h1[own]) & (window_hash(w.hash, int(k), 2)[at].view(np.int64) == h2[own])
                cover = np.zeros(len(w.hash) + 1, np.int64)
                at = w.first[row[good]] + start[good]
                np.add.at(cover, at, 1)
                np.add.at(cover, at + width[good], -1)
                run_hit = np.concatenate([[0], np.cumsum(np.cumsum(cover)[:-1] > 0)])
                out_items, starts, widths = ([[] for _ in range(part.num_rows)] for _ in range(3))
                for k in np.flatnonzero(good):
                    out_items[row[k]].extend(names[int(h1[k]), int(h2[k])])
                    starts[row[k]].append(int(start[k]))
                    widths[row[k]].append(int(width[k]))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(n.astype(np.int64)), pa.array((run_hit[w.first[1:]] - run_hit[w.first[:-1]]).astype(np.int64)),
                    pa.array([sorted(set(x)) for x in out_items], pa.list_(pa.string())), pa.array(starts, pa.list_(pa.int32())), pa.array(widths, pa.list_(pa.int32()))],
                    ["id", "text", "n_words", "n_hit", "items", "starts", "widths"])

    return joined.mapInArrow(run, f"id {kind}, text string, n_words long, n_hit long, items array<string>, starts array<int>, widths array<int>")


def _blocks(windows: DataFrame) -> int:
    size = windows.select(F.count("*").alias("w"), F.sum("width").alias("t")).first()
    return max(1, -(-(size["w"] or 0) // BLOCK_WINDOWS), -(-(size["t"] or 0) // (BLOCK_TERMS * 4)))


def build_index(docs: DataFrame, kind: str, windows: DataFrame, rarest: int = RAREST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(word counts, anchors, postings) of a block of test windows; docs: (id, text)."""
    vocabulary = _sent(windows.select(F.explode("terms").alias("term")), "term")
    counted = saved(word_and_term_counts(docs, kind, vocabulary), "term-counts")
    counts = counted.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("n").alias("n"))
    anchor = saved(anchors(windows, counts, rarest), "anchors")
    index = saved(postings(docs, kind, _sent(anchor, "term")), "postings")
    return counted.where(F.col("term").isNull()).select("id", "n_words"), anchor, index


def matches(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(id, n_words) of every row, and (id, text, n_words, n_hit, items) of the rows of all ids that have candidates."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    windows = saved(test_windows(bench, item_id, item_text, width), "test-windows")
    n = _blocks(windows)
    sizes, out = None, None
    for k in range(n):
        block = windows if n == 1 else windows.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k)
        counted, anchor, index = build_index(rows, kind, block)
        found = saved(candidates(index, anchor), "window-candidates")
        some = saved(exact_matches(rows, kind, found, block).withColumn("block", F.lit(k)), "window-matches")
        sizes, out = counted, some if out is None else out.unionByName(some)
    return sizes, out if n == 1 else merged(out)


def merged(some: DataFrame) -> DataFrame:
    """The blocks' rows as one: n_hit and items over all blocks of each (id, text), as often as
    the row is repeated. Every block that has a candidate for an id returns all rows of the id."""
    of = ["id", "text", "n_words"]
    places = some.select(*of, "block", F.explode_outer(F.arrays_zip("starts", "widths")).alias("span"))
    places = places.select(*of, F.explode(F.sequence(F.col("span.starts"), F.col("span.starts") + F.col("span.widths") - 1)).alias("at"))
    hits = places.groupBy(*of).agg(F.countDistinct("at").alias("n_hit"))
    rows = some.groupBy(*of, "block").agg(F.count("*").alias("m"), F.first("items").alias("items"))
    rows = rows.groupBy(*of).agg(F.max("m").alias("m"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    same = [rows[c].eqNullSafe(hits[c]) for c in of]
    both = rows.join(hits, same[0] & same[1] & same[2], "left").select(*[rows[c] for c in of], F.coalesce("n_hit", F.lit(0)).alias("n_hit"), "items", "m")
    return both.select(*of, "n_hit", "items", F.explode(F.sequence(F.lit(1), F.col("m").cast("int")))).drop("col")


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of every row.

    A row is contaminated if it has hits and they are at least a twentieth of its words.
    """
    sizes, some = matches(docs, bench, id_col, text, **names)
    ids = some.select(F.col("id").alias("some_id")).distinct()
    clean = sizes.join(ids, sizes["id"].eqNullSafe(ids["some_id"]), "left_anti")
    clean = clean.select("id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    both = clean.unionByName(some.select("id", "n_words", "n_hit", "items"))
    return both.select(
        F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def clean_rows(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, judged each by its own text."""
    _, some = matches(docs, bench, id_col, text)
    bad = some.where((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).select(F.col("id").alias("bad_id"), F.xxhash64("text").alias("bad_text")).distinct()
    own = docs.select(*[F.col(c).alias(f"clean_{i}") for i, c in enumerate(docs.columns)])
    id_own, text_own = (F.col(f"clean_{docs.columns.index(c)}") for c in (id_col, text))
    kept = own.join(bad, id_own.eqNullSafe(F.col("bad_id")) & (F.xxhash64(text_own) == F.col("bad_text")), "left_anti")
    return kept.toDF(*docs.columns)


def proximity_matches(docs: DataFrame, bench: DataFrame, slop: int = 3, rarest: int = 3, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id",
                      item_text: str = "text", width: int = WINDOW) -> DataFrame:
    """(id, item, start, displaced): windows of which all anchors stand within ``slop`` words of
    their places, as seen from the rarest; ``displaced`` is the largest such distance, 0 for
    candidates of exact matches."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    windows = saved(test_windows(bench, item_id, item_text, width), "test-windows")
    _, anchor, index = build_index(rows, kind, windows, rarest)
    hits = index.join(anchor, "term").select("id", "rank", "needed", "h1", "h2", F.explode("at").alias("at"), "offset")
    hits = hits.withColumn("start", F.col("at") - F.col("offset"))
    lead, rest = hits.where("rank = 1"), hits.where("rank > 1")
    near = lead.join(rest.select(F.col("id").alias("id2"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("rank").alias("rank2"), F.col("start").alias("start2")),
                     F.col("id").eqNullSafe(F.col("id2")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & (F.abs(F.col("start") - F.col("start2")) <= slop), "left")
    best = near.groupBy("id", "start", "h1", "h2", "needed", "rank2").agg(F.min(F.abs(F.col("start") - F.col("start2"))).alias("d"))
    full = best.groupBy("id", "start", "h1", "h2", "needed").agg(F.count("rank2").alias("n"), F.max("d").alias("displaced")).where(F.col("n") >= F.col("needed") - 1)
    named = windows.select("h1", "h2", "item").distinct()
    return full.join(named, ["h1", "h2"]).select(F.col("id").alias(id_col), "item", "start", F.coalesce("displaced", F.lit(0)).alias("displaced"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))
