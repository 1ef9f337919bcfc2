"""Source divergence audit: how the words of a language's sources differ (operator 12).

1. Counting. A term is a run of ASCII letters and non-ASCII characters, A-Z lower-cased. Slices of
   text are counted by length: terms of up to 8 bytes become one big-endian uint64, of up to 16
   bytes two; those are ordered by a radix sort of 16-bit digits and counted as runs. Longer
   terms are sorted as byte strings in a bucket for each length in 8-byte words. A slice sends one
   row (group, term, occurrences, documents) for each term and group.
2. Kept terms. Rows are added up by (group, term), then gathered by (language, term) as a list of at
   most one entry a source; terms in at least ``MIN_DOCS`` documents of the language stay.
3. Scores. For blocks of kept terms the smoothed shares p of all sources are a dense matrix of int64;
   f = floor((p-q)*(p-q)/(p+q)) is added up for each pair of sources, blocks of ``SIDE`` sources
   at a time, and each source's ``TOP`` terms against the language are found. Tasks send sums and
   their best terms; Spark adds and ranks them.

Arithmetic is on whole numbers throughout; the share is divided in three steps, so no product
leaves 64 bits up to 9e15 occurrences in a language. The table of groups (a row a source of a
language) goes to the driver and all tasks: the result itself holds a row for every two sources of
a language, so it is far smaller than the result; more than ``MOST_GROUPS`` raise ValueError.

Defined results: null text, language and source read as ''; a group without terms has counts of 0;
a language without kept terms gives pairs of value 0; repeated rows and ids count as rows; a
language of one source has no pairs; an empty table gives no row. Only text, language and source are
read, so further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._io import read, saved
from ._words import Words, separator_table, slices

MIN_DOCS, TOP = 10, 10
SLICE_BYTES = 4 << 20
SIDE, CELLS = 256, 1 << 20
MOST_GROUPS = 1 << 20
#: Terms are runs of anything but ASCII other than letters.
NON_LETTER = separator_table((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


class Terms(Words):
    """Terms of a column slice, by byte span only."""

    def __init__(self, column: pa.Array):
        super().__init__(column, NON_LETTER, lower=True)

    def _hash(self) -> None:
        return None

    def packed(self, at: np.ndarray, words: int) -> list[np.ndarray]:
        """The terms ``at`` as ``words`` uint64 each, first bytes highest, zero-filled."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
        size, out = self.ends[at] - self.starts[at], []
        for k in range(words):
            left = np.clip(size - 8 * k, 0, 8)
            v = eight[np.minimum(self.starts[at] + 8 * k, len(self.data))].astype(np.uint64)
            cut = (np.uint64(64) - left.astype(np.uint64) * np.uint64(8)) & np.uint64(63)
            out.append(np.where(left == 0, np.uint64(0), v >> cut << cut))
        return out

    def text(self, at: np.ndarray) -> pa.Array:
        """The terms ``at`` as strings."""
        size = self.ends[at] - self.starts[at]
        off = np.r_[0, np.cumsum(size)].astype(np.int64)
        byte = np.arange(off[-1]) + np.repeat(self.starts[at] - off[:-1], size)
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(off), pa.py_buffer(self.data[byte].tobytes())).cast(pa.string())


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """Stable order of rows of uint64 words, first word first: 16-bit digits from the last one up.

    numpy's stable sort of 16-bit numbers is a radix sort; digits that are all alike are left out.
    """
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in (0, 16, 32, 48):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _new_runs(columns: list[np.ndarray]) -> np.ndarray:
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def runs(terms: Terms) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length bucket: term indexes in term order (ties in text order), and where a new term starts."""
    words = (terms.ends - terms.starts + 7) // 8
    for n in np.unique(words):
        at = np.flatnonzero(words == n)
        if n <= 2:
            columns = terms.packed(at, int(n))
            order = radix_order(columns)
            yield at[order], _new_runs([c[order] for c in columns])
        else:
            size = int(n) * 8
            rows = np.zeros((len(at), size), np.uint8)
            length = terms.ends[at] - terms.starts[at]
            byte = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            rows[np.repeat(np.arange(len(at)), length), byte] = terms.data[np.repeat(terms.starts[at], length) + byte]
            flat = rows.view(f"S{size}").ravel()
            order = np.argsort(flat, kind="stable")
            yield at[order], _new_runs([flat[order]])


def count_slice(terms: Terms, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(group, a term's index, occurrences, documents) of a slice, a row for each term and group.

    group: a small number for each row of the slice.
    """
    for at, new in runs(terms):
        term = np.cumsum(new) - 1
        head = at[new]
        # text order within a term keeps the occurrences of a row together
        row = terms.row[at]
        first = new.copy()
        first[1:] |= row[1:] != row[:-1]
        key = term * np.int64(group.max() + 1) + group[row]
        order = np.argsort(key, kind="stable")
        key, first = key[order], first[order]
        begin = np.flatnonzero(_new_runs([key]))
        size = np.diff(np.r_[begin, len(key)])
        yield key[begin] % (group.max() + 1), head[key[begin] // (group.max() + 1)], size, np.add.reduceat(first.astype(np.int64), begin)


def term_counts(docs: DataFrame, groups) -> DataFrame:
    """(lid, gid, term, n, docs) of slices of texts, not yet added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = groups.value
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                names = list(zip(part.column(1).to_pylist(), part.column(2).to_pylist()))
                gid = np.array([known[x] for x in names], np.int64).reshape(-1, 2)
                seen, local = np.unique(gid[:, 1], return_inverse=True)
                lids = np.zeros(len(seen), np.int64)
                lids[local] = gid[:, 0]
                terms = Terms(part.column(0))
                if not len(terms.starts):
                    continue
                for g, at, n, d in count_slice(terms, local):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(lids[g].astype(np.int32)), pa.array(seen[g].astype(np.int32)), terms.text(at), pa.array(n.astype(np.int64)), pa.array(d.astype(np.int64))],
                        ["lid", "gid", "term", "n", "docs"])

    return docs.select("text", "lang", "source").mapInArrow(run, "lid int, gid int, term string, n long, docs long")


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lid, term, at list of (gid, n)): terms in at least ``min_docs`` documents of a language."""
    sums = counts.groupBy("lid", "gid", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = sums.groupBy("lid", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("gid", "n")).alias("at"))
    return by_term.where(F.col("docs") >= min_docs).select("lid", "term", "at")


def share(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (count + 2) / whole), in three steps of 1000 so that int64 suffices."""
    out, left = np.divmod(count + 2, whole)
    for _ in range(3):
        q, left = np.divmod(left * 1000, whole)
        out = out * 1000 + q
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def scores(kept: DataFrame, langs, top: int = TOP) -> DataFrame:
    """(part, gid, other, item, value): sums over pairs of sources, and the best terms, of each task.

    langs: for each language number (its groups ascending, their whole N + 2V, its own whole).
    """

    def best(term: pa.Array, group: np.ndarray, at: np.ndarray, value: np.ndarray) -> tuple:
        order = np.asarray(pc.sort_indices(pa.table({"g": group, "v": value, "t": term.take(pa.array(at))}), sort_keys=[("g", "ascending"), ("v", "descending"), ("t", "ascending")]))
        g = group[order]
        new = _new_runs([g])
        rank = np.arange(len(g)) - np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
        order = order[rank < top]
        return group[order], at[order], value[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = langs.value
        sums: dict = {}
        names = ["part", "gid", "other", "item", "value"]

        def add(lid: int, a: int, b: int, part: np.ndarray) -> None:
            if (lid, a, b) in sums:
                sums[lid, a, b] += part
            else:
                sums[lid, a, b] = part

        def flush() -> Iterator[pa.RecordBatch]:
            for (lid, a, b), total in sums.items():
                gids = known[lid][0]
                i, j = np.nonzero(np.ones_like(total, bool))
                i, j, v = i + a, j + b, total.ravel()
                some = i < j
                i, j, v = gids[i[some]], gids[j[some]], v[some]
                yield pa.RecordBatch.from_arrays([pa.array(["pair"] * len(i), pa.string()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.nulls(len(i), pa.string()), pa.array(v)], names)
            sums.clear()

        for batch in batches:
            lid = batch.column(0).to_numpy()
            for one in np.unique(lid):
                gids, whole, own = known[one]
                rows = pa.RecordBatch.from_arrays(batch.columns, batch.schema.names).filter(pa.array(lid == one))
                for begin in range(0, rows.num_rows, max(1, CELLS // len(gids))):
                    part = rows.slice(begin, max(1, CELLS // len(gids)))
                    entries, row = pc.list_flatten(part.column(2)), np.asarray(pc.list_parent_indices(part.column(2)), np.int64)
                    col = np.searchsorted(gids, entries.field("gid").to_numpy())
                    count = np.zeros((len(gids), part.num_rows), np.int64)
                    count[col, row] = entries.field("n").to_numpy()
                    p = share(count, whole[:, None])
                    q = share(count.sum(axis=0), np.int64(own))
                    hit = (count > 0) & (p > q)
                    g, t = np.nonzero(hit)
                    if len(g):
                        g, t, v = best(part.column(1), g, t, divergence(p[g, t], q[t]))
                        yield pa.RecordBatch.from_arrays([pa.array(["term"] * len(g), pa.string()), pa.array(gids[g], pa.int32()), pa.nulls(len(g), pa.int32()), part.column(1).take(pa.array(t)), pa.array(v)], names)
                    for a in range(0, len(gids), SIDE):
                        for b in range(a, len(gids), SIDE):
                            x, y = p[a:a + SIDE], p[b:b + SIDE]
                            add(one, a, b, np.stack([divergence(x[k], y).sum(axis=1) for k in range(len(x))]))
                            if len(sums) * SIDE * SIDE > 16 * CELLS:
                                yield from flush()
        yield from flush()

    return kept.mapInArrow(run, "part string, gid int, other int, item string, value long")


def _send_langs(kept: DataFrame, lids: list[int]):
    """Broadcast of each language's groups with N + 2V, from one row for each group and language."""
    per_group = {r["gid"]: r["n"] for r in kept.select(F.explode("at").alias("e")).groupBy(F.col("e.gid").alias("gid")).agg(F.sum("e.n").alias("n")).collect()}
    size = {r["lid"]: r["v"] for r in kept.groupBy("lid").agg(F.count("*").alias("v")).collect()}
    out = {}
    for lid in set(lids):
        gids = np.flatnonzero(np.asarray(lids) == lid).astype(np.int32)
        n = np.array([per_group.get(int(g), 0) for g in gids], np.int64)
        twice = 2 * size.get(lid, 0)
        out[lid] = (gids, n + twice, int(n.sum()) + twice)
    return kept.sparkSession.sparkContext.broadcast(out)


def audit_sources(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` against each other source, ``term`` the best terms."""
    spark = docs.sparkSession
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    groups = docs.select("lang", "source").distinct()
    table = sorted((r["lang"], r["source"]) for r in groups.limit(MOST_GROUPS + 1).collect())
    if len(table) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} sources of languages")
    number = {x: k for k, x in enumerate(sorted({x[0] for x in table}))}
    lids = [number[x[0]] for x in table]
    known = spark.sparkContext.broadcast({x: (lids[k], k) for k, x in enumerate(table)})
    kept = saved(kept_terms(term_counts(docs, known), min_docs), "audit-terms")
    langs = _send_langs(kept, lids)
    found = saved(scores(kept, langs, top), "audit-scores")

    names = spark.createDataFrame([(k, lids[k], *x) for k, x in enumerate(table)], "gid int, lid int, lang string, source string")
    sums = found.where("part = 'pair'").groupBy("gid", "other").agg(F.sum("value").alias("value"))
    both = sums.unionAll(sums.select(F.col("other").alias("gid"), F.col("gid").alias("other"), "value"))
    pairs = names.join(names.select(F.col("gid").alias("other"), "lid", F.col("source").alias("item")), "lid").where(F.col("gid") != F.col("other"))
    pairs = pairs.join(both, ["gid", "other"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    terms = found.where("part = 'term'").join(names, "gid").select("lang", "source", "part", "item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionAll(ranked(terms).where(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


def op12_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``: every two sources of a language, and each source's ten most peculiar terms."""
    return audit_sources(read(spark, sf_dir, "documents"))
