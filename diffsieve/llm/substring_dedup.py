"""Exact substring deduplication by difference-cover anchors (operator 3).

``COVER`` is a difference cover of ``PERIOD``: for any two positions there is a shift below
``PERIOD`` that takes both to cover positions. So two equal windows of ``WIDTH`` words share an equal
anchor, ``WIDTH - PERIOD + 1`` words at a cover position of both rows, and only
``len(COVER) / PERIOD`` of all positions are hashed and shuffled:

1. every row sends its anchors' hashes; those that occur twice come back as (row id, position);
2. rows with such anchors extend them: each window that holds one is a candidate. Other rows
   are done. The rest is written with its texts, so they move once more only;
3. candidate windows' 95-bit hashes are compared likewise, which is exact up to hash collisions;
   a window found is checked by its hash in the row it is returned to, so rows that share an
   id don't mix;
4. words under a found window are removed.

A task sends a hot anchor or window once a slice (``spread_repeats``), so a passage that a third of
all rows holds gives each owner task one row per slice. Defined results: null or empty
text has no words and keeps the empty string; rows of fewer words than ``width`` stay whole; repeated
rows and rows with one id are separate rows (equal ones remove each other's windows);
null ids are ids; texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import read, saved
from ._words import SPACE, Words, keep_repeated, mix, slices, spread_repeats, window_hash

WIDTH = 35
#: Perfect difference sets, modulus -> residues.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
LEAST_ANCHOR = 12  # words; shorter anchors meet by chance


def cover_for(width: int) -> tuple[int, tuple[int, ...]]:
    """(period, cover): the sparsest whose anchors have ``LEAST_ANCHOR`` words, 1 word at least."""
    fits = [p for p in COVERS if width - p + 1 >= min(LEAST_ANCHOR, width)]
    return max(fits), COVERS[max(fits)]


def _id_hash(ids: pa.Array, row: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """A number of row id and position, to spread known repeats by."""
    if pa.types.is_integer(ids.type):
        own = ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    else:
        own = np.array([int.from_bytes(hashlib.blake2b(str(x).encode(), digest_size=8).digest(), "little") for x in ids.to_pylist()], np.uint64)
    return mix(own[row] * np.uint64(0x9E3779B97F4A7C15) + pos.astype(np.uint64))


def anchors(docs: DataFrame, kind: str, width: int) -> DataFrame:
    """(id, at): positions of anchors that occur elsewhere too; docs: (id, text)."""
    period, cover = cover_for(width)
    long = width - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_cover = np.isin(np.arange(period), cover)
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column(1), SPACE)
                at = w.whole(long)
                at = at[in_cover[w.pos[at] % period]]
                key, sure = spread_repeats(window_hash(w.hash, long, 1)[at], _id_hash(part.column(0), w.row[at], w.pos[at]))
                mark = w.pos[at].astype(np.int64) << 1 | sure
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), part.column(0).take(pa.array(w.row[at])), pa.array(mark)], ["key", "id", "mark"])

    dealt = docs.mapInArrow(run, f"key long, id {kind}, mark long")
    found = keep_repeated(dealt, f"id {kind}, mark long", derived={"sure": F.col("mark") % 2 == 1})
    return found.select("id", F.shiftright("mark", 1).cast("int").alias("at"))


def _kept(words: list[bytes], keep_text: bool) -> str:
    raw = b" ".join(words)
    return raw.decode() if keep_text else hashlib.sha256(raw).hexdigest()


def candidates(docs: DataFrame, marks: DataFrame, kind: str, width: int, keep_text: bool) -> DataFrame:
    """(id, n_words, kept, text, at): finished rows have ``kept``, the others ``text`` and the
    candidate windows' positions."""
    period, _ = cover_for(width)
    by_id = marks.groupBy(F.col("id").alias("mark_id")).agg(F.collect_set("at").alias("at"))
    joined = docs.join(by_id, docs["id"].eqNullSafe(by_id["mark_id"]), "left").select("id", "text", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column(1).to_pylist()
                words, kept, rest, found = [], [], [], []
                for text, at in zip(texts, part.column(2)):
                    split = (text or "").encode().split()  # of bytes: at 0x20 and 0x09 to 0x0D
                    n = len(split)
                    window = np.zeros(0, np.int64)
                    if at.is_valid and n >= width:
                        a = np.asarray(at.values.to_numpy(zero_copy_only=False), np.int64)
                        window = np.unique((a[:, None] - np.arange(period)[None, :]).ravel())
                        window = window[(window >= 0) & (window <= n - width)]
                    words.append(n)
                    kept.append(None if len(window) else _kept(split, keep_text))
                    rest.append(text if len(window) else None)
                    found.append(window.astype(np.int32) if len(window) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.int64()), pa.array(kept, pa.string()), pa.array(rest, pa.string()), pa.array(found, pa.list_(pa.int32()))],
                                                 ["id", "n_words", "kept", "text", "at"])

    return joined.mapInArrow(run, f"id {kind}, n_words long, kept string, text string, at array<int>")


def _rows(part: pa.RecordBatch, column: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of a slice of open rows, word indexes of their candidate windows, and the lists' sizes."""
    w = Words(part.column(1), SPACE)
    lists = part.column(column)
    size = np.asarray(pa.compute.list_value_length(lists).fill_null(0), dtype=np.int64)
    row = np.repeat(np.arange(len(lists)), size)
    return w, w.first[row] + lists.flatten().to_numpy(zero_copy_only=False), row


def _window_keys(w: Words, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 31 bits of the hash of the windows that start at the words ``at``."""
    h1, h2 = (window_hash(w.hash, width, seed)[at] if len(at) else np.zeros(0, np.uint64) for seed in (2, 3))
    return h1, (h2 >> np.uint64(33)).astype(np.int64)


def repeated_windows(open_rows: DataFrame, kind: str, width: int) -> DataFrame:
    """(id, mark): candidate windows that start elsewhere, too; open_rows: (id, text, at).

    ``mark`` is the position, 31 bits of the hash to know the row by, and a bit for rows that
    are known to repeat, in one number: the rows are many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w, at, row = _rows(part, 2)
                h1, check = _window_keys(w, at, width)
                key, sure = spread_repeats(mix(h1 ^ mix(check.astype(np.uint64))), _id_hash(part.column(0), row, w.pos[at]))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), part.column(0).take(pa.array(row)), pa.array(w.pos[at].astype(np.int64) << 32 | check << 1 | sure)], ["key", "id", "mark"])

    # the key mixes both parts of the hash; with the part in the mark it is 95 bits
    dealt = open_rows.mapInArrow(run, f"key long, id {kind}, mark long")
    derived = {"check": F.shiftright("mark", 1).bitwiseAND(F.lit(0x7FFFFFFF)), "sure": F.col("mark") % 2 == 1}
    return keep_repeated(dealt, f"id {kind}, mark long", by=("key", "check"), derived=derived)


def removed(open_rows: DataFrame, found: DataFrame, kind: str, width: int, keep_text: bool) -> DataFrame:
    """(id, n_words, n_removed, kept) of the open rows."""
    by_id = found.groupBy(F.col("id").alias("found_id")).agg(F.collect_set("mark").alias("mark"))
    joined = open_rows.join(by_id, open_rows["id"].eqNullSafe(by_id["found_id"]), "left").select("id", "text", "mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column(1), SPACE)
                lists = part.column(2)
                mark = lists.flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(lists)), np.asarray(pa.compute.list_value_length(lists).fill_null(0), dtype=np.int64))
                n = np.diff(w.first)
                pos = mark >> 32
                own = np.flatnonzero(pos + width <= n[row])
                at = w.first[row[own]] + pos[own]
                at = at[_window_keys(w, at, width)[1] == mark[own] >> 1 & 0x7FFFFFFF]
                cover = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + width, -1)
                drop = np.cumsum(cover)[:-1] > 0
                texts = part.column(1).to_pylist()
                kept = [_kept([x for x, d in zip((t or "").encode().split(), drop[a:b].tolist()) if not d], keep_text)
                        for t, a, b in zip(texts, w.first, w.first[1:])]
                run_drop = np.concatenate([[0], np.cumsum(drop)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), pa.array((run_drop[w.first[1:]] - run_drop[w.first[:-1]]).astype(np.int64)), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, f"id {kind}, n_words long, n_removed long, kept string")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, keep_text: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept): the words that stay, joined by one space.

    keep_text: else ``kept`` is their sha256 (lowercase hex), and only that leaves the tasks.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    first = saved(candidates(rows, anchors(rows, kind, width), kind, width, keep_text), "substring-rows")
    done = first.where(F.col("text").isNull()).select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept")
    open_rows = first.where(F.col("text").isNotNull()).select("id", "text", "at")
    found = repeated_windows(open_rows, kind, width)
    rest = removed(open_rows.select("id", "text"), found, kind, width, keep_text)
    return done.unionByName(rest).select(F.col("id").alias(id_col), "n_words", "n_removed", "kept")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs, keep_text=False).withColumnRenamed("kept", "kept_sha256")
