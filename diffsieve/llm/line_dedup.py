"""Line dedup by two Bloom filters (operator 11).

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Keys that occur
in at least ``min_docs`` texts lose their lines.

1. Filters. Every task keeps two Bloom filters of the same size, for keys seen in one text and for
   keys seen in a second one. They are cut into chunks, and the chunks of all tasks are merged in
   a stream: twice = twice1 | twice2 | (once1 & once2), once = once1 | once2. A key of two texts
   has its bits in the merged twice filter whatever tasks saw it, so none is missed. The filters get
   ``BITS_PER_LINE`` bits a line of the corpus up to ``MAX_BITS``; a fuller filter only lets
   more keys through to step 2, results stay exact.
2. Confirmation. Only lines that the twice filter knows are shuffled, once per key and slice of
   texts, as (key, texts, first occurrence); their whole keys are grouped and counted.
3. Removal. Confirmed keys up to ``SENT_BYTES`` (measured) go to all tasks, which compare whole
   keys. Beyond that, suspected lines are joined with the confirmed keys and the line numbers to
   drop with the texts; both joins are salted, as a key or a text may be a third of all rows.

Defined results: null and empty text is one empty line; keys of fewer than ``min_chars`` code points
stay; rows are texts of their own, repeated rows and ids too; with ``keep_first`` the line of
smallest (id, line number) stays (null ids come first; rows that share that id each keep it).
Only id and text are read, so further columns don't matter. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import read, saved
from ._words import LOWER, SPACE, Words, mix, slices, text_bytes

MIN_DOCS, MIN_CHARS = 10, 1
BITS_PER_LINE, MIN_BITS, MAX_BITS = 4, 1 << 17, 1 << 29
CHUNK_BYTES = 1 << 13
SENT_BYTES = 64 << 20
SALTS = 32
LONG = 4096


class Lines(Words):
    """Lines of a column slice: raw spans, key spans, hashes of keys; ``first`` is each row's first line."""

    def __init__(self, column: pa.Array):
        raw, off = text_bytes(column)
        breaks = np.flatnonzero(raw == 10)
        rows = np.concatenate([np.searchsorted(off, breaks, side="right") - 1, np.arange(len(off) - 1)])
        stops = np.concatenate([breaks, off[1:]])
        order = np.lexsort((stops, rows))
        self.raw, self.off, self.row, self.line_end = raw, off, rows[order], stops[order]
        self.first = np.searchsorted(self.row, np.arange(len(off)))
        begins = np.r_[0, self.line_end[:-1] + 1] if len(order) else np.zeros(0, np.int64)
        begins[self.first[:-1]] = off[:-1]
        self.line_start = begins
        solid = np.flatnonzero(~SPACE[raw])
        lo, hi = np.searchsorted(solid, begins), np.searchsorted(solid, self.line_end)
        some = hi > lo
        solid = np.r_[solid, 0]
        self.starts = np.where(some, solid[np.minimum(lo, len(solid) - 1)], begins)
        self.ends = np.where(some, solid[hi - 1] + 1, begins)
        self.data = LOWER[raw]
        self.hash = self._hash()

    def _hash(self) -> np.ndarray:
        ends = self.ends
        long = np.flatnonzero(ends - self.starts > LONG)
        self.ends = np.minimum(ends, self.starts + LONG)
        h = super()._hash()
        self.ends = ends
        for i in long:  # few, as each is over 4 KB
            h[i] = int.from_bytes(hashlib.blake2b(self.data[self.starts[i]:ends[i]].tobytes(), digest_size=8).digest(), "little")
        return h

    def number(self) -> np.ndarray:
        """Each line's number in its row."""
        return np.arange(len(self.row)) - self.first[self.row]

    def counted(self, min_chars: int) -> np.ndarray:
        """Whether a key has at least ``min_chars`` code points."""
        if min_chars <= 1:
            return self.ends - self.starts >= min_chars
        lead = np.r_[0, np.cumsum((self.raw & 0xC0) != 0x80)]
        return lead[self.ends] - lead[self.starts] >= min_chars

    def keys(self, at: np.ndarray) -> pa.Array:
        """Whole keys of the lines ``at``."""
        size = self.ends[at] - self.starts[at]
        off = np.r_[0, np.cumsum(size)]
        byte = np.arange(off[-1]) + np.repeat(self.starts[at] - off[:-1], size)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(self.data[byte].tobytes())])

    def without(self, drop: np.ndarray) -> pa.Array:
        """The texts without the lines marked in ``drop``, the others joined by one line break."""
        kept = np.flatnonzero(~drop)
        rows = self.row[kept]
        last = np.ones(len(kept), bool)
        last[:-1] = rows[1:] != rows[:-1]
        # a line kept before another one has a break of its own behind it
        edge = np.zeros(len(self.raw) + 2, np.int32)
        np.add.at(edge, self.line_start[kept], 1)
        np.add.at(edge, self.line_end[kept] + ~last, -1)
        inside = np.cumsum(edge[:len(self.raw)]) > 0
        off = np.r_[0, np.cumsum(inside)][self.off]
        return pa.LargeStringArray.from_buffers(len(self.off) - 1, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(self.raw[inside].tobytes()))


class Bloom:
    """A Bloom filter of ``bits`` (a power of two) with two bits a hash."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.shift = np.uint64(64 - (bits.bit_length() - 1))
        self.data = np.zeros(bits // 8, np.uint8) if data is None else data

    def _bits(self, h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        places = [(x >> self.shift).astype(np.int64) for x in (h, mix(h))]
        return [(p >> 3, np.left_shift(np.uint8(1), (p & 7).astype(np.uint8))) for p in places]

    def add(self, h: np.ndarray) -> None:
        for byte, bit in self._bits(h):
            np.bitwise_or.at(self.data, byte, bit)

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for byte, bit in self._bits(h):
            out &= (self.data[byte] & bit) != 0
        return out


def _bits(lines: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, 1 << int(lines * BITS_PER_LINE).bit_length()))


def seen_twice(docs: DataFrame, bits: int, min_chars: int) -> DataFrame:
    """(chunk, data): chunks of the filter of keys in two or more texts, for those with a bit set."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = Bloom(bits), Bloom(bits)
        for batch in batches:
            for part in slices(batch, "text"):
                lines = Lines(part.column(1))
                at = np.flatnonzero(lines.counted(min_chars))
                order = at[np.lexsort((lines.row[at], lines.hash[at]))]
                h, row = lines.hash[order], lines.row[order]
                new = np.ones(len(h), bool)
                new[1:] = h[1:] != h[:-1]
                other = np.zeros(len(h), bool)  # the same key as the line before, in another text
                other[1:] = ~new[1:] & (row[1:] != row[:-1])
                twice.add(h[other])
                h = h[new]
                twice.add(h[once.has(h)])
                once.add(h)
        pack = zstandard.ZstdCompressor(level=1).compress
        for c in range(0, bits // 8, CHUNK_BYTES):
            a, b = once.data[c:c + CHUNK_BYTES], twice.data[c:c + CHUNK_BYTES]
            if a.any():
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([c // CHUNK_BYTES], pa.int32()), "once": [pack(a.tobytes())], "twice": [pack(b.tobytes())]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        at, once, twice = None, None, None

        def done():
            return pa.RecordBatch.from_pydict({"chunk": pa.array([at], pa.int32()), "data": [pack(twice.tobytes())]})

        for batch in batches:
            for c, a, b in zip(*(batch.column(k).to_pylist() for k in range(3))):
                a, b = (np.frombuffer(unpack(x), np.uint8) for x in (a, b))
                if c != at:
                    if at is not None and twice.any():
                        yield done()
                    at, once, twice = c, a, b
                else:
                    twice = twice | b | (once & a)
                    once = once | a
        if at is not None and twice.any():
            yield done()

    chunks = docs.mapInArrow(local, "chunk int, once binary, twice binary")
    return chunks.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(merge, "chunk int, data binary")


def _sent_filter(docs: DataFrame, min_chars: int):
    """The merged twice filter in every task: at most ``MAX_BITS / 8`` bytes, see the docstring."""
    spark = docs.sparkSession
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    bits = _bits(docs.agg(F.sum(breaks).alias("n")).first()["n"] or 0)
    data = np.zeros(bits // 8, np.uint8)
    unpack = zstandard.ZstdDecompressor().decompress
    for r in seen_twice(docs, bits, min_chars).toArrow().to_pylist():
        data[r["chunk"] * CHUNK_BYTES:][:CHUNK_BYTES] = np.frombuffer(unpack(r["data"]), np.uint8)
    return spark.sparkContext.broadcast((bits, data))


def suspects(docs: DataFrame, sent, min_chars: int) -> DataFrame:
    """(key, texts, id, line): keys that the twice filter knows, once for each slice of texts."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = Bloom(*sent.value)
        for batch in batches:
            for part in slices(batch, "text"):
                lines = Lines(part.column(1))
                at = np.flatnonzero(lines.counted(min_chars))
                at = at[twice.has(lines.hash[at])]
                if not len(at):
                    continue
                coded = lines.keys(at).dictionary_encode()
                code = np.asarray(coded.indices, np.int64)
                rank = np.empty(part.num_rows, np.int64)
                rank[np.asarray(pc.sort_indices(part.column(0), null_placement="at_start"))] = np.arange(part.num_rows)
                row = lines.row[at]
                order = np.lexsort((lines.number()[at], rank[row], code))
                c, r = code[order], row[order]
                new = np.ones(len(c), bool)
                new[1:] = (c[1:] != c[:-1]) | (r[1:] != r[:-1])
                texts = np.bincount(c[new], minlength=len(coded.dictionary))
                head = order[np.r_[True, c[1:] != c[:-1]]]
                yield pa.RecordBatch.from_arrays([
                    coded.dictionary.cast(pa.binary()), pa.array(texts.astype(np.int64)),
                    part.column(0).take(pa.array(row[head])), pa.array(lines.number()[at[head]].astype(np.int64))], ["key", "texts", "id", "line"])

    return docs.mapInArrow(run, f"key binary, texts long, id {kind}, line long")


def repeated_keys(docs: DataFrame, sent, min_docs: int, min_chars: int) -> DataFrame:
    """(key, texts, first): keys in at least ``min_docs`` texts, their number and first (id, line)."""
    rows = suspects(docs, sent, min_chars).groupBy("key").agg(F.sum("texts").alias("texts"), F.min(F.struct("id", "line")).alias("first"))
    return saved(rows.where(F.col("texts") >= min_docs), "lines-keys")


_OUT = "text string, n_lines long, n_dropped long"


def _cut(part: pa.RecordBatch, lines: Lines, drop: np.ndarray) -> pa.RecordBatch:
    gone = np.add.reduceat(np.r_[drop, False].astype(np.int64), lines.first[:-1])
    return pa.RecordBatch.from_arrays(
        [part.column(0), lines.without(drop).cast(pa.string()), pa.array(np.diff(lines.first).astype(np.int64)), pa.array(gone)], ["id", "text", "n_lines", "n_dropped"])


def _stays(part: pa.RecordBatch, lines: Lines, at: np.ndarray, ids: pa.Array, number: np.ndarray) -> np.ndarray:
    """Whether the lines ``at`` are the first occurrences (ids, number)."""
    mine = part.column(0).take(pa.array(lines.row[at]))
    same = pc.or_(pc.fill_null(pc.equal(mine, ids), False), pc.and_(pc.is_null(mine), pc.is_null(ids)))
    return np.asarray(same.to_numpy(zero_copy_only=False), bool) & (lines.number()[at] == number)


def _drop_sent(docs: DataFrame, repeated: DataFrame, min_chars: int, keep_first: bool) -> DataFrame:
    kind = docs.schema["id"].dataType.simpleString()
    table = repeated.select("key", F.col("first.id").alias("id"), F.col("first.line").alias("line")).toArrow().combine_chunks()
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        keys = pa.chunked_array(known.column("key").chunks, pa.binary()).cast(pa.large_binary()).combine_chunks()
        number, ids = known.column("line").to_numpy(), known.column("id").combine_chunks()
        marks = Lines(pa.compute.cast(keys, pa.large_string())).hash if len(keys) else np.zeros(0, np.uint64)
        order = np.argsort(marks)
        marks = marks[order]
        for batch in batches:
            for part in slices(batch, "text"):
                lines = Lines(part.column(1))
                drop = np.zeros(len(lines.row), bool)
                if len(marks):
                    at = np.flatnonzero(lines.counted(min_chars))
                    place = np.minimum(np.searchsorted(marks, lines.hash[at]), len(marks) - 1)
                    at = at[marks[place] == lines.hash[at]]
                    if len(at):  # whole keys decide
                        some = order[np.isin(marks, lines.hash[at])]
                        found = np.asarray(pc.fill_null(pc.index_in(lines.keys(at), value_set=keys.take(pa.array(some))), -1), np.int64)
                        at, found = at[found >= 0], some[found[found >= 0]]
                        gone = np.ones(len(at), bool)
                        if keep_first:
                            gone = ~_stays(part, lines, at, ids.take(pa.array(found)), number[found])
                        drop[at[gone]] = True
                yield _cut(part, lines, drop)

    return docs.mapInArrow(run, f"id {kind}, {_OUT}")


def _drop_joined(docs: DataFrame, repeated: DataFrame, sent, min_chars: int, keep_first: bool) -> DataFrame:
    kind = docs.schema["id"].dataType.simpleString()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = Bloom(*sent.value)
        for batch in batches:
            for part in slices(batch, "text"):
                lines = Lines(part.column(1))
                at = np.flatnonzero(lines.counted(min_chars))
                at = at[twice.has(lines.hash[at])]
                row = pa.array(lines.row[at])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(row), part.column(2).take(row), pa.array(lines.number()[at].astype(np.int64)), lines.keys(at).cast(pa.binary())],
                    ["id", "mark", "line", "key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                lines = Lines(part.column(1))
                drop = np.zeros(len(lines.row), bool)
                gone = part.column(2)
                row = np.asarray(pc.list_parent_indices(gone), np.int64)
                drop[lines.first[row] + np.asarray(pc.list_flatten(gone), np.int64)] = True
                yield _cut(part, lines, drop)

    salt = lambda *c: F.pmod(F.xxhash64(*c), F.lit(SALTS))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    # rows are told apart by id and text; those that agree in both lose the same lines
    docs = docs.withColumn("mark", F.md5(F.to_json(F.struct("id", "text"))))
    rows = docs.mapInArrow(listed, f"id {kind}, mark string, line long, key binary").withColumn("salt", salt("mark", "line"))
    rows = rows.join(repeated.select("key", "first", each.alias("salt")), ["key", "salt"])
    if keep_first:
        rows = rows.where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("line") == F.col("first.line"))))
    gone = rows.groupBy("mark").agg(F.collect_set("line").alias("gone")).withColumn("salt", each)
    spread = docs.withColumn("salt", F.floor(F.rand(7) * SALTS).cast("long"))
    merged = spread.join(gone, ["mark", "salt"], "left")
    return merged.select("id", "text", F.coalesce("gone", F.array().cast("array<long>")).alias("gone")).mapInArrow(cut, f"id {kind}, {_OUT}")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
                keep_first: bool = False, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(id, text, n_lines, n_dropped): every text without the lines of keys in ``min_docs`` texts or more."""
    if min_docs < 2 or min_chars < 1:
        raise ValueError("min_docs is 2 and min_chars 1 at least")
    docs = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sent = _sent_filter(docs, min_chars)
    repeated = repeated_keys(docs, sent, min_docs, min_chars)
    size = repeated.agg(F.sum(F.octet_length("key") + 32).alias("n")).first()["n"] or 0
    if size <= sent_bytes:
        return _drop_sent(docs, repeated, min_chars, keep_first)
    return _drop_joined(docs, repeated, sent, min_chars, keep_first)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``: lines of keys in at least 10 documents are dropped."""
    out = dedup_lines(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
