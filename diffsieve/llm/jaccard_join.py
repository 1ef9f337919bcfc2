"""N-gram Jaccard join as a blocked sparse matrix product (operator 5).

Rows of the incidence matrix A are texts, columns are shingles (``N`` consecutive words; a shorter text is one
shingle). Pairs with Jaccard similarity of at least ``threshold`` are entries of A A^T that are large
enough for the two set sizes. Texts with the same set are one class (kept by its smallest id),
so copies never meet each other.

* Size bounds: sizes a <= b can only link if a >= t b, and then share at least t / (1 + t) (a + b)
  shingles, so they differ in at most (1 - t) / (1 + t) (a + b). In any order of the columns two
  linked rows share a column among their first ``a - ceil(t a) + 1`` ones; only these entries of A (in
  hash order) are multiplied, and of them only columns with two entries (``keep_repeated``).
* Columns are dealt in blocks by their hash. Within a column, rows sorted by size form bands that
  the size bound allows. A pair is dropped when the parity sketches of the two sets (``SKETCH``
  bits, every shingle flips one; ``WIDE_SKETCH`` for large sets in crowded columns) differ in more bits than the sets may differ in shingles, and when
  the overlap counted over all blocks is too low for the sizes; that of the rest is counted on the
  whole sets. A row carries its ``HEAD`` smallest columns: a pair that shares one of them is named by
  the smallest shared one alone, however many columns and tasks it meets in, and needs no count.
* Near rounds first (``TURNS``): in the columns of each row's ``EARLY`` smallest hashes a row proposes
  one other row, that of the closest sketch among its ``NEAR`` neighbours on both sides in the order of
  sizes (equal sizes in another random order each turn), if they are in different components. Proposed
  pairs are checked on the whole sets, and links merge components before the next turn. So a large
  group of near copies costs a few pairs a row instead of all its pairs.
* Then the whole product: all pairs of rows in different components, columns within one component
  being skipped. A pair that is left out is connected already, so components lose no link. A
  column of over ``CELL`` rows is dealt in cells of two blocks of its rows, a task each.
* Components of the links are found by smallest-label propagation with pointer jumping, in tables.

Results: per row the size of its set and its component, the smallest id that links lead to. Defined
results: null text, empty text and text without words have no shingle and link with nothing; rows
without links are their own component; repeated rows are copies; rows with a null id take no part
(their component is null); texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._io import read, saved
from ._words import SPACE, Words, keep_repeated, mix, own_repeats, slices, window_hash

N, PERCENT, SKETCH = 5, 80, 512
#: Sketch of sets over LARGE shingles, for columns of over CROWDED rows.
WIDE_SKETCH, LARGE, CROWDED = 4096, 700, 6
TURNS, EARLY, NEAR = 3, 6, 12
HEAD = 4
CELL = 4096
#: Class names up to this many (counted; 16 bytes each) are sent to the tasks that look for their texts.
SENT_NAMES = 2_000_000


def _sets(w: Words, n: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes sorted within each row, row offsets)."""
    size = np.diff(w.first)
    at = w.whole(n)
    keys, row = [window_hash(w.hash, n)[at]], [w.row[at]]
    for k in range(1, n):  # short rows are one shingle
        short = w.first[:-1][size == k]
        if len(short):
            keys.append(window_hash(w.hash, k)[short])
            row.append(w.row[short])
    key, row = np.concatenate(keys), np.concatenate(row)
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    key, row = key[new], row[new]
    return key, np.searchsorted(row, np.arange(rows + 1))


def _sketch(key: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(rows, WIDE_SKETCH / 64) parity sketches; their folds are the narrow ones."""
    rows = len(off) - 1
    out = np.zeros((rows, WIDE_SKETCH // 64), np.uint64)
    bit = (mix(key ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(WIDE_SKETCH)).astype(np.int64)
    for a in range(0, rows, 256):  # counts of a few rows at a time
        b = min(a + 256, rows)
        at = slice(off[a], off[b])
        row = np.repeat(np.arange(b - a), np.diff(off[a:b + 1]))
        flips = np.bincount(row * WIDE_SKETCH + bit[at], minlength=(b - a) * WIDE_SKETCH) & 1
        out[a:b] = np.packbits(flips.astype(np.uint8), bitorder="little").view(np.uint64).reshape(b - a, -1)
    return out


def _folded(wide: np.ndarray) -> np.ndarray:
    """Narrow sketches: the parity of the wide one's bits that share a place."""
    return np.bitwise_xor.reduce(wide.reshape(len(wide), WIDE_SKETCH // SKETCH, SKETCH // 64), axis=1)


def _class_hash(key: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(rows, 2): 128-bit hash of each row's set."""
    raw = b"".join(hashlib.blake2b(key[a:b].tobytes(), digest_size=16).digest() for a, b in zip(off, off[1:]))
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


def _heads(key: np.ndarray, off: np.ndarray, percent: int) -> np.ndarray:
    """(rows, HEAD): each row's smallest columns, in a short prefix the first one again."""
    size = np.diff(off)
    place = np.arange(HEAD)[None, :]
    at = off[:-1, None] + np.where(place < _prefix(size, percent)[:, None], place, 0)
    return np.where(size[:, None] > 0, np.append(key, np.uint64(0))[at], np.uint64(0))


def classes(docs: DataFrame, kind: str, n: int, percent: int) -> DataFrame:
    """(id, size, c1, c2, sketch, wide, head): set size, 128-bit hash of the set, its parity sketches and smallest columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                key, off = _sets(Words(part.column(1), SPACE, lower=True), n, part.num_rows)
                half = _class_hash(key, off)
                size = np.diff(off)
                wide = _sketch(key, off)
                head = [x.tobytes() for x in _heads(key, off, percent)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size.astype(np.int64)), pa.array(half[:, 0].copy()), pa.array(half[:, 1].copy()),
                                                  pa.array([x.tobytes() for x in _folded(wide)], pa.binary()), pa.array([x.tobytes() if n > LARGE else None for x, n in zip(wide, size)], pa.binary()), pa.array(head, pa.binary())],
                                                 ["id", "size", "c1", "c2", "sketch", "wide", "head"])

    return docs.mapInArrow(run, f"id {kind}, size long, c1 long, c2 long, sketch binary, wide binary, head binary")


def prefix_entries(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(key, c1, size, early): prefix columns that occur in two rows, a slice's copies taken once.

    early: the column is among the row's ``EARLY`` smallest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                key, off = _sets(Words(part.column(1), SPACE, lower=True), n, part.num_rows)
                size = np.diff(off)
                c1 = _class_hash(key, off)[:, 0]
                _, first = np.unique(c1, return_index=True)
                first = first[size[first] > 0]
                take = _prefix(size[first], percent)
                at = np.repeat(off[first] - (np.cumsum(take) - take), take) + np.arange(take.sum())
                row = np.repeat(first, take)
                # a column's entries in this slice are all sure if there are two; all but the first are spread
                one, sure = own_repeats(key[at])
                spread = np.where(one, 0, 1 + (mix(c1[row].view(np.uint64)) % np.uint64(30_000)).astype(np.int64))
                early = at - off[row] < EARLY
                mark = spread << 48 | size[row] << 2 | early.astype(np.int64) << 1 | sure
                yield pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), pa.array(c1[row]), pa.array(mark)], ["key", "c1", "mark"])

    spread = F.shiftright("mark", 48)
    found = keep_repeated(docs.mapInArrow(run, "key long, c1 long, mark long"), "key long, c1 long, mark long",
                          derived={"sure": F.col("mark") % 2 == 1}, dealt_by=("key", spread))
    mark = F.col("mark").bitwiseAND(F.lit((1 << 48) - 1))
    return found.select("key", "c1", F.shiftright(mark, 2).cast("int").alias("size"), (F.shiftright(mark, 1) % 2 == 1).alias("early"))


def _prefix(size: np.ndarray, percent: int) -> np.ndarray:
    """Columns of a row that a linked row must share one of: size - ceil(percent size) + 1."""
    return size + (-percent * size // 100) + 1


class _Sketches:
    """Sketches of rows, narrow for all and wide for some, and the test of pairs of rows."""

    def __init__(self, raw: list[bytes], size: np.ndarray, percent: int):
        self.size, self.percent = size.astype(np.int64), percent
        long = np.array([len(x) > SKETCH // 8 for x in raw], bool)
        self.wide_at = np.cumsum(long) - 1
        self.wide_at[~long] = -1
        self.wide = np.frombuffer(b"".join(x for x in raw if len(x) > SKETCH // 8), np.uint64).reshape(-1, WIDE_SKETCH // 64)
        self.narrow = np.zeros((len(raw), SKETCH // 64), np.uint64)
        self.narrow[~long] = np.frombuffer(b"".join(x for x in raw if len(x) == SKETCH // 8), np.uint64).reshape(-1, SKETCH // 64)
        self.narrow[long] = _folded(self.wide)

    def _close(self, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        differ = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
        return differ * (100 + self.percent) <= (self.size[i] + self.size[j]) * (100 - self.percent)

    def may_link(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Positions of the pairs of rows that their sketches don't rule out."""
        good = np.flatnonzero(self._close(self.narrow[i], self.narrow[j], i, j))
        both = (self.wide_at[i[good]] >= 0) & (self.wide_at[j[good]] >= 0)
        drop = np.zeros(len(good), bool)
        for a in range(0, len(good), 4096):
            some = np.flatnonzero(both[a:a + 4096]) + a
            x, y = i[good[some]], j[good[some]]
            drop[some] = ~self._close(self.wide[self.wide_at[x]], self.wide[self.wide_at[y]], x, y)
        return good[~drop]


def _counted(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Distinct pairs (a < b) of lists of pairs, with their sizes and the sum of what each shares."""
    a, b, size_a, size_b, shared = (np.concatenate(x) for x in zip(*found))
    swap = a > b
    a, b, size_a, size_b = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, size_b, size_a), np.where(swap, size_a, size_b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    columns = a[new], b[new], size_a[order][new], size_b[order][new], np.add.reduceat(shared[order], new)
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], ["a", "b", "size_a", "size_b", "shared"])


def _named_here(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of pairs that column ``key`` names, whether heads share a column); a, b: heads of the pairs' rows."""
    both = (a[:, :, None] == b[:, None, :]).any(axis=2)
    named = both.any(axis=1)
    first = a[np.arange(len(a)), both.argmax(axis=1)]  # heads are in the same order, so it is the same for both
    return np.flatnonzero(~named | (first == key)), named


_PAIRS = "a long, b long, size_a long, size_b long, shared long"


def proposals(entries: DataFrame, percent: int, turn: int) -> DataFrame:
    """(a, b): for each row of a column the closest of its neighbours in another component.

    entries: (key, c1, size, comp, sketch, blocks). A column is dealt by ``blocks``, and a batch of
    rows is worked off by itself, so a hot column needs no more memory than others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, pending = [], 0
        for batch in batches:
            key, c1, size, comp = (batch.column(k).to_numpy() for k in range(4))
            order = np.lexsort((mix(c1.view(np.uint64) ^ np.uint64(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)), size, key))
            key, c1, size, comp = key[order], c1[order], size[order].astype(np.int64), comp[order]
            sketches = _Sketches(batch.column(4).take(pa.array(order)).to_pylist(), size, percent)
            best, mate = np.full(len(key), 1 << 30), np.full(len(key), -1)
            for step in range(1, min(NEAR, len(key) - 1) + 1):
                i = np.flatnonzero((key[:-step] == key[step:]) & (comp[:-step] != comp[step:]) & (size[step:] <= size[:-step] * 100 // percent))
                far = np.bitwise_count(sketches.narrow[i] ^ sketches.narrow[i + step]).sum(axis=1, dtype=np.int64)
                for own, other in ((i, i + step), (i + step, i)):
                    closer = far < best[own]
                    best[own[closer]], mate[own[closer]] = far[closer], other[closer]
            i = np.flatnonzero(mate >= 0)
            i = i[sketches.may_link(i, mate[i])]
            if len(i):
                found.append((c1[i], c1[mate[i]], size[i], size[mate[i]], np.ones(len(i), np.int64)))
                pending += len(i)
            if pending > 500_000:
                yield _counted(found)
                found, pending = [], 0
        if found:
            yield _counted(found)

    block = F.pmod(F.xxhash64("c1"), F.col("blocks"))
    dealt = entries.withColumn("block", block).repartition("key", "block").sortWithinPartitions("key", "block")
    return dealt.select("key", "c1", "size", "comp", "sketch").mapInArrow(run, _PAIRS).select("a", "b").distinct()


def product(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b): class pairs that share a column, fit in size and sketch and differ in component.

    entries: (key, c1, size, comp, sketch, head, blocks). A column of several blocks becomes a cell for
    every two of its blocks, with the rows of both; a cell fits into a task.
    A pair whose heads share a column comes from the smallest such column only: near copies share most
    of their columns and would come from every task. The other pairs come from each column they share.
    These overlaps add up to the overlap of two prefixes; what lies beyond
    the shorter one can add no more than its row's other columns, so pairs that stay below the
    overlap that their sizes ask for are discarded.
    """
    block = 256

    def group(x: int, size: np.ndarray, comp: np.ndarray, side: np.ndarray, sketches: _Sketches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of the cell whose rows start at ``x``; in a cell of two blocks only pairs across them."""
        reach = np.searchsorted(size, size * 100 // percent, side="right")
        across = side.min() != side.max()
        for a in range(0, len(size), block):
            rows = np.arange(a, min(a + block, len(size)))
            for b in range(a, int(reach[rows].max()), block):
                cols = np.arange(b, min(b + block, len(size)))
                ok = (cols[None, :] > rows[:, None]) & (cols[None, :] < reach[rows][:, None]) & (comp[rows][:, None] != comp[cols][None, :])
                if across:
                    ok &= side[rows][:, None] != side[cols][None, :]
                i, j = np.nonzero(ok)
                i, j = rows[i] + x, cols[j] + x
                good = sketches.may_link(i, j)
                yield i[good], j[good]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found, pending = None, [], 0

        def add(i: np.ndarray, j: np.ndarray, key: np.ndarray, c1: np.ndarray, size: np.ndarray, head: np.ndarray) -> None:
            nonlocal pending
            own, named = _named_here(key[i], head[i], head[j])
            i, j = i[own], j[own]
            if len(i):
                found.append((c1[i], c1[j], size[i], size[j], np.where(named[own], size[i] + size[j], 1)))
                pending += len(i)

        def starts(*columns: np.ndarray) -> np.ndarray:
            new = np.ones(len(columns[0]), bool)
            new[1:] = False
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            return np.flatnonzero(new)

        def made(t: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal found, pending
            key, cell, c1 = (t.column(c).to_numpy() for c in ("key", "cell", "c1"))
            size, comp, side = (t.column(c).to_numpy() for c in ("size", "comp", "side"))
            own = starts(key, cell, size, c1)  # rows come sorted
            key, cell, c1, size, comp, side = (x[own] for x in (key, cell, c1, size, comp, side))
            sketches = _Sketches(t.column("sketch").take(pa.array(own)).to_pylist(), size, percent)
            head = np.frombuffer(b"".join(t.column("head").take(pa.array(own)).to_pylist()), np.int64).reshape(-1, HEAD)
            cut = starts(key, cell)
            rows = np.diff(np.append(cut, len(key)))
            i = cut[(rows == 2) & (cell[cut] < 0)]  # most columns: all at once
            i = i[(comp[i] != comp[i + 1]) & (size[i + 1] <= size[i].astype(np.int64) * 100 // percent)]
            i = i[sketches.may_link(i, i + 1)]
            add(i, i + 1, key, c1, size, head)
            mixed = (np.minimum.reduceat(comp, cut) != np.maximum.reduceat(comp, cut)) & ((rows > 2) | (cell[cut] >= 0))
            for x, n in zip(cut[mixed].tolist(), rows[mixed].tolist()):
                for i, j in group(x, size[x:x + n], comp[x:x + n], side[x:x + n], sketches):
                    add(i, j, key, c1, size, head)
                    if pending > 500_000:
                        yield _counted(found)
                        found, pending = [], 0

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            if not t.num_rows:
                continue
            key, cell = t.column("key").to_numpy(), t.column("cell").to_numpy()
            last = int(np.flatnonzero((key != key[-1]) | (cell != cell[-1]))[-1]) + 1 if (key[0], cell[0]) != (key[-1], cell[-1]) else 0
            held = t.slice(last)
            if last:
                yield from made(t.slice(0, last))
        if held is not None:
            yield from made(held)
        if found:
            yield _counted(found)

    # a row of block x meets every block y of its column in the cell (smaller, larger)
    side = F.pmod(F.xxhash64("c1"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    one = entries.where("blocks = 1").select("key", F.lit(-1).cast("long").alias("cell"), "c1", "size", "comp", F.lit(0).alias("side"), "sketch", "head")
    more = entries.where("blocks > 1").withColumn("side", side).select("*", other)
    cell = F.least("side", "other").cast("long") * F.col("blocks") + F.greatest("side", "other")
    cells = one.unionByName(more.select("key", cell.alias("cell"), "c1", "size", "comp", "side", "sketch", "head"))
    dealt = cells.repartition("key", "cell").sortWithinPartitions("key", "cell", "size", "c1")
    pairs = dealt.select("key", "cell", "c1", "size", "comp", "side", "sketch", "head").mapInArrow(run, _PAIRS)
    pairs = pairs.groupBy("a", "b", "size_a", "size_b").agg(F.sum("shared").alias("shared"))
    beyond = F.ceil(F.greatest("size_a", "size_b") * percent / 100) - 1  # outside the longer row's prefix
    needed = F.ceil((F.col("size_a") + F.col("size_b")) * percent / (100 + percent))
    return pairs.where(F.col("shared") + beyond >= needed).select("a", "b")


def shingle_sets(docs: DataFrame, n: int) -> DataFrame:
    """(c1, shingles) of the rows (c1, text) of which the text has the set named by ``c1``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                key, off = _sets(Words(part.column(1), SPACE, lower=True), n, part.num_rows)
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(key.view(np.int64)))
                own = part.column(0).to_numpy() == _class_hash(key, off)[:, 0]  # rows may share an id
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["c1", "shingles"]).filter(pa.array(own))

    return docs.mapInArrow(run, "c1 long, shingles array<long>")


def links(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets overlap enough; rows: (id, text), nodes: (c1, rep)."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("c1")).distinct().join(nodes, "c1").select("c1", F.col("rep").alias("id"))
    needed = saved(needed, "jaccard-names")
    needed = F.broadcast(needed) if needed.count() <= SENT_NAMES else needed
    sets = saved(shingle_sets(rows.join(needed, "id").select("c1", "text"), n), "jaccard-sets")
    both = pairs.join(sets.select(F.col("c1").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("c1").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(c1, comp): the smallest label that edges (a, b) lead to; nodes: (c1, comp) with first labels.

    Each round takes the smallest label around every node, then the label of that label's node;
    rounds are written as tables.
    """
    if not edges.limit(1).count():
        return nodes
    both = saved(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "jaccard-edges")
    touched = both.select(F.col("a").alias("c1")).distinct()
    own = saved(nodes.join(touched, "c1", "left_semi"), "jaccard-labels")
    while True:
        around = both.join(own.select(F.col("c1").alias("b"), F.col("comp").alias("near")), "b").groupBy(F.col("a").alias("c1")).agg(F.min("near").alias("near"))
        step = own.join(around, "c1").select("c1", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        # every member of a label's group learns the smallest label that any of them has met
        best = step.groupBy("old").agg(F.min("comp").alias("best"))
        step = saved(step.join(best, "old").select("c1", "old", F.least("comp", "best").alias("comp")), "jaccard-labels")
        own = step.select("c1", "comp")
        if not step.where("comp != old").limit(1).count():
            break
    rest = nodes.join(touched, "c1", "left_anti")
    return rest.unionByName(own)


def similarity_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) of every row; ids: whole numbers."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    made = saved(classes(rows, "long", n, percent), "jaccard-classes")
    some = made.where("size > 0 and id is not null")
    members = some.groupBy("c1", "c2", "size").agg(F.min("id").alias("rep"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide"), F.first("head").alias("head"))
    members = saved(members, "jaccard-members")  # c1 names a class in pairs; c2 guards it
    nodes = saved(members.groupBy("c1").agg(F.min("rep").alias("comp"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide"), F.first("head").alias("head"), F.first("rep").alias("rep")), "jaccard-nodes")
    entries = saved(prefix_entries(rows, n, percent), "jaccard-entries")
    labels, edges = nodes.select("c1", "comp"), None
    for turn in range(TURNS + 1):
        whole = turn == TURNS
        own = entries if whole else entries.where("early")
        # columns within one component have nothing left to say
        mixed = own.join(labels, "c1").groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("rows"))
        mixed = mixed.where("x != y").select("key", (F.col("rows") > CROWDED).alias("crowded"), F.ceil(F.col("rows") / CELL).cast("int").alias("blocks"))
        known = labels.join(nodes.select("c1", "sketch", "wide", "head"), "c1")
        wide = F.col("wide").isNotNull() & (F.col("crowded") if whole else F.lit(True))
        rows_in = own.join(mixed, "key").join(known, "c1").withColumn("sketch", F.when(wide, F.col("wide")).otherwise(F.col("sketch")))
        rows_in = rows_in.select("key", "c1", "size", "comp", "sketch", *(["head"] if whole else []), "blocks")
        pairs = saved(product(rows_in, percent) if whole else proposals(rows_in, percent, turn), "jaccard-pairs")
        if not pairs.limit(1).count():
            continue
        found = saved(links(pairs, rows, nodes.select("c1", "rep"), n, percent), "jaccard-links")
        edges = found if edges is None else edges.unionByName(found)
        labels = saved(components(nodes.select("c1", "comp"), edges), "jaccard-components")
    known = members.select("c1", "c2", "size", "rep").join(labels, "c1").select("c1", "c2", "size", "comp")
    linked = some.join(known, ["c1", "c2", "size"]).select("id", "size", "comp")
    alone = made.where("size = 0 or id is null").select("id", "size", F.col("id").alias("comp"))
    return linked.unionByName(alone).select(F.col("id").cast(kind).alias(id_col), F.col("size").alias("n_shingles"), F.col("comp").cast(kind).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the text of its smallest id, once.

    Rows without words, or with a null id, are linked with nothing and stay.
    """
    names = docs.columns
    joined = similarity_classes(docs, id_col, text)
    firsts = joined.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("first_id")).distinct()
    rows = docs.select(*[F.col(c).alias(f"of_{i}") for i, c in enumerate(names)])
    own_id, own_text = (F.col(f"of_{names.index(c)}") for c in (id_col, text))
    kept = rows.join(firsts, own_id == F.col("first_id"), "left_semi")
    kept = kept.withColumn("place", F.row_number().over(Window.partitionBy(own_id, F.xxhash64(own_text)).orderBy(own_id)))
    wordless = own_text.isNull() | ~own_text.rlike(r"[^\x20\x09-\x0D]")
    kept = kept.where((F.col("place") == 1) | wordless).drop("place")
    return kept.unionByName(rows.where(own_id.isNull())).toDF(*names)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(read(spark, sf_dir, "documents").select("doc_id", "text"))
