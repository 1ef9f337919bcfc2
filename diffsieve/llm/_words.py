"""Word hashing over Arrow text buffers, and the search for keys that occur twice.

Everything works on the UTF-8 bytes of a column slice, so no Python string is made per
word. Null texts have no words; words never cross a row's end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

SLICE_BYTES = 4 << 20
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
_C = np.uint64(0xD6E8FEB86659FD93)


def separator_table(*ranges: tuple[int, int]) -> np.ndarray:
    """Byte table that is true for separators, given inclusive byte ranges."""
    t = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        t[lo:hi + 1] = True
    return t


#: Words are runs of anything but ASCII white space.
SPACE = separator_table((0x20, 0x20), (0x09, 0x0D))
#: Words are runs of ASCII letters, digits and all non-ASCII characters.
NON_ALNUM = separator_table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C
    return x ^ (x >> np.uint64(29))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of about ``limit`` bytes of text, one row at least."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; null rows are empty."""
    column = pa.compute.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


class Words:
    """Words of a column slice: byte spans, 64-bit hashes and the first word of each row."""

    def __init__(self, column: pa.Array, separators: np.ndarray = SPACE, lower: bool = False):
        data, off = text_bytes(column)
        if lower:
            data = LOWER[data]
        inside = np.zeros(len(data) + 2, dtype=bool)
        inside[1:-1] = ~separators[data]
        begin, end = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        edges = off[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        begin[edges] = inside[1:-1][edges]
        end[edges - 1] = inside[1:-1][edges - 1]
        self.data, self.starts, self.ends = data, np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, off)  # of each row; one more for the end
        self.row = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        self.pos = np.arange(len(self.starts)) - self.first[self.row]
        self.hash = self._hash()

    def _hash(self) -> np.ndarray:
        size = self.ends - self.starts
        h = size.astype(np.uint64) * _A
        if not len(size):
            return h
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        live, at = np.arange(len(size)), 0
        while len(live):
            left = np.minimum(size[live] - at, 8).astype(np.uint64)
            v = eight[self.starts[live] + at] << (np.uint64(64) - left * np.uint64(8))
            h[live] = mix((h[live] ^ v) * _B)
            at += 8
            live = live[size[live] > at]
        return h

    def whole(self, width: int) -> np.ndarray:
        """Word indexes at which a window of ``width`` words fits into its row."""
        return np.flatnonzero(self.pos + width <= np.diff(self.first)[self.row])


def window_hash(h: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hashes of h[i:i + width] for every i, in about log2(width) passes."""
    out, done, step, span = None, 0, h ^ np.uint64(seed * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF), 1
    n = max(0, len(h) - width + 1)
    while True:
        if width & span:
            part = step[done:done + n]
            out = part if out is None else mix(out * _A + part)
            done += span
        if span * 2 > width:
            return mix(out[:n] * _B + np.uint64(width))
        step = mix(step[:max(0, len(step) - span)] * _B + step[span:])
        span *= 2


def own_repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first occurrence of its key, key occurs twice) for each entry."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    twice = np.zeros(len(s), bool)
    twice[:-1] |= ~new[1:]
    twice[1:] |= ~new[1:]
    first, many = np.empty(len(s), bool), np.empty(len(s), bool)
    first[order], many[order] = new, twice
    return first, many


def spread_repeats(key: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys to deal rows by, and whether a row's key is known to occur twice.

    Of the rows of one key in this slice only the first keeps the key; the others, known to
    repeat, get a key made of ``rest``. So a task sends at most one row of a hot key a slice
    to the task that owns it, and every occurrence is still answered.
    """
    first, many = own_repeats(key)
    return np.where(first, key, mix(key ^ (rest * _A + np.uint64(1)))), many


def keep_repeated(rows: DataFrame, payload: str, by: tuple[str, ...] = ("key",), derived: dict | None = None, dealt_by: tuple | None = None) -> DataFrame:
    """Rows of which the key occurs in another row too, or that are ``sure`` already.

    rows: the columns ``by`` (whole numbers), ``sure`` (boolean) and those of the DDL ``payload``,
    which are returned. One shuffle by the first key column and one streaming pass over sorted
    rows; a batch's last row waits for its successor, so a task holds one batch. ``derived``
    columns are made behind the shuffle, from others that cross it. dealt_by: what to deal rows
    by instead of the first key column; rows that aren't sure must meet by it.
    """
    names = [x.split()[0] for x in payload.split(",")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, linked = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            same = np.ones(t.num_rows - 1, bool)
            for k in by:
                v = t.column(k).to_numpy()
                same &= v[1:] == v[:-1]
            keep = t.column("sure").to_numpy().astype(bool)
            keep[:-1] |= same
            keep[1:] |= same
            keep[0] |= linked
            linked = bool(keep[-1])
            held = t.slice(t.num_rows - 1)
            yield from t.slice(0, t.num_rows - 1).filter(pa.array(keep[:-1])).select(names).to_batches()
        if held is not None and linked:
            yield from held.select(names).to_batches()

    dealt = rows.repartition(*(dealt_by or by[:1])).withColumns(derived or {}).sortWithinPartitions(*by)
    return dealt.mapInArrow(scan, payload)
