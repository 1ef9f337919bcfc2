"""Best-fit packing in bulk-synchronous steps (operator 4).

``pieces`` tokenises every text, appends the end id and cuts only documents longer than
``capacity`` (full pieces, the last may be shorter). ``pack`` places the pieces:

* Pieces and gaps (the room left in open sequences) are range-sorted by size. Both are held
  as runs, ``size -> count`` for pieces and ``size -> ranges of sequence numbers`` for gaps. There are
  at most ``capacity`` sizes, so this state is bounded whatever the number of documents.
* A step takes the largest piece size. Its pieces sweep the gaps upwards from their successor (the
  smallest gap that holds them); of the pieces that want the same gap size, the piece of rank r gets
  the r-th gap (ranks decide conflicts, one piece a gap). Filled gaps move to their new size, and
  the step repeats until all pieces of the size are placed; where no gap fits, new
  sequences are opened, with as many pieces of the size as they hold.
* All pieces are then placed at once: a piece's rank among those of its size selects the
  range that its step assigned. Ranks come from a distributed count: pieces are numbered within
  (size, salt) groups, ``SALTS`` a size, and the groups' counts give each group's first rank, so a size that a
  third of all pieces has is spread over ``SALTS`` groups.

This is best-fit decreasing, whole: nothing is dropped, and only longer documents are cut. Defined
results: null and empty texts are one piece with the end id alone; rows that share an id are
packed each; ties in size are broken by a hash of id and piece, then by them; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._io import read, saved, worker_cache
from ._words import LOWER, slices, text_bytes

CAPACITY, END_ID, SALTS = 4096, 1, 64
#: Encoded parts that a worker remembers, at most, and their longest length.
KNOWN, KNOWN_LENGTH = 300_000, 64
SLICE_BYTES = 8 << 20



#: Lower-cases A-Z and makes ASCII white space blank.
_EVEN = LOWER.copy()
_EVEN[9:14] = 32

_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes; ``spec`` is the tokenizer's file.

    A text is encoded space by space: neither normalisation, pre-tokenisation nor merges of the
    given tokenizer reach over a blank (else, by ``splits_at_blanks``, texts are encoded whole).
    Short encoded parts are remembered within this worker, at most about ``KNOWN`` of them.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks in parallel
        from tokenizers import Tokenizer

        self.cache = worker_cache("packing", spec)
        if not self.cache:
            end = [k for k, v in json.loads(spec)["model"].get("vocab", {}).items() if k.endswith("</w>")]
            tokenizer = Tokenizer.from_str(spec)
            ends = np.zeros(tokenizer.get_vocab_size() + 1, bool)
            ends[[tokenizer.token_to_id(k) for k in end]] = True
            added = [t["content"] for t in json.loads(spec).get("added_tokens", [])]
            self.cache.update(tokenizer=tokenizer, parts={"": b""}, ends=ends, whole=not splits_at_blanks(spec), added=added)
        self.tokenizer, self.parts, self.ends, self.whole, self.added = (self.cache[k] for k in ("tokenizer", "parts", "ends", "whole", "added"))

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of single words, encoded as one text and cut where a token ends a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cut = np.flatnonzero(self.ends[ids]) + 1
        if len(cut) != len(words):
            return self._bytes(words)
        raw, cut = ids.tobytes(), (4 * cut).tolist()
        return [raw[a:b] for a, b in zip([0, *cut], cut)]

    def _add(self, names: list[str], parts: dict[str, bytes]) -> None:
        """Encodes the names that ``parts`` doesn't hold yet."""
        plain, other = {}, []
        low = []
        for p in names:
            if p.isascii() and p.isalpha() and p.islower():  # most: a word that is its own name
                low.append(p)
                continue
            m = _PLAIN.fullmatch(p)  # a word and the stop or comma behind it are separate tokens
            if m:
                plain[p] = m[1].lower(), m[2]
            else:
                other.append(p)
        words = list({w for w, _ in plain.values()}.union(low).difference(parts))
        for a in range(0, len(words), 20_000):
            parts.update(zip(words[a:a + 20_000], self._words(words[a:a + 20_000])))
        other += {mark for _, mark in plain.values()}.difference(parts)
        for a in range(0, len(other), 20_000):
            parts.update(zip(other[a:a + 20_000], self._bytes(other[a:a + 20_000])))
        for p, (word, mark) in plain.items():
            parts[p] = parts[word] + parts[mark]

    def _ids(self, names: list[str]) -> list[bytes]:
        """The ids of each name; short ones are remembered."""
        if len(self.parts) > KNOWN:
            self.parts.clear()
            self.parts[""] = b""
        found = list(map(self.parts.get, names))
        new = [i for i, x in enumerate(found) if x is None]
        short = [names[i] for i in new if len(names[i]) <= KNOWN_LENGTH]
        self._add(short, self.parts)
        long: dict[str, bytes] = {"": b""}
        if len(short) < len(new):
            self._add([names[i] for i in new if len(names[i]) > KNOWN_LENGTH], long)
        for i in new:
            name = names[i]
            found[i] = self.parts[name] if len(name) <= KNOWN_LENGTH else long[name]
        return found

    def _even(self, texts: pa.Array) -> pa.Array:
        """The texts with fewer distinct parts and the same ids: ASCII letters lower-cased, line
        breaks and tabs as blanks, blanks before stops. Texts that hold an added token stay."""
        data, off = text_bytes(texts)
        data = _EVEN[data]
        low = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(off), pa.py_buffer(data.tobytes()))
        special = np.zeros(len(texts), bool)
        for token in self.added:
            special |= np.asarray(pc.match_substring(low, token.lower()).to_numpy(zero_copy_only=False), bool)
        # a letter, a stop or comma and a blank: the mark is a token of its own
        letter = (data[:-2] >= 97) & (data[:-2] <= 122)
        at = np.flatnonzero(letter & ((data[1:-1] == 44) | (data[1:-1] == 46)) & (data[2:] == 32)) + 1
        off = off + np.searchsorted(at, off)
        apart = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(off), pa.py_buffer(np.insert(data, at, 32).tobytes()))
        return pc.if_else(pa.array(special), texts, apart) if special.any() else apart

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        ids, first = self.encode_column(pa.array(texts, pa.large_string()), END_ID)
        return [ids[a:b - 1].tobytes() for a, b in zip(first.tolist(), first[1:].tolist())]

    def encode_column(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each text's followed by ``end_id``; where each text's begin).

        The texts' parts are numbered in Arrow; only the distinct ones are looked at in Python.
        """
        if self.whole:
            part, size = self._bytes(texts.to_pylist()), np.ones(len(texts), np.int64)
            code = np.arange(len(texts))
        else:
            lists = pc.split_pattern(self._even(texts), " ")
            coded = pc.list_flatten(lists).dictionary_encode()
            part, code = self._ids(coded.dictionary.to_pylist()), np.asarray(coded.indices, np.int64)
            size = np.asarray(pc.list_value_length(lists), np.int64)
        # the end id is one more part, behind each text's parts; Arrow lays the parts out
        last = np.cumsum(size + 1)
        at = np.full(len(code) + len(size), len(part), np.int64)
        inside = np.ones(len(at), bool)
        inside[last - 1] = False
        at[inside] = code
        laid = pa.array([*part, np.array([end_id], "<u4").tobytes()], pa.large_binary()).take(pa.array(at))
        off, data = laid.buffers()[1:]
        off = np.frombuffer(off, np.int64)[:len(at) + 1] // 4
        ids = np.frombuffer(data, "<u4")[:off[-1]] if off[-1] else np.zeros(0, "<u4")
        return ids, off[np.r_[0, last]]


def splits_at_blanks(spec: str) -> bool:
    """Whether a tokenizer's file says that it folds case, drops white space and splits words from marks."""
    s = json.loads(spec)
    kinds = [n["type"] for n in (s.get("normalizer") or {}).get("normalizers", [])]
    pre = [p for p in (s.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    return (kinds == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in pre] == ["Split", "ByteLevel"] and pre[0]["behavior"] == "Removed"
            and pre[0]["pattern"].get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and pre[1]["add_prefix_space"] is False
            and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in s.get("added_tokens", [])))


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every row; ids are 32-bit little-endian."""
    kind = dict(docs.dtypes)[id_col]
    with open(tokenizer, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # executors needn't have the file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                texts = pc.fill_null(part.column(1).cast(pa.large_string()), "")
                ids, first = encoder.encode_column(texts, end_id)
                size = np.diff(first)
                many = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(size[row] - start, capacity)
                raw, at = memoryview(ids.tobytes()), 4 * (first[row] + start)
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                                                 ["id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Steps of best fit over piece sizes: (length, first_rank, n, sequence, stack, offset).

    ``n`` pieces of ``length`` from rank ``first_rank`` go to sequences from ``sequence`` on, ``stack`` to each,
    at ``offset`` and behind one another.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # room -> ranges (first sequence, count)
    sizes: list[int] = []  # rooms in use, sorted: the successor sweep runs over them
    opened, steps = 0, []

    def free(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in gaps:
                gaps[room] = []
                sizes.insert(int(np.searchsorted(sizes, room)), room)
            gaps[room].append((first, n))

    for length in sorted((k for k, v in counts.items() if v), reverse=True):
        left, rank = counts[length], 0
        while left:
            at = int(np.searchsorted(sizes, length))
            if at == len(sizes):
                fits = capacity // length
                full, rest = divmod(left, fits)
                for n, stack in ((full, fits), (1 if rest else 0, rest)):
                    if n:
                        steps.append((length, rank, n * stack, opened, stack, 0))
                        free(capacity - stack * length, opened, n)
                        rank, opened, left = rank + n * stack, opened + n, left - n * stack
                break
            room = sizes[at]
            first, n = gaps[room].pop()
            if not gaps[room]:
                del gaps[room]
                sizes.pop(at)
            take = min(n, left)
            free(room, first + take, n - take)
            steps.append((length, rank, take, first, 1, capacity - room))
            free(room - length, first, take)
            rank, left = rank + take, left - take
    return pd.DataFrame(steps, columns=["length", "first_rank", "n", "sequence", "stack", "offset"], dtype="int64")


def pack(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; ``table`` has id, piece and length and is read twice."""
    spark = table.sparkSession
    salted = table.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "start"), F.lit(SALTS)).cast("int"))
    groups = salted.groupBy("length", "salt").count()  # at most capacity * SALTS rows
    found = groups.toPandas().sort_values(["length", "salt"], kind="stable")
    found["before"] = found.groupby("length")["count"].cumsum() - found["count"]
    counts = {int(k): int(v) for k, v in found.groupby("length")["count"].sum().items()}
    steps = plan(counts, capacity)
    before = spark.createDataFrame(found[["length", "salt", "before"]], "length long, salt int, before long")
    places = spark.createDataFrame(steps, "length long, first_rank long, n long, sequence long, stack long, offset long")
    own = Window.partitionBy("length", "salt").orderBy("id", "piece")
    ranked = salted.withColumn("own_rank", F.row_number().over(own) - 1).join(F.broadcast(before), ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own_rank"))
    ranked = ranked.drop("salt", "before", "own_rank")
    placed = ranked.join(F.broadcast(places.withColumnRenamed("length", "step_length")),
                         (F.col("length") == F.col("step_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n")))
    at = F.col("rank") - F.col("first_rank")
    return placed.select(*table.columns, (F.col("sequence") + F.floor(at / F.col("stack"))).cast("long").alias("sequence_id"),
                         (F.col("offset") + F.pmod(at, F.col("stack")) * F.col("length")).cast("long").alias("offset"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    table = saved(pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "pieces")
    return pack(table).withColumnRenamed("id", "doc_id")
