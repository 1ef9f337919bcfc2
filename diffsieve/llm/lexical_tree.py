"""Ranked lexical search over document FP-trees (operator 13).

Items (queries) are worked off in blocks of about ``BLOCK_TERMS`` distinct (item, term) pairs, so that
a block's vocabulary can be sent to every task.

1. One pass restricts every text to the block's terms: (id, n, terms, tf), stored as a table. Words
   are looked up by hash and compared byte by byte. N, L and df are counted over that table.
2. Every task builds FP-trees of its rows, each of at most ``TREE_DOCS`` texts and about
   ``TREE_POSTINGS`` entries: a text's terms of positive weight, most frequent first, are its path,
   and equal beginnings share nodes. Texts in path order make a node a range of texts. For the
   topmost nodes of at most ``SIZES`` texts the tree keeps each term's largest tf in the subtree and
   the subtree's smallest m.
3. For each item a depth-first search starts at the root, best child first. A node's bound is
   the item's score with the subtree's largest tf and smallest m; the score grows with tf and
   falls with m, so no text below is better. Nodes below the k-th best score so far (of this and the
   task's earlier trees) are left; equal bounds are followed, as the smaller id wins ties.
4. Every task sends its k best texts an item; Spark ranks them, first within buckets of ids.

Scores are whole numbers; only a term's weight is floor(1000 * ln) in doubles.

Defined results: null and empty texts have no terms and are never found; items without terms, or of
which no term has a positive weight, give no row; rows that share an item id are one item with the
terms of all (null ids are one item); repeated texts are ranked each (equal id and score: any
order), null ids before others; empty tables give no row. Only ids and texts are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._io import read, saved
from ._words import NON_ALNUM, Words, slices

TOP = 50
BLOCK_TERMS = 1 << 19
TREE_DOCS, TREE_POSTINGS = 1 << 16, 2_000_000
SIZES = (256, 2048, 16384)
BUCKETS = 64
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term): the distinct terms of every item."""
    found = F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), F.lit(_TERM), 0)
    return items.select(F.col(item_id).alias("item"), F.explode(found).alias("term")).distinct()


class Vocabulary:
    """Terms by number; ``find`` gives the number of each word of a slice, -1 for others."""

    def __init__(self, terms: pa.Array):
        self.words = Words(terms, NON_ALNUM)
        self.order = np.argsort(self.words.hash)
        self.hash = self.words.hash[self.order]
        self.near = np.zeros(1 << 20, bool)
        self.near[(self.hash >> np.uint64(44)).astype(np.int64)] = True

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word indexes, term numbers) of the words that are terms."""
        none = np.zeros(0, np.int64)
        if not len(self.hash) or not len(w.hash):
            return none, none
        at = np.flatnonzero(self.near[(w.hash >> np.uint64(44)).astype(np.int64)])
        left = np.searchsorted(self.hash, w.hash[at])
        found, number = [], []
        while len(at):  # terms of one hash stand side by side
            ok = left < len(self.hash)
            at, left = at[ok], left[ok]
            ok = self.hash[left] == w.hash[at]
            at, left = at[ok], left[ok]
            same = self._same(w, at, self.order[left])
            found.append(at[same])
            number.append(self.order[left[same]])
            at, left = at[~same], left[~same] + 1
        return (np.concatenate(found), np.concatenate(number)) if found else (none, none)

    def _same(self, w: Words, at: np.ndarray, term: np.ndarray) -> np.ndarray:
        v = self.words
        size = w.ends[at] - w.starts[at]
        same = size == v.ends[term] - v.starts[term]
        eight = [np.ndarray((len(x.data) + 1,), "<u8", np.concatenate([x.data, np.zeros(8, np.uint8)]), strides=(1,)) for x in (w, v)]
        live, k = np.flatnonzero(same), 0
        while len(live):
            rest = np.minimum(size[live] - k, 8).astype(np.uint64)
            bits = np.uint64(64) - rest * np.uint64(8)
            ok = (eight[0][w.starts[at[live]] + k] << bits) == (eight[1][v.starts[term[live]] + k] << bits)
            same[live[~ok]] = False
            k += 8
            live = live[ok]
            live = live[size[live] > k]
        return same


def vectors(docs: DataFrame, vocabulary) -> DataFrame:
    """(id, n, terms, tf): each text's number of words, and the vocabulary's terms in it."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Vocabulary(vocabulary.value)
        many = max(1, len(terms.hash))
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column(1), NON_ALNUM, lower=True)
                at, number = terms.find(w)
                key, tf = np.unique(w.row[at] * np.int64(many) + number, return_counts=True)
                off = pa.array(np.searchsorted(key, np.arange(part.num_rows + 1) * np.int64(many)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(np.diff(w.first).astype(np.int64)),
                    pa.ListArray.from_arrays(off, pa.array((key % many).astype(np.int32))), pa.ListArray.from_arrays(off, pa.array(tf.astype(np.int32)))],
                    ["id", "n", "terms", "tf"])

    return docs.mapInArrow(run, f"id {kind}, n long, terms array<int>, tf array<int>")


def spans(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [lo, hi), one after the other."""
    size = hi - lo
    return np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)


class Level:
    """Nodes of one size class: by term and node the largest tf, by node the smallest m and the children."""

    def __init__(self, nodes: int, term: np.ndarray, node: np.ndarray, tf: np.ndarray, m: np.ndarray, child: np.ndarray | None):
        self.nodes, self.key, self.tf, self.m, self.child = nodes, term * np.int64(nodes) + node, tf, m, child

    def bounds(self, terms: np.ndarray, weight: np.ndarray, a: int, b: int) -> np.ndarray:
        """Upper bounds of the scores below the nodes [a, b); for texts the scores."""
        base = terms * np.int64(self.nodes)
        lo, hi = np.searchsorted(self.key, base + a), np.searchsorted(self.key, base + b)
        at = spans(lo, hi)
        size = hi - lo
        node = self.key[at] - np.repeat(base, size)
        tf = self.tf[at].astype(np.int64)
        part = np.repeat(weight, size) * (1_000_000_000 * tf // (1000 * tf + 20 * self.m[node]))
        out = np.zeros(b - a, np.int64)
        np.add.at(out, node - a, part)
        return out


class Tree:
    """An FP-tree of restricted vectors.

    place: each text's terms as positions in the frequency order, ascending; off: where each text's
    begin; tf: their counts; m: each text's length factor; rank: the order of the texts' ids.
    """

    def __init__(self, off: np.ndarray, place: np.ndarray, tf: np.ndarray, m: np.ndarray, rank: np.ndarray):
        n = len(m)
        raw = place.astype(">u4").tobytes()
        path = [raw[4 * a:4 * b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
        self.order = np.array(sorted(np.argsort(rank).tolist(), key=path.__getitem__), np.int64)
        size = np.diff(off)[self.order]
        begin = off[:-1][self.order]
        shared = self._shared(begin, size, place)
        whole = self._node_sizes(shared)
        self.rank, m = rank[self.order], m[self.order]
        text = np.repeat(np.arange(n), size)
        at = spans(begin, begin + size)
        by = np.lexsort((text, place[at]))
        term, node, tf = place[at][by].astype(np.int64), text[by], tf[at][by]
        self.levels = [Level(n, term, node, tf, m, None)]
        first = np.arange(n)  # the first text of each node of the level below
        for most in (*SIZES, n):
            cut = np.ones(n, bool)
            cut[1:] = whole > most
            head = np.flatnonzero(cut)
            child = np.r_[np.searchsorted(first, head), len(first)]  # children of each node
            up = np.repeat(np.arange(len(head)), np.diff(child))
            node = up[node]
            new = np.ones(len(node), bool)
            new[1:] = (node[1:] != node[:-1]) | (term[1:] != term[:-1])
            runs = np.flatnonzero(new)
            tf = np.maximum.reduceat(tf, runs) if len(runs) else tf
            term, node = term[runs], node[runs]
            m = np.minimum.reduceat(m, child[:-1])
            self.levels.append(Level(len(head), term, node, tf, m, child))
            first = head

    @staticmethod
    def _shared(begin: np.ndarray, size: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Length of the path that each text shares with the one before; equal paths count as endless."""
        n = len(size)
        out = np.zeros(max(0, n - 1), np.int64)
        live, k = np.arange(len(out)), 0
        while len(live):
            live = live[np.minimum(size[live], size[live + 1]) > k]
            live = live[place[begin[live] + k] == place[begin[live + 1] + k]]
            out[live] = k = k + 1
        out[(out == size[:-1]) & (size[:-1] == size[1:])] = 1 << 40
        return out

    @staticmethod
    def _node_sizes(shared: np.ndarray) -> np.ndarray:
        """Texts below the lowest node that holds each text and the one before it."""
        values, n = shared.tolist(), len(shared)
        left, right, stack = [0] * n, [n] * n, []
        for i, v in enumerate(values):
            while stack and values[stack[-1]] > v:
                right[stack.pop()] = i
            if stack and values[stack[-1]] == v:
                left[i] = left[stack[-1]]
            else:
                left[i] = stack[-1] + 1 if stack else 0
            stack.append(i)
        return np.array(right, np.int64) - np.array(left, np.int64) + 1

    def search(self, terms: np.ndarray, weight: np.ndarray, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts, scores) of the k best, at most; those below the k-th of ``known`` scores are left out."""
        texts, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        top = len(self.levels) - 1
        least = self._least(known, best, k)
        stack = [(int(b), top, i) for i, b in enumerate(self.levels[top].bounds(terms, weight, 0, self.levels[top].nodes))]
        stack.sort()
        while stack:
            bound, level, node = stack.pop()
            if bound < least:
                continue
            a, b = self.levels[level].child[node:node + 2]
            bounds = self.levels[level - 1].bounds(terms, weight, a, b)
            good = np.flatnonzero(bounds >= least)
            if level > 1:
                good = good[np.argsort(bounds[good], kind="stable")]
                stack.extend((int(bounds[i]), level - 1, int(a + i)) for i in good)
                continue
            texts, best = np.r_[texts, good + a], np.r_[best, bounds[good]]
            order = np.lexsort((self.rank[texts], -best))[:k]
            texts, best = texts[order], best[order]
            least = self._least(known, best, k)
        return self.order[texts], best

    @staticmethod
    def _least(known: np.ndarray, best: np.ndarray, k: int) -> int:
        both = np.r_[known, best]
        return max(1, int(np.partition(both, len(both) - k)[len(both) - k])) if len(both) >= k else 1


def _id_key(pair: tuple) -> tuple:
    score, key = pair
    return (-score, key is not None, key if key is not None else 0)


def best_of_tasks(rows: DataFrame, block, k: int) -> DataFrame:
    """(item, id, score): each task's k best texts of every item of the block, exactly."""
    kind, item_kind = rows.schema["id"].dataType.simpleString(), block.value["kind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        found: list[list] = [[] for _ in range(len(b["off"]) - 1)]

        def trees() -> Iterator[pa.Table]:
            held, postings, texts = [], 0, 0
            for batch in batches:
                step = max(1, min(batch.num_rows, 4096))
                for begin in range(0, batch.num_rows, step):
                    part = batch.slice(begin, step)
                    held.append(part)
                    postings += len(pc.list_flatten(part.column(2)))
                    texts += part.num_rows
                    if postings >= TREE_POSTINGS or texts + step > TREE_DOCS:
                        yield pa.Table.from_batches(held).combine_chunks()
                        held, postings, texts = [], 0, 0
            if held:
                yield pa.Table.from_batches(held).combine_chunks()

        for t in trees():
            ids = t.column(0).combine_chunks()
            terms, tf = (t.column(c).combine_chunks() for c in (2, 3))
            row = np.asarray(pc.list_parent_indices(terms), np.int64)
            place, tf = b["place"][np.asarray(pc.list_flatten(terms), np.int64)], np.asarray(pc.list_flatten(tf), np.int64)
            use = place >= 0
            order = np.lexsort((place[use], row[use]))
            row, place, tf = row[use][order], place[use][order], tf[use][order]
            m = 100 - 50 + (50 * t.column(1).to_numpy() * b["N"]) // b["L"]
            rank = np.empty(len(ids), np.int64)
            rank[np.asarray(pc.sort_indices(ids, null_placement="at_start"))] = np.arange(len(ids))
            tree = Tree(np.searchsorted(row, np.arange(len(ids) + 1)), place, tf, m, rank)
            for i, best in enumerate(found):
                own = slice(b["off"][i], b["off"][i + 1])
                texts, scores = tree.search(b["terms"][own], b["weight"][own], k, np.array([s for s, _ in best], np.int64))
                if len(texts):
                    best.extend(zip(scores.tolist(), ids.take(pa.array(texts)).to_pylist()))
                    best.sort(key=_id_key)
                    del best[k:]
        flat = [(i, s, key) for i, best in enumerate(found) for s, key in best]
        if flat:
            yield pa.RecordBatch.from_arrays([
                b["items"].take(pa.array([x[0] for x in flat])), pa.array([x[2] for x in flat], ids.type), pa.array([x[1] for x in flat], pa.int64())], ["item", "id", "score"])

    return rows.select("id", "n", "terms", "tf").where("n > 0").mapInArrow(run, f"item {item_kind}, id {kind}, score long")


def _block(spark: SparkSession, pairs: pa.Table, terms: pa.Array, df: dict, n_docs: int, n_words: int, kind: str):
    """A block of items as arrays: frequency order, and each item's terms with their weights."""
    weight = np.zeros(len(terms), np.int64)
    for t, d in df.items():
        weight[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1)))
    live = np.array(sorted((t for t in df if weight[t] > 0), key=lambda t: (-df[t], t)), np.int64)
    place = np.full(len(terms), -1, np.int64)
    place[live] = np.arange(len(live))
    coded = pairs.column("item").combine_chunks().dictionary_encode(null_encoding="encode")
    item, term = np.asarray(coded.indices, np.int64), np.asarray(pc.index_in(pairs.column("term"), value_set=terms), np.int64)
    use = place[term] >= 0
    item, term = item[use], term[use]
    order = np.lexsort((place[term], item))
    item, term = item[order], term[order]
    return spark.sparkContext.broadcast({
        "kind": kind, "N": n_docs, "L": n_words, "place": place, "items": coded.dictionary, "off": np.searchsorted(item, np.arange(len(coded.dictionary) + 1)),
        "terms": place[term], "weight": weight[term]})


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
           k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item, rank, id, score): the k best texts of every item."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    asked = saved(item_terms(items, item_id, item_text), "lexical-items")
    kind = asked.schema["item"].dataType.simpleString()
    blocks = max(1, -(-asked.count() // block_terms))
    parts = []
    for at in range(blocks):
        pairs = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == at).toArrow().combine_chunks()
        terms = pc.unique(pairs.column("term"))
        terms = terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms
        rows = saved(vectors(docs, spark.sparkContext.broadcast(terms)), "lexical-vectors")
        total = rows.where("n > 0").agg(F.count("*").alias("N"), F.sum("n").alias("L")).first()
        df = {r["t"]: r["df"] for r in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}
        block = _block(spark, pairs, terms, df, total["N"], total["L"] or 1, kind)
        parts.append(saved(best_of_tasks(rows, block, k), "lexical-best"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    order = (F.desc("score"), F.asc_nulls_first("id"))
    found = found.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "bucket").orderBy(*order))).where(F.col("rank") <= k)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return found.select("item", "rank", "id", "score")


def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best of all ``documents`` for every ``benchmark`` item."""
    out = search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")
