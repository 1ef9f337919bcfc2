"""Language identification by interpolated Kneser-Ney character models (operator 2).

Text is lower-cased; every run of characters other than letters is one blank; a row starts
with ``ORDER - 1`` blanks. ``train`` counts the ``ORDER``-grams of every learning row in one pass
(per task and language, then one small shuffle). Lower orders are Kneser-Ney continuation
counts of those types; discounts and counts of two characters and less are made in Spark from
all of them. No gram is dropped, so the model grows with the corpus. It is held as sorted arrays of
64-bit hashes beside their discounted probabilities or back-off weights, in parts of about
``PART`` grams by their two middle characters: all that a gram's probability needs of orders 4
and 3 lies in one part. The driver makes one part at a time, and a task holds one at a time, next
to orders 2 and 1, which every task holds whole.

A row gets the language of the lowest cross-entropy per character (ties: the first name).
``score`` is the posterior against the other languages, as if at most ``EVIDENCE`` characters
were seen. Rejected are rows without a letter (``und``, score 0) and rows of which the
cross-entropy lies beyond the language's limit, calibrated on its learning rows: the median
plus ``SLACK`` times the distance from the median to the ``TAIL`` quantile, ``LEAST`` bits at
least (few learning rows tell little about the tail).

Defined results: null, empty or letterless text is ``und``; with nothing to learn from every
row is ``und``; null labels are not learned from; equal texts get equal results; very long
texts are read whole, in slices of rows; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ._io import kept_out, read, saved
from ._words import mix

ORDER = 4
PART, BUCKETS = 1 << 21, 4093
EVIDENCE = 40
TAIL, SLACK, LEAST = 0.999, 3.0, 1.5
SLICE_CHARS = 2 << 20


def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x10000)])


def _codes(texts: list[str], letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(character codes of 16 bits, row offsets): letters as they are, other runs as one 0."""
    texts = [" " * (ORDER - 1) + t.lower() + " " for t in texts]
    size = np.array([len(t) for t in texts], dtype=np.int64)
    c = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), "<u4")
    high = c >= 0x10000
    is_letter = letter[np.where(high, 0, c)]
    if high.any():  # beyond 16 bits: letters share the codes of the unused surrogates
        kinds, at = np.unique(c[high], return_inverse=True)
        is_letter[high] = np.array([chr(k).isalpha() for k in kinds])[at]
        c = np.where(high, 0xD800 + c % 0x800, c)
    begins = np.zeros(len(c), bool)
    for k in range(ORDER - 1):
        begins[np.cumsum(size) - size + k] = True
    keep = is_letter | begins
    keep[1:] |= is_letter[:-1]
    off = np.concatenate([[0], np.cumsum(np.add.reduceat(keep, np.cumsum(size) - size, dtype=np.int64))])
    return np.where(is_letter, c, 0)[keep].astype(np.uint64), off


def _grams(texts: list[str], letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ORDER-grams packed in 64 bits, row offsets)."""
    c, off = _codes(texts, letter)
    g = c[ORDER - 1:].copy()
    for k in range(1, ORDER):
        g |= c[ORDER - 1 - k:len(c) - k] << np.uint64(16 * k)
    starts = np.zeros(len(c), bool)
    for k in range(ORDER - 1):
        starts[off[:-1] + k] = True
    return g[~starts[ORDER - 1:]], off - np.arange(len(off)) * (ORDER - 1)


def _sliced(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE_CHARS:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[new], np.add.reduceat(n, new)


def count_grams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n) over every row with a text and a label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter, found = _letters(), {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            texts = batch.column(0).to_pylist()
            for name in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs) if x == name]
                for a, b in _sliced(own):
                    g = np.sort(_grams(own[a:b], letter)[0])
                    if len(g):
                        new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
                        found.setdefault(name, []).append((g[new], np.diff(np.append(new, len(g)))))
                        if len(found[name]) > 8:
                            found[name] = [_counted(found[name])]
        for name, parts in found.items():
            keys, n = _counted(parts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    return rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


Tables = list[list[tuple[np.ndarray, np.ndarray]]]


@dataclass
class Model:
    """Per language and order: sorted hashes of grams with their discounted probability, and
    sorted hashes of contexts with their back-off weight. ``low`` has orders 1 and 2, ``parts``
    orders 3 and 4, each as (grams, contexts); ``of`` is the part of each bucket of middles."""

    langs: list[str]
    low: Broadcast
    parts: list[Broadcast]
    of: np.ndarray

    def log_probs(self, g: np.ndarray) -> np.ndarray:
        """log2 P(last character | the others) of packed grams, a column per language."""
        out = np.empty((len(g), len(self.langs)), np.float32)
        part = self.of[_bucket(g)]
        for k, held in enumerate(self.parts):
            mine = np.flatnonzero(part == k) if len(self.parts) > 1 else slice(None)
            own = g[mine]
            if len(own):
                # a single part stays in the worker, of several each is read when it's needed
                high = held.value if len(self.parts) == 1 or held._path is None else held.load_from_path(held._path)
                out[mine] = self._of_part(own, high)
        return out

    def _of_part(self, g: np.ndarray, high: tuple[Tables, Tables]) -> np.ndarray:
        out = np.empty((len(g), len(self.langs)), np.float32)
        for j in range(len(self.langs)):
            p = np.full(len(g), 2.0 ** -16)
            for n in range(1, ORDER + 1):
                grams, contexts = (x[j][(n - 1) % 2] for x in (self.low.value if n <= 2 else high))
                gram = _last(g, n)
                p = _lookup(grams, _hashed(gram), 0.0) + _lookup(contexts, _hashed(gram >> np.uint64(16)), 1.0) * p
            out[:, j] = np.log2(p)
        return out


def _bucket(g: np.ndarray) -> np.ndarray:
    return ((g >> np.uint64(16) & np.uint64(0xFFFFFFFF)) % np.uint64(BUCKETS)).astype(np.int64)


def _bucket_column(gram: Column) -> Column:
    return F.shiftrightunsigned(gram, 16).bitwiseAND(F.lit(0xFFFFFFFF)) % BUCKETS


def _last(g: np.ndarray, n: int) -> np.ndarray:
    return g if n == 4 else g & np.uint64((1 << (16 * n)) - 1)


def _hashed(g: np.ndarray) -> np.ndarray:
    return mix((g + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _lookup(table: tuple[np.ndarray, np.ndarray], key: np.ndarray, default: float) -> np.ndarray:
    keys, values = table
    if not len(keys):
        return np.full(len(key), default)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return np.where(keys[at] == key, values[at], default)


def _hash_array(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = _hashed(keys)
    order = np.argsort(h)
    return h[order], values[order].astype(np.float32)


def _discounted(keys: np.ndarray, count: np.ndarray, d: float) -> tuple[tuple, tuple]:
    """Discounted probabilities of one order's sorted grams, and back-off weights of their contexts."""
    if not len(keys):
        return (_hash_array(keys, count),) * 2
    ctx = keys >> np.uint64(16)  # keys are sorted, so contexts are, too
    new = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
    total = np.add.reduceat(count, new)
    types = np.diff(np.append(new, len(keys)))
    of = np.repeat(np.arange(len(new)), types)
    return _hash_array(keys, (count - d) / total[of]), _hash_array(ctx[new], d * types / total)


def _by_language(counts: DataFrame, langs: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sorted grams, counts) of each language, collected."""
    rows = counts.select("lang", "gram", "n").toArrow()
    for name in langs:
        own = rows.filter(pa.compute.equal(rows.column("lang"), name))
        g, n = own.column("gram").to_numpy().view(np.uint64), own.column("n").to_numpy().astype(float)
        order = np.argsort(g)
        yield g[order], n[order]


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Model of every label of ``docs``, of all their grams; a part at a time is collected."""
    spark = docs.sparkSession
    counts = saved(count_grams(docs, text, lang), "lid-grams")
    orders = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):  # continuation counts: how many characters stand before each shorter gram
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 16 * n) - 1))
        orders[n] = saved(orders[n + 1].groupBy("lang", shorter.alias("gram")).agg(F.count("*").alias("n")), "lid-shorter")
    discount = {}
    for n, table in orders.items():
        for r in table.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).collect():
            discount[n, r["lang"]] = r["n1"] / (r["n1"] + 2 * r["n2"]) if r["n1"] and r["n2"] else 0.5
    langs = sorted({name for _, name in discount})

    def tables(by_order: list[tuple[int, list]]) -> tuple[Tables, Tables]:
        made = [[_discounted(*of[j], discount[n, name]) for n, of in by_order] for j, name in enumerate(langs)]
        return [[x[0] for x in m] for m in made], [[x[1] for x in m] for m in made]

    low = spark.sparkContext.broadcast(tables([(n, list(_by_language(orders[n], langs))) for n in (1, 2)]))
    size = np.zeros(BUCKETS, np.int64)
    for r in counts.groupBy(_bucket_column(F.col("gram")).alias("b")).count().collect():
        size[r["b"]] = r["count"]
    of, parts, at = np.zeros(BUCKETS, np.int64), [], 0
    while at < BUCKETS:
        to = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), PART, side="right")) + at)
        of[at:to] = len(parts)
        rows = counts.where(_bucket_column(F.col("gram")).between(at, to - 1)) if to - at < BUCKETS else counts
        top = list(_by_language(rows, langs))
        # the characters before a shorter gram are all in its part
        third = [tuple(x.astype(t) for x, t in zip(np.unique(_last(g, 3), return_counts=True), (np.uint64, float))) for g, _ in top]
        parts.append(spark.sparkContext.broadcast(tables([(3, third), (4, top)])))
        at = to
    return Model(langs, low, parts, of)


_SCORED = StructType([StructField("pred", StringType()), StructField("score", DoubleType()), StructField("xent", DoubleType())])


def _scorer(model: Model):
    @F.pandas_udf(_SCORED)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letter = _letters()
        for texts in batches:
            texts = [t or "" for t in texts]
            entropy = np.full((len(texts), len(model.langs)), np.inf)
            size = np.zeros(len(texts), np.int64)
            for a, b in _sliced(texts):
                g, off = _grams(texts[a:b], letter)
                size[a:b] = np.diff(off)
                u = np.sort(g)
                u = u[np.concatenate([[True], u[1:] != u[:-1]])] if len(u) else u
                logs = model.log_probs(u)
                at = _places(u, g)
                for j in range(len(model.langs)):
                    run = np.concatenate([[0.0], np.cumsum(logs[at, j], dtype=np.float64)])
                    entropy[a:b, j] = -(run[off[1:]] - run[off[:-1]]) / np.maximum(size[a:b], 1)
            best = entropy.argmin(axis=1) if model.langs else np.zeros(len(texts), int)
            low = entropy[np.arange(len(texts)), best] if model.langs else np.zeros(len(texts))
            with np.errstate(over="ignore", invalid="ignore"):
                odds = np.exp2(-np.clip((entropy - low[:, None]) * np.minimum(size, EVIDENCE)[:, None], 0, 1000)).sum(axis=1)
            yield pd.DataFrame({"pred": [model.langs[k] if model.langs else "und" for k in best], "score": 1 / np.maximum(odds, 1.0) if model.langs else 0.0, "xent": low})

    return score


def _places(u: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Index in the sorted ``u`` of each entry of ``g``, by a direct table and, where two
    entries share a slot, by search."""
    bits = 21
    slot = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
    table = np.zeros(1 << bits, np.int32)
    table[slot(u)] = np.arange(len(u), dtype=np.int32)
    at = table[slot(g)]
    if len(u):
        other = np.flatnonzero(u[at] != g)
        at[other] = np.searchsorted(u, g[other])
    return at


def identify(docs: DataFrame, model: Model, text: str = "text", prefix: str = "lid_") -> DataFrame:
    """``docs`` with ``<prefix>pred``, ``<prefix>score`` and ``<prefix>xent`` (bits a character)."""
    letters = F.col(text).isNotNull() & F.col(text).rlike(r"\p{L}")
    out = docs.withColumn(prefix + "made", _scorer(model)(F.col(text)))
    made = F.col(prefix + "made")
    return out.withColumns({
        prefix + "pred": F.when(letters, made["pred"]).otherwise("und"),
        prefix + "score": F.when(letters, made["score"]).otherwise(0.0),
        prefix + "xent": F.when(letters, made["xent"])}).drop(prefix + "made")


def rejection_limits(scored: DataFrame, prefix: str = "lid_") -> DataFrame:
    """(pred, limit): a row a language, from rows it was rightly given to while learning."""
    q = F.percentile_approx(prefix + "xent", F.array(F.lit(0.5), F.lit(TAIL)), 10_000)
    return scored.groupBy(F.col(prefix + "pred").alias("pred")).agg(q.alias("q")).select(
        "pred", (F.col("q")[0] + F.greatest(F.lit(LEAST), SLACK * (F.col("q")[1] - F.col("q")[0]))).alias("limit"))


def classified(docs: DataFrame, keep: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """Train on the learning rows of ``docs``, score all rows and calibrate the rejection.

    Returns the columns ``keep`` with held_out, lang_pred, score, xent and rejected.
    """
    names = [f"lid_keep_{i}" for i in range(len(keep))]
    wide = docs.select(F.col(text).alias("lid_text"), F.col(lang).alias("lid_true"), kept_out("doc_id", 5, 0).alias("lid_out"),
                       *[F.col(c).alias(n) for c, n in zip(keep, names)])
    model = train(wide.where(~F.col("lid_out")), "lid_text", "lid_true")
    scored = saved(identify(wide, model, "lid_text").drop("lid_text"), "lid-scored")
    # a row a learned language
    limits = rejection_limits(scored.where(~F.col("lid_out") & (F.col("lid_true") == F.col("lid_pred"))))
    rejected = (F.col("lid_pred") == "und") | F.coalesce(F.col("lid_xent") > F.col("limit"), F.lit(False))
    return scored.join(F.broadcast(limits), scored["lid_pred"] == limits["pred"], "left").select(
        *[F.col(n).alias(c) for c, n in zip(keep, names)], F.col("lid_out").alias("held_out"), F.col("lid_pred").alias("lang_pred"),
        F.col("lid_score").alias("score"), F.col("lid_xent").alias("xent"), rejected.alias("rejected"))


def accepted(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are not rejected."""
    names = docs.columns
    out = classified(docs, names, text, lang)  # the columns kept come first
    return out.toDF(*[f"c{i}" for i in range(len(out.columns))]).where(f"not c{len(out.columns) - 1}").select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ["doc_id"])
