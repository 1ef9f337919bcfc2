"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 6).

``statistics`` computes ``FEATURES`` of every whole text in one pass; they are written once and
serve learning and scoring. ``fit`` grows ``TREES`` trees of depth ``DEPTH`` on feature histograms
of at most ``BINS`` bins, from at most ``SAMPLE`` labelled rows (those of the smallest id hash; a
documented bound for fitting only). The trees are complete and flattened into arrays, so
scoring is ``DEPTH`` array look-ups for all trees and rows at once.

Defined results: null text counts as empty and gets the score of an empty text; equal texts get
equal scores; without any labelled row, or with one class only, the score is the share of
class 1 (0.5 without rows); very long texts are read whole; null labels are not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ._io import kept_out, read, saved
from ._words import SPACE, Words, mix, separator_table, slices, text_bytes, window_hash

SAMPLE, BINS, TREES, DEPTH, RATE, MIN_ROWS, L2 = 50_000, 64, 120, 4, 0.1, 20, 1.0
#: Labels joined per row of the sample; those kept out or without a document take their share.
SPARE = 1.5

FEATURES = ("log_bytes", "log_words", "log_lines", "word_len", "word_len_sd", "longest_word", "upper", "digit", "punct",
            "symbol", "pipe", "bang", "space", "non_ascii", "distinct_words", "top_word", "twice_in_a_row",
            "short_words", "capital_words", "caps_words", "ends_sentence", "symbol_words", "distinct_triples", "distinct_lines")

_UPPER = separator_table((65, 90))
_LOWER = separator_table((97, 122))
_DIGIT = separator_table((48, 57))
_PUNCT = separator_table((33, 33), (39, 41), (44, 46), (58, 59), (63, 63))
_SYMBOL = separator_table((35, 38), (42, 43), (47, 47), (60, 62), (64, 64), (91, 96), (123, 126))
_END = separator_table((33, 33), (46, 46), (63, 63))
_LINE = separator_table((10, 10))


def _distinct(row: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, largest count of a key) of each of ``n`` rows."""
    k = np.sort(mix(key + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24) | row.astype(np.uint64) << np.uint64(40))
    new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)
    count, of = np.diff(np.append(new, len(k))), (k[new] >> np.uint64(40)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, of, count)
    return np.bincount(of, minlength=n).astype(float), most


def features(column: pa.Array) -> np.ndarray:
    """(rows, FEATURES) of a column slice of fewer than 2**24 rows."""
    w, line = Words(column, SPACE), Words(column, _LINE)
    data, off = text_bytes(column)
    n, size, words = len(column), np.diff(off).astype(float), np.diff(w.first).astype(float)
    run = lambda m: np.concatenate([[0], np.cumsum(m)])
    share = lambda mask: np.diff(run(mask)[off]) / np.maximum(size, 1)
    by_word = lambda m: np.diff(run(m)[w.first])
    length = (w.ends - w.starts).astype(float)
    mean = by_word(length) / np.maximum(words, 1)
    longest = np.zeros(n)
    np.maximum.at(longest, w.row, length)
    upper = run(_UPPER[data])
    letters = run(_UPPER[data] | _LOWER[data])
    symbol = run(_SYMBOL[data])
    own_upper, own_letters = upper[w.ends] - upper[w.starts], letters[w.ends] - letters[w.starts]
    distinct, top = _distinct(w.row, w.hash, n)
    again = np.zeros(len(length), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    at = w.whole(3)
    triples = _distinct(w.row[at], window_hash(w.hash, 3)[at], n)[0]
    lines = np.diff(line.first).astype(float)
    some = lambda x, of: x / np.maximum(of, 1)
    return np.column_stack([
        np.log1p(size), np.log1p(words), np.log1p(lines), mean, np.sqrt(np.maximum(0, some(by_word(length**2), words) - mean**2)), np.log1p(longest),
        some(np.diff(upper[off]), np.diff(letters[off])), share(_DIGIT[data]), share(_PUNCT[data]), share(_SYMBOL[data]), share(data == 124), share(data == 33),
        share(SPACE[data]), share(data >= 128), some(distinct, words), some(top, words), some(by_word(again), words), some(by_word(length <= 3), words),
        some(by_word(_UPPER[data[w.starts]]), words), some(by_word((own_upper == own_letters) & (own_letters > 1)), words),
        some(by_word(_END[data[w.ends - 1]]), words), some(by_word(symbol[w.ends] > symbol[w.starts]), words),
        some(triples, np.maximum(words - 2, 0)), some(_distinct(line.row, line.hash, n)[0], lines)]).astype(np.float32)


def statistics(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, x array<float>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = features(part.column(1))
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), values], ["id", "x"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, x array<float>")


def fit(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray | float]:
    """Flattened trees: ``feature`` and ``split`` (trees, inner nodes), ``value`` (trees, leaves), ``base``."""
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    none = {"feature": np.zeros((0, inner), np.int32), "split": np.zeros((0, inner), np.float32), "value": np.zeros((0, leaves)), "base": float(np.log(share / (1 - share)))}
    if len(y) == 0 or y.min() == y.max():
        return none
    edges = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS, method="lower")) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)])  # bin <= k iff value <= edge k
    f = np.full(len(y), none["base"])
    feature, split, value = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        tree_feature, tree_split = np.zeros(inner, np.int32), np.full(inner, np.inf, np.float32)
        for depth in range(DEPTH):
            first, n = (1 << depth) - 1, 1 << depth
            local = node - first
            best = np.full(n, 1e-9)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                key = local * BINS + binned[:, j]
                hist = [np.bincount(key, v, n * BINS).reshape(n, BINS).cumsum(axis=1) for v in (g, h, None)]
                (gl, hl, cl), (gt, ht, ct) = hist, [v[:, -1:] for v in hist]
                gain = gl**2 / (hl + L2) + (gt - gl)**2 / (ht - hl + L2) - gt**2 / (ht + L2)
                gain[(cl < MIN_ROWS) | (ct - cl < MIN_ROWS)] = 0
                gain = gain[:, :len(e)]
                k = gain.argmax(axis=1)
                better = np.flatnonzero(gain[np.arange(n), k] > best)
                best[better] = gain[better, k[better]]
                tree_feature[first + better], tree_split[first + better] = j, e[k[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), tree_feature[node]] > tree_split[node])
        leaf = node - inner
        gain = -np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + L2) * RATE
        f += gain[leaf]
        feature.append(tree_feature)
        split.append(tree_split)
        value.append(gain)
    return {"feature": np.array(feature), "split": np.array(split), "value": np.array(value), "base": none["base"]}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Probability of class 1: every tree's node index moves down one level at a time."""
    out = np.full(len(x), model["base"])
    trees = np.arange(len(model["feature"]))
    for a in range(0, len(x) if len(trees) else 0, 4096):
        part = x[a:a + 4096]
        node = np.zeros((len(part), len(trees)), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (np.take_along_axis(part, model["feature"][trees, node], axis=1) > model["split"][trees, node])
        out[a:a + 4096] += model["value"][trees, node - ((1 << DEPTH) - 1)].sum(axis=1)
    return 1 / (1 + np.exp(-out))


def sample(stats: DataFrame, labels: DataFrame, label: str) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``SAMPLE`` labelled rows, by the smallest id hashes.

    Labels are counted first, and only hashes below a limit that leaves about ``SPARE`` times the sample are joined
    and ordered, so a task never sends a sample of its own. If too few have a row, the limit is raised.
    """
    wanted = labels.where(F.col(label).isNotNull()).withColumn("label_id", F.col("label_id").cast(stats.schema["id"].dataType))
    share = SPARE * SAMPLE / max(1, wanted.count())
    while True:
        some = wanted.where(F.xxhash64("label_id") < int(share * 2**64) - 2**63) if share < 1 else wanted
        rows = stats.join(some, stats["id"] == some["label_id"])
        got = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("x", label).toArrow()
        if got.num_rows == SAMPLE or share >= 1:
            break
        share *= 4
    x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False) if got.num_rows else np.zeros(0)
    return x.reshape(-1, len(FEATURES)).astype(np.float32), got.column(label).to_numpy().astype(float)


def score(stats: DataFrame, model: dict, into: str = "score") -> DataFrame:
    """``stats`` with the probability of class 1."""

    @F.pandas_udf(DoubleType())
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(predict(model, np.stack(x.to_numpy()).astype(np.float32)) if len(x) else [])

    return stats.withColumn(into, run("x"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_id"), F.col("quality").alias("label"))
    stats = saved(statistics(docs), "quality-statistics")
    model = fit(*sample(stats.where(~kept_out("id", 5, 0)), labels, "label"))
    return score(stats, model).select(F.col("id").alias("doc_id"), kept_out("id", 5, 0).alias("held_out"), "score",
                                      (F.col("score") >= 0.3).cast("int").alias("predicted"))
