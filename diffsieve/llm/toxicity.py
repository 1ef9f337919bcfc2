"""Toxicity: subsequence string-kernel SVM with Nystroem landmarks (operator 1).

A text is split into sentences, sentences into words: the letters of each run without white
space, lower-cased, so ``i.d-i0o*t`` reads as ``idiot``; runs of single letters are joined.
Two words are compared by the gap-weighted subsequence kernel of ``P`` letters with decay
``DECAY``, normalised and raised to ``POWER``: inserted letters and gaps cost a factor, they don't hide
a word. The kernel of two sentences is the sum over their words; it is approximated on
``LANDMARKS`` landmark words (Nystroem). A linear SVM (squared hinge) is trained on sentences; a
sentence of a toxic text counts as toxic only while it is the most toxic of its text or scores
above the margin (three rounds). To tolerate insertions that no learning text shows, each telling landmark joins the toxic side
with a letter inserted or doubled, at weight ``VIRTUAL``. A text's score is that of its worst sentence, through a
logistic fitted on the learning texts.

A word's weight depends on the word only, so scoring needs each distinct word of a slice once.
Landmarks that share too few letters with a word are skipped by an exact bound (Cauchy-Schwarz on
the landmark's subsequences made of shared letters): similarities below ``FLOOR`` count as 0.

``fit`` takes at most ``TOXIC`` + ``CLEAN`` labelled texts, those of the smallest id hashes; this
bound is for learning only. Defined results: null and empty texts score as a text without
words; equal texts score alike; without both classes every score is the share of class 1
(0 without rows); words over ``UNIT`` letters are read in overlapping units; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ._io import kept_out, read, worker_cache
from ._words import mix

P, DECAY, POWER, FLOOR, ALIKE = 3, 0.7, 2, 0.55, 0.85
VIRTUAL, COST = 1.5, 2.0
LANDMARKS, COMMON, UNIT = 96, 16, 32
TOXIC, CLEAN = 1_200, 2_000
SLICE_CHARS = 4 << 20
KNOWN = 2 << 20
_SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0  　"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(is a letter, is white space) of the first 65536 characters; others are letters."""
    letter = np.array([chr(c).isalpha() for c in range(0x10000)])
    space = np.zeros(0x10000, bool)
    space[[ord(c) for c in _SPACES]] = True
    return letter, space


@dataclass
class Units:
    """Words of texts as letter codes: spans in ``code``, key, sentence and row of each."""

    code: np.ndarray
    start: np.ndarray
    size: np.ndarray
    key: np.ndarray
    sentence: np.ndarray
    row: np.ndarray

    def matrix(self, which: np.ndarray, width: int) -> np.ndarray:
        """(width, words) letters, 0 beyond a word's end."""
        at = np.arange(width)[:, None]
        return np.where(at < self.size[which], self.code[np.minimum(self.start[which] + at, len(self.code) - 1)], 0)


def units(texts: list[str], tables: tuple[np.ndarray, np.ndarray]) -> Units:
    letter, space = tables
    texts = [t.lower() + "\n" for t in texts]
    ends = np.cumsum([len(t) for t in texts])
    c = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), "<u4")
    small = np.minimum(c, 0xFFFF)
    is_letter, is_space = letter[small] | (c > 0xFFFF), space[small]
    before = np.concatenate([[True], is_space[:-1]])
    chunk = np.cumsum(~is_space & before) - 1  # of each character that isn't white space
    n = int(chunk[-1]) + 1 if len(c) else 0
    at = np.flatnonzero(is_letter)
    if not n or not len(at):
        e = np.zeros(0, np.int64)
        return Units(np.zeros(1, np.uint32), e, e, e.astype(np.uint64), e, e)
    first = np.flatnonzero(~is_space & before)
    last = np.flatnonzero(~is_space & np.concatenate([is_space[1:], [True]]))
    stop = np.isin(c[last], [ord(x) for x in ".!?"]) | (c[np.minimum(last + 1, len(c) - 1)] == 10)
    row_of_chunk = np.searchsorted(ends, first, side="right")
    stop[:-1] |= row_of_chunk[1:] != row_of_chunk[:-1]
    sentence_of_chunk = np.cumsum(np.concatenate([[0], stop[:-1]]))
    letters = np.bincount(chunk[at], minlength=n)
    live = np.flatnonzero(letters)  # chunks that have letters
    alone = letters[live] == 1
    joined = np.zeros(len(live), bool)
    joined[1:] = alone[1:] & alone[:-1] & (row_of_chunk[live][1:] == row_of_chunk[live][:-1])
    word_of_live = np.cumsum(~joined) - 1
    size = np.bincount(word_of_live, letters[live]).astype(np.int64)
    head = live[~joined]
    code, start = c[at], np.cumsum(size) - size
    sentence, row = sentence_of_chunk[head], row_of_chunk[head]
    long = np.flatnonzero(size > UNIT)
    if len(long):
        parts = [np.arange(0, max(1, s - UNIT // 2), UNIT // 2) for s in size[long]]
        of = np.repeat(long, [len(p) for p in parts])
        begin = np.concatenate(parts)
        rest = np.flatnonzero(size <= UNIT)
        order = np.argsort(np.concatenate([rest, of]), kind="stable")
        which = np.concatenate([rest, of])[order]
        shift = np.concatenate([np.zeros(len(rest), np.int64), begin])[order]
        start, size, sentence, row = start[which] + shift, np.minimum(size[which] - shift, UNIT), sentence[which], row[which]
    flat = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    key = np.add.reduceat(mix((code[flat].astype(np.uint64) << np.uint64(8) | place.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)), np.cumsum(size) - size)
    return Units(code, start, size, mix(key), sentence, row)


def subsequence_kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Gap-weighted kernel of the columns of ``s`` (length, n) with ``t`` (length, n or 1); 0 is padding."""
    same = ((s[:, None, :] == t[None, :, :]) & (s[:, None, :] != 0)) * np.float32(DECAY**2)
    k = np.ones_like(same)
    for level in range(P):
        d = same * k
        if level == P - 1:
            return d.sum(axis=(0, 1))
        for b in range(1, d.shape[1]):
            d[:, b] += DECAY * d[:, b - 1]
        for a in range(1, d.shape[0]):
            d[a] += DECAY * d[a - 1]
        k = np.zeros_like(d)
        k[1:, 1:] = d[:-1, :-1]


def _self_kernel(m: np.ndarray) -> np.ndarray:
    out = np.empty(m.shape[1], np.float32)
    for a in range(0, m.shape[1], 2048):
        out[a:a + 2048] = subsequence_kernel(m[:, a:a + 2048], m[:, a:a + 2048])
    return out


def _bit(code: np.ndarray) -> np.ndarray:
    return (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)


@dataclass
class Landmarks:
    """Landmark words with their self-kernels and, per set of shared letters, whether the
    similarity can reach ``FLOOR``."""

    words: list[str]
    codes: list[np.ndarray] = field(default_factory=list)
    norm: list[float] = field(default_factory=list)
    bits: list[np.ndarray] = field(default_factory=list)
    reach: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        for w in self.words:
            code = np.array([ord(x) for x in w], np.uint32)
            bits = np.unique(_bit(code))
            full = float(subsequence_kernel(code[:, None], code[:, None])[0])
            own = np.searchsorted(bits, _bit(code))
            part = np.where(np.arange(1 << len(bits)) >> own[:, None] & 1, code[:, None], 0)  # other letters match nothing
            table = np.sqrt(_self_kernel(part) / full) >= FLOOR
            self.codes.append(code)
            self.norm.append(full)
            self.bits.append(bits)
            self.reach.append(table)

    def pairs(self, u: Units, which: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(landmark, positions in ``which``, similarities of at least FLOOR to the power)."""
        size = u.size[which]
        flat = np.repeat(u.start[which] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        letters = np.bitwise_or.reduceat(np.uint64(1) << _bit(u.code[flat]), np.cumsum(size) - size) if len(which) else np.zeros(0, np.uint64)
        sets, of = np.unique(letters, return_inverse=True)
        own = np.full(len(which), np.nan, np.float32)
        by_size = [np.flatnonzero(size == n) for n in range(UNIT + 1)]
        for k, (code, bits) in enumerate(zip(self.codes, self.bits)):
            index = np.zeros(len(sets), np.int64)
            for j, b in enumerate(bits):
                index |= ((sets >> b) & np.uint64(1)).astype(np.int64) << j
            can = self.reach[k][index][of]
            for n in range(P, UNIT + 1):
                near = by_size[n][can[by_size[n]]]
                for a in range(0, len(near), 4096):
                    part = near[a:a + 4096]
                    m = u.matrix(which[part], n)
                    new = np.isnan(own[part])
                    if new.any():
                        own[part[new]] = _self_kernel(m[:, new])
                    value = subsequence_kernel(m, code[:, None]) / np.sqrt(own[part] * self.norm[k])
                    good = value >= FLOOR
                    if good.any():
                        yield k, part[good], value[good].astype(np.float64) ** POWER


@dataclass
class Model:
    landmarks: list[str]
    weight: np.ndarray  # of each landmark's similarity
    bias: float
    slope: float
    offset: float


def _texts(rows: pd.DataFrame) -> list[str]:
    return [t or "" for t in rows["text"]]


def _choose(u: Units, toxic: np.ndarray) -> tuple[list[str], int]:
    """Words that tell toxic texts best (presence per text), none ``ALIKE`` another, then the
    most frequent other words; the number of those."""
    keys, at, of = np.unique(u.key, return_index=True, return_inverse=True)
    seen = np.unique(of.astype(np.int64) * len(toxic) + u.row)
    word, is_toxic = seen // len(toxic), toxic[seen % len(toxic)]
    with_toxic, with_clean = (np.bincount(word[is_toxic == v], minlength=len(keys)) for v in (True, False))
    p1, p0 = (with_toxic + 0.5) / (toxic.sum() + 1), (with_clean + 0.5) / ((~toxic).sum() + 1)
    fit_size = (u.size[at] >= 4) & (u.size[at] <= 20)
    z = np.where(fit_size & (with_toxic >= 3) & (p1 > 5 * p0), with_toxic * np.log(p1 / p0), 0)
    word_of = lambda k: u.code[u.start[at[k]]:u.start[at[k]] + u.size[at[k]]]
    best, norms = [], []
    for k in np.argsort(-z, kind="stable")[:4 * LANDMARKS]:
        code = word_of(k)[:, None]
        norm = subsequence_kernel(code, code)[0]
        if z[k] > 0 and len(best) < LANDMARKS and all(subsequence_kernel(code, word_of(j)[:, None])[0] / np.sqrt(norm * n) < ALIKE for j, n in zip(best, norms)):
            best.append(k)
            norms.append(norm)
    frequent = np.where(fit_size & (z == 0), with_clean + with_toxic, 0)
    common = [k for k in np.argsort(-frequent, kind="stable")[:COMMON] if frequent[k]]
    return ["".join(map(chr, word_of(k))) for k in best + common], len(common)


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Linear SVM with squared hinge by Newton steps on the rows inside the margin; last is the bias."""
    c = COST
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1.0)
    ridge[-1] = 1e-3
    for _ in range(30):
        inside = y * (x @ w) < 1
        xi, s = x[inside], c * weight[inside]
        new = np.linalg.solve((xi * s[:, None]).T @ xi + np.diag(ridge), (xi * s[:, None]).T @ y[inside])
        if np.abs(new - w).max() < 1e-6:
            break
        w = 0.5 * w + 0.5 * new
    return w


def _logistic(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic with smoothed targets."""
    n1, n0 = y.sum(), (~y).sum()
    target = np.where(y, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack([f, np.ones(len(f))])
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag([1e-3, 1e-3])
        step = np.linalg.solve(h, x.T @ (p - target) + 1e-3 * w * [1, 0])
        w -= np.clip(step, -2, 2)
    return float(max(w[0], 1e-3)), float(w[1])


def _similar(marks: Landmarks, u: Units, at: np.ndarray | None = None) -> np.ndarray:
    """(words, landmarks) similarities."""
    at = np.arange(len(u.key)) if at is None else at
    similar = np.zeros((len(at), len(marks.words)), np.float32)
    for k, which, value in marks.pairs(u, at):
        similar[which, k] = value
    return similar


def _sentences(u: Units, of: np.ndarray, similar: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all sentences, places of those with a word like a landmark, row of each
    sentence, landmark sums of the placed ones)."""
    ids, start, inverse = np.unique(u.sentence, return_index=True, return_inverse=True)
    hit = np.flatnonzero(similar.any(axis=1)[of])
    place, at = np.unique(inverse[hit], return_inverse=True)
    sums = np.zeros((len(place), similar.shape[1]))
    np.add.at(sums, at, similar[of[hit]])
    return ids, place, u.row[start], sums


def all_units(texts: list[str], chars: int = 2 << 20) -> Units:
    """``units`` of many texts, cut by slices so that little is held per character."""
    tables, parts, a, size = _tables(), [], 0, 0
    base = np.zeros(3, np.int64)  # letters, sentences and rows so far
    for b in range(1, len(texts) + 1):
        size += len(texts[b - 1])
        if size >= chars or b == len(texts):
            u = units(texts[a:b], tables)
            parts.append((u.code, u.start + base[0], u.size, u.key, u.sentence + base[1], u.row + base[2]))
            base += [len(u.code), (u.sentence.max() + 1) if len(u.sentence) else 0, b - a]
            a, size = b, 0
    return Units(*[np.concatenate(x) for x in zip(*parts)]) if parts else units([], tables)


def _inserted(words: list[str]) -> Units:
    """Virtual toxic sentences: each telling word with a letter inserted or doubled."""
    texts = [v for w in words for k in (len(w) // 2, len(w) - 2) for v in (w[:k] + "x" + w[k:], w[:k] + w[k] + w[k:])]
    return units(texts, _tables())


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    """Model of labelled texts; see the module's description."""
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        share = float(toxic.mean()) if len(toxic) else 0.0
        return Model([], np.zeros(0), 0.0, 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    u = all_units(texts)
    words, common = _choose(u, toxic)
    if not words:
        share = float(toxic.mean())
        return Model([], np.zeros(0), 0.0, 0.0, float(np.log(share / (1 - share))))
    marks = Landmarks(words)
    _, at, of = np.unique(u.key, return_index=True, return_inverse=True)
    sentence, place, row, k_sentence = _sentences(u, of, _similar(marks, u, at))
    wide = max(len(w) for w in words)
    m = np.zeros((wide, len(words)), np.uint32)
    for j, code in enumerate(marks.codes):
        m[:len(code), j] = code
    gram = np.array([subsequence_kernel(m, code[:, None]) for code in marks.codes]) / np.sqrt(np.outer(marks.norm, marks.norm))
    gram = np.where(gram >= FLOOR, gram, 0) ** POWER
    value, vector = np.linalg.eigh(gram)
    root = vector @ np.diag(np.where(value > 1e-4, np.maximum(value, 1e-4) ** -0.5, 0)) @ vector.T
    x = np.vstack([k_sentence @ root, np.zeros((1, len(words)))])
    plain = np.bincount(row[np.setdiff1d(np.arange(len(row)), place)], minlength=len(texts))  # sentences like no landmark, by text
    row = row[place]
    told = k_sentence[:, :max(1, len(words) - common)].sum(axis=1)
    virtual = _similar(marks, _inserted(words[:len(words) - common])) @ root
    positive = toxic[row]
    f = told
    for _ in range(3):
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, row, f)
        y = np.where(positive & ((f >= best[row] - 1e-9) | (f > 1)), 1.0, np.where(positive, 0.0, -1.0))
        used = np.flatnonzero(y)
        lowest = len(x) - 1  # stands for all sentences of clean texts that are like no landmark
        many = max(1, plain[~toxic].sum())
        balance = np.where(y[used] > 0, min(5.0, ((y < 0).sum() + many) / max(1, (y > 0).sum())), 1.0)
        w = _svm(np.vstack([x[used], x[lowest:], virtual]), np.concatenate([y[used], [-1], np.ones(len(virtual))]),
                 np.concatenate([balance, [many], np.full(len(virtual), VIRTUAL)]))
        f = x[:lowest] @ w[:-1] + w[-1]
    best = np.full(len(texts), w[-1])
    np.maximum.at(best, row, f)
    return Model(words, root @ w[:-1], float(w[-1]), *_logistic(best, toxic))


def raw_scores(model: Model, texts: list[str], marks: Landmarks, tables, known: dict | None = None) -> np.ndarray:
    """SVM value of the worst sentence of each text.

    known: weights of words that this process has met, kept between calls (at most ``KNOWN``).
    """
    u = units(texts, tables)
    out = np.full(len(texts), model.bias)
    if not len(u.key) or not model.landmarks:
        return out
    keys, at, of = np.unique(u.key, return_index=True, return_inverse=True)
    known = {} if known is None else known
    old_keys, old_weights = known.get("words", (np.zeros(1, np.uint64), np.zeros(1)))
    place = np.minimum(np.searchsorted(old_keys, keys), len(old_keys) - 1)
    new = np.flatnonzero(old_keys[place] != keys)
    weight, fresh = old_weights[place], np.zeros(len(new))
    for k, which, value in marks.pairs(u, at[new]):
        fresh[which] += model.weight[k] * value  # a word occurs once in which
    weight[new] = fresh
    if len(old_keys) + len(new) > KNOWN:
        old_keys, old_weights = keys[:0], weight[:0]
    merged = np.concatenate([old_keys, keys[new]])
    order = np.argsort(merged, kind="stable")
    if len(order):
        known["words"] = merged[order], np.concatenate([old_weights, fresh])[order]
    start = np.flatnonzero(np.concatenate([[True], u.sentence[1:] != u.sentence[:-1]]))
    np.maximum.at(out, u.row[start], np.add.reduceat(weight[of], start) + model.bias)
    return out


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability that the text is toxic."""
    plain = (model.landmarks, model.weight, model.bias, model.slope, model.offset)

    @F.pandas_udf(DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, tables = Model(*plain), _tables()
        marks = Landmarks(model.landmarks)
        known = worker_cache("toxicity", plain)
        for column in batches:
            texts = [t or "" for t in column]
            raw, a, size = np.zeros(len(texts)), 0, 0
            for b in range(1, len(texts) + 1):
                size += len(texts[b - 1])
                if size >= SLICE_CHARS or b == len(texts):
                    raw[a:b] = raw_scores(model, texts[a:b], marks, tables, known)
                    a, size = b, 0
            yield pd.Series(1 / (1 + np.exp(-np.clip(model.slope * raw + model.offset, -700, 700))))

    return docs.withColumn(into, run(F.col(text)))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray]:
    """Texts and labels of the learning sample: ids are chosen first, from the labels alone."""
    some = []
    for value, most in ((1, TOXIC), (0, CLEAN)):
        some.append(labels.where(F.col("label") == value).orderBy(F.xxhash64("label_id"), "label_id").limit(most))
    ids = some[0].unionByName(some[1]).dropDuplicates(["label_id"])
    got = docs.join(F.broadcast(ids), docs["doc_id"] == ids["label_id"]).select("doc_id", "text", "label").toArrow().to_pandas()
    got = got.sort_values(["doc_id", "label"], kind="stable")
    return _texts(got), got["label"].to_numpy() == 1


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_id"), F.col("toxic").alias("label"))
    model = fit(*sample(docs, labels.where(~kept_out("label_id", 3, 1))))
    return score(docs, model).select("doc_id", kept_out("doc_id", 3, 1).alias("held_out"), "score",
                                     (F.col("score") >= 0.7).cast("int").alias("predicted"))
