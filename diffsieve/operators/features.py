"""Feature vectors per row: hashed token counts (F2) and user encoders (F1)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffsieve.functions.text import null_to_empty, tokenize
from diffsieve.operators.lexical import spread

# Fixed value: hex digits of md5(term) that, as a number modulo the width, pick a term's bucket.
BUCKET_HEX_DIGITS = 6


def hash_features(df: DataFrame, text: str, dim: int = 64, key: str = "doc_id",
                  out: str = "v") -> DataFrame:
    """L2-normalised hashed token counts of a text column (F2): ``(key, out)``.

    A row's vector depends on its own text alone, so nothing is shuffled (a corpus that
    doesn't fill the task slots is dealt out first): tokens are found in the JVM, each batch's
    distinct terms are hashed once, and their counts are added up in one array a batch.
    Rows without tokens get a zero vector.
    """
    rows = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text")))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, n = batch.column(1), batch.num_rows
            coded = pc.list_flatten(tokens).dictionary_encode()
            digits = BUCKET_HEX_DIGITS
            bucket = np.array([int(hashlib.md5(t.encode()).hexdigest()[:digits], 16) % dim for t in coded.dictionary.to_pylist()], np.int64)
            row = np.repeat(np.arange(n), np.asarray(pc.list_value_length(tokens), np.int64))
            at = row * dim + (bucket[np.asarray(coded.indices, np.int64)] if len(row) else row)
            m = np.bincount(at, minlength=n * dim).reshape(n, dim).astype(np.float64)
            norm = np.sqrt((m * m).sum(axis=1))
            m[norm > 0] /= norm[norm > 0][:, None]
            off = pa.array(np.arange(n + 1, dtype=np.int32) * dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(off, pa.array(m.astype(np.float32).ravel()))], ["key", "vec"])

    vec = rows.select("key", tokenize(null_to_empty("text")).alias("tokens")).mapInArrow(run, f"key {kind}, vec array<float>")
    return vec.select(F.col("key").alias(key), F.col("vec").alias(out))


def hash_encoder(dim: int = 64) -> Callable[[list, list], list]:
    """A batch encoder with the same output as ``hash_features`` on the ``diff``
    channel, as a plain function for ``encode_features`` (used to check the batching)."""
    import regex

    pat = regex.compile(r"[\p{L}\p{N}_]+")

    def enc(diffs: list, _seqs: list) -> list:
        out = []
        for t in diffs:
            v = np.zeros(dim)
            for w in pat.findall((t or "").lower()):
                v[int(hashlib.md5(w.encode()).hexdigest()[:BUCKET_HEX_DIGITS], 16) % dim] += 1
            n = np.sqrt((v * v).sum())
            out.append((v / n if n > 0 else v).astype(np.float32))
        return out
    return enc


def encode_or_error(df: DataFrame, fn: Callable[[list, list], Sequence], batch_size: int = 32,
                    diff: str = "diff", ast_seq: str = "ast_seq",
                    out: str = "feature_vector") -> tuple[DataFrame, DataFrame]:
    """``encode_features`` for encoders that may fail: ``(good, bad)`` rows, ``bad`` with ``reason``.

    A batch that raises is encoded again row by row, so one bad row costs its batch a second
    call and nothing else.
    """
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.FloatType())), T.StructField("reason", T.StringType())])

    def attempt(diffs: list, seqs: list) -> list:
        try:
            got = [np.asarray(v, dtype=np.float32).ravel().tolist() for v in fn(diffs, seqs)]
            if len(got) != len(diffs):
                raise ValueError(f"{len(got)} vectors for {len(diffs)} rows")
            return [(v, None) for v in got]
        except Exception as e:  # whatever the user's encoder raises
            if len(diffs) == 1:
                return [(None, f"{type(e).__name__}: {e}")]
            return [attempt([d], [s])[0] for d, s in zip(diffs, seqs)]

    def run(batches):
        for pdf in batches:
            rows = []
            for s in range(0, len(pdf), batch_size):
                chunk = pdf.iloc[s:s + batch_size]
                rows += attempt(list(chunk[diff]), [x if isinstance(x, str) else "" for x in chunk[ast_seq]])
            yield pdf.assign(**{out: pd.Series([v for v, _ in rows], index=pdf.index, dtype=object),
                                "reason": pd.Series([r for _, r in rows], index=pdf.index, dtype=object)})

    tried = df.mapInPandas(run, schema)
    return tried.where("reason is null").drop("reason"), tried.where("reason is not null").drop(out)


def encode_features(df: DataFrame, fn: Callable[[list, list], Sequence], batch_size: int = 32,
                    diff: str = "diff", ast_seq: str = "ast_seq",
                    out: str = "feature_vector") -> DataFrame:
    """Add ``out`` = ``fn(diffs, ast_seqs)`` computed in batches of ``batch_size`` (F1).

    ``fn`` is the user's encoder (one load per Python worker if it caches its model in
    a global). Null ``ast_seq`` is passed as ``''``; ``diff`` is passed as it is.
    """
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches):
        for pdf in batches:
            vecs = []
            for s in range(0, len(pdf), batch_size):
                chunk = pdf.iloc[s:s + batch_size]
                seqs = [x if isinstance(x, str) else "" for x in chunk[ast_seq]]
                vecs.extend(np.asarray(v, dtype=np.float32).ravel().tolist()
                            for v in fn(list(chunk[diff]), seqs))
            yield pdf.assign(**{out: pd.Series(vecs, index=pdf.index, dtype=object)})
    return df.mapInPandas(run, schema)
