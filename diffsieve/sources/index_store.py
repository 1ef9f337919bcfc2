"""Persisted lexical index tables with a corpus fingerprint.

Layout under ``path``: a folder per corpus fingerprint with ``docs/`` (a row per text with its
postings in a list), ``terms/`` and, written last,
``meta/`` (one row: the fingerprint and per-field statistics). A folder with ``meta`` is
complete and is reused; a changed corpus gets a folder of its own, so a rebuild that ends
half way neither harms nor impersonates an older index.

``clustered=True`` adds the layout that lookups read (``TermStore``): ``clustered/`` holds the
postings range-partitioned and sorted by (field, term, document block), about
``POSTINGS_PER_FILE`` a file, so that a term stands in one file and a hot one is split over several.
A block of a term stands in one file, and its first posting has the block's largest document factor
(if it has several) and number of postings as well, so that the postings are exchanged once and written once.
``manifest/`` names each file's first and last term, ``term_max/`` has the largest factor and the
postings of each term.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from diffsieve.operators.lexical import B, K1, SALT_ROWS, SCORE_SCALE, LexicalIndex, build_index, flat, salted_postings

POSTINGS_PER_FILE = 4_000_000
# Documents are dealt into blocks of about this many by a hash of their key.
DOCS_PER_BLOCK = 64
ROW_GROUP_BYTES = 1 << 20


def _top() -> Column:
    """The largest factor of a block; that of a single posting is its own."""
    return F.coalesce("top", "tfn").alias("top")


def fingerprint(corpus: DataFrame, key: str, fields) -> str:
    """Row count and an order-independent sum of row hashes, as text."""
    h = F.xxhash64(F.col(key), *[F.coalesce(F.col(f), F.lit("")) for f in fields])
    r = corpus.agg(F.count(F.lit(1)).alias("n"),
                   F.sum(h.cast("decimal(38,0)")).alias("s")).first()
    return f"{r['n']}:{r['s']}"


def _exists(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _read(spark, path: str):
    if not _exists(spark, path + "/meta/_SUCCESS"):
        return None
    try:
        return spark.read.parquet(path + "/meta").first()
    except AnalysisException:
        return None


def _ordered(df: DataFrame, files: int, *by: str) -> DataFrame:
    return df.repartitionByRange(files, *by).sortWithinPartitions(*by)


def _write_sorted(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)


def _key(field: str, term: str) -> bytes:
    """Orders like (field, term) does in Spark: strings by their UTF-8 bytes."""
    return (field + "\0" + term).encode()


@dataclass
class TermStore:
    """Term-clustered postings of an index, read by the terms of a lookup."""

    path: str
    index: LexicalIndex
    manifest: list  # (first key, last key, file, postings) in key order, a row a file

    @property
    def spark(self):
        return self.index.terms.sparkSession

    def term_max(self) -> DataFrame:
        return self.spark.read.parquet(self.path + "/term_max")

    def block_max(self) -> DataFrame:
        """``(field, term, block, top, n)``: the largest factor and the postings of each block of a term."""
        return self.spark.read.parquet(self.path + "/clustered").where(F.col("n").isNotNull()).select("field", "term", "block", _top(), "n")

    def files_of(self, terms: DataFrame) -> list[str]:
        """The files that hold any of the ``(field, term)`` pairs; at most the manifest's."""
        sent = self.spark.sparkContext.broadcast(([x[1] for x in self.manifest], [x[0] for x in self.manifest]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, first = sent.value
            found: set = set()
            for batch in batches:
                for f, t in zip(*(c.to_pylist() for c in batch.columns)):
                    k = _key(f, t)
                    at = bisect.bisect_left(last, k)
                    while at < len(last) and first[at] <= k:
                        found.add(at)
                        at += 1
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int32())], ["file"])

        hit = terms.select("field", "term").mapInArrow(run, "file int").distinct().collect()
        return [self.manifest[i][2] for i in sorted(r["file"] for r in hit)]

    def postings(self, terms: DataFrame) -> DataFrame:
        """``(field, term, block, doc_id, tf, dl, tfn)`` read from the files of ``terms`` alone;
        other terms of those files come along, so the caller still joins."""
        files = self.files_of(terms)
        found = self.spark.read.parquet(*files) if files else self.spark.read.parquet(self.path + "/clustered").where(F.lit(False))
        return found.drop("top", "n")


def _cluster(idx: LexicalIndex, path: str, per_file: int, per_block: int) -> None:
    spark = idx.terms.sparkSession
    total = idx.terms.agg(F.sum("df").alias("n")).first()["n"] or 0
    files = max(1, math.ceil(total / per_file))
    blocks = max(1, math.ceil(idx.n_corpus / per_block))
    factor = F.lit(0.0)
    for f in idx.fields:
        n, avgdl = idx.stats[f]
        if n:
            norm = F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * F.col("dl") / F.lit(avgdl))
            factor = F.when(F.col("field") == f, F.col("tf") / (F.col("tf") + norm) * F.lit(SCORE_SCALE)).otherwise(factor)
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block")
    rows = flat(spark.read.parquet(path + "/docs")).select("field", "term", block, "doc_id", "tf", "dl")
    # a block of a term lies in one partition, in order: its maximum needs no further exchange
    rows = rows.repartitionByRange(files, "field", "term", "block").sortWithinPartitions("field", "term", "block", "doc_id")
    rows = rows.withColumn("tfn", factor)
    own = Window.partitionBy("field", "term", "block")
    first = F.row_number().over(own.orderBy("doc_id")) == 1
    rows = rows.withColumns({"top": F.max("tfn").over(own), "n": F.count(F.lit(1)).over(own), "first": first})
    rows = rows.withColumns({"top": F.when(F.col("first") & (F.col("n") > 1), F.col("top")), "n": F.when(F.col("first"), F.col("n"))}).drop("first")
    _write_sorted(rows, path + "/clustered")
    rows = spark.read.parquet(path + "/clustered")
    per = rows.where(F.col("n").isNotNull()).select("field", "term", _top(), "n")
    terms = per.groupBy("field", "term").agg(F.max("top").alias("top"), F.sum("n").alias("df"))
    _write_sorted(_ordered(terms, max(1, files // 8), "field", "term"), path + "/term_max")
    ends = F.struct("field", "term")
    (rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(ends).alias("lo"), F.max(ends).alias("hi"), F.count(F.lit(1)).alias("n"))
     .coalesce(1).write.mode("overwrite").parquet(path + "/manifest"))


def open_store(idx: LexicalIndex, path: str, per_file: int = POSTINGS_PER_FILE, per_block: int = DOCS_PER_BLOCK) -> TermStore:
    """The term-clustered postings under an index's folder, built when they aren't there."""
    spark = idx.terms.sparkSession
    if not _exists(spark, path + "/manifest/_SUCCESS"):
        _cluster(idx, path, per_file, per_block)
    rows = spark.read.parquet(path + "/manifest").collect()  # a row a file
    manifest = sorted((_key(*r["lo"]), _key(*r["hi"]), r["file"], r["n"]) for r in rows)
    return TermStore(path, idx, manifest)


def build_index_tables(corpus: DataFrame, path: str, key: str = "doc_id", fields=("diff",),
                       reuse: bool = True, salt_rows: int = SALT_ROWS, clustered: bool = False,
                       per_file: int = POSTINGS_PER_FILE, per_block: int = DOCS_PER_BLOCK) -> LexicalIndex:
    """Build (or reuse) the index tables of ``corpus`` under ``path`` and return the
    index read back from Parquet; with ``clustered`` its ``store`` is open for lookups."""
    spark = corpus.sparkSession
    fields = tuple(fields)
    fp = fingerprint(corpus, key, fields)
    path = f"{path.rstrip('/')}/{hashlib.sha256((fp + json.dumps(fields)).encode()).hexdigest()[:16]}"
    meta = _read(spark, path) if reuse else None
    whole = meta is not None and _exists(spark, path + "/docs/_SUCCESS")  # an older layout is built anew
    if not whole or meta["fingerprint"] != fp or tuple(json.loads(meta["fields"])) != fields:
        idx = build_index(corpus, key, fields, salt_rows, path=path)
        row = [(fp, json.dumps(fields), json.dumps(idx.stats), idx.n_corpus, idx.min_key)]
        (spark.createDataFrame(row, "fingerprint string, fields string, stats string, "
                                    "n_corpus long, min_key long")
         .coalesce(1).write.mode("overwrite").parquet(path + "/meta"))
        if clustered:
            idx.store = open_store(idx, path, per_file, per_block)
        return idx
    stats = {k: tuple(v) for k, v in json.loads(meta["stats"]).items()}
    # a stored index is re-opened through the same salting rule as a fresh build
    terms = spark.read.parquet(path + "/terms")
    postings = salted_postings(flat(spark.read.parquet(path + "/docs")), terms, stats, salt_rows)
    idx = LexicalIndex(postings, terms, stats, int(meta["n_corpus"]), meta["min_key"], fields, salt_rows)
    if clustered:
        idx.store = open_store(idx, path, per_file, per_block)
    return idx
