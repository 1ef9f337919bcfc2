"""Training-corpus pipeline: five stages over ``documents``, each written and read again.

Rows that the language model rejects go; of each group of near copies one stays; contaminated
rows go; entities get surrogates; what is left is packed into sequences. A stage works on all
rows that its predecessor kept, and returns the columns of ``documents`` (the last one: the packed
pieces). Null columns, empty texts, repeated rows and further columns are treated as the
operators' docstrings say; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffsieve.llm import decontamination, jaccard_join, language_id, packing, pii
from diffsieve.llm._io import read, saved


#: Rows in an Arrow batch: the stages follow each other in the same executors, whose Python
#: workers and JVM buffers hold a few whole batches of texts each.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches; the plans take the setting when they run."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the language model doesn't reject."""
    _small_batches(spark)
    return language_id.accepted(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of the 5-gram Jaccard join at 0.8."""
    _small_batches(spark)
    return jaccard_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without benchmark passages, by the contamination rule of the operator."""
    _small_batches(spark)
    return decontamination.clean_rows(docs, read(spark, sf_dir, "benchmark"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with surrogates for entities; ``n_chars`` follows the new text."""
    _small_batches(spark)
    done = pii.replace_entities(docs)
    if "n_chars" not in docs.columns:
        return done
    return done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows with their sequence and place."""
    _small_batches(spark)
    table = saved(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "pieces")
    return packing.pack(table).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", decontaminate),
    ("pii_surrogates", replace_pii),
    ("best_fit_packing", pack),
]

#: Language models, tokenisation and packing can't be said in SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
