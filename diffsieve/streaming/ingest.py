"""Incremental ingest and streaming lookup (F5, F6) with Structured Streaming.

Progress lives in the streaming checkpoint (the file source remembers every file it
has committed), so a re-run takes only new files; that replaces the reference's JSON
list of finished projects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffsieve.session import materialize
from diffsieve.sources.files import COMMIT_COLUMNS, COMMIT_SUFFIX, CSV_OPTIONS, project_from_file


PROGRESS = "spark.sql.streaming.numRecentProgressUpdates"


def commit_schema(columns=COMMIT_COLUMNS) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def ingest_incremental(spark: SparkSession, src: str, out: str, checkpoint: str,
                       schema: T.StructType | None = None, keep=COMMIT_COLUMNS,
                       fmt: str = "parquet", layout: str = "reference") -> int:
    """Process the commit files under ``src`` that earlier runs have not seen.

    Runs one ``availableNow`` micro-batch sequence and returns the number of rows
    written. ``schema`` lists the files' columns in file order; a file whose header has other
    names or another order ends the run with an error, so no cell lands in a wrong column.
    ``keep`` are the columns written, plus
    ``project`` -- from the file name (``layout='reference'``, files
    ``<project>_commits.csv``) or from ``project=<name>/`` folders
    (``layout='partitioned'``, as ``write_by_project`` writes them).
    """
    if layout == "partitioned":
        sch = T.StructType(list((schema or commit_schema()).fields)
                           + [T.StructField("project", T.StringType())])
        stream = (spark.readStream.options(**CSV_OPTIONS).option("enforceSchema", "false").schema(sch).csv(src)
                  .select("project", *keep))
    else:
        stream = (spark.readStream.options(**CSV_OPTIONS).option("enforceSchema", "false")
                  .option("pathGlobFilter", "*" + COMMIT_SUFFIX)
                  .schema(schema or commit_schema()).csv(src)
                  .select(project_from_file(F.col("_metadata.file_name")).alias("project"), *keep))
    # Spark keeps the last 100 progress reports by default; the count needs all of this run's
    kept = spark.conf.get(PROGRESS)
    spark.conf.set(PROGRESS, str(10**6))
    try:
        q = (stream.writeStream.format(fmt).partitionBy("project")
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out))
        q.awaitTermination()
        return sum(int(p.get("numInputRows", 0)) for p in q.recentProgress)
    finally:
        spark.conf.set(PROGRESS, kept)


def augment_stream(queries: DataFrame, lookup, out: str, checkpoint: str,
                   key: str = "query_id", within: tuple[str, str] | None = None) -> None:
    """Run ``lookup(batch_df) -> DataFrame`` on every micro-batch of a query stream and
    write the results (F6).

    Each batch is written to its own ``batch_id=<n>`` folder with ``overwrite``, so a
    retried batch replaces its earlier attempt instead of appending twice. A key is
    answered once over all batches and restarts: the stream is de-duplicated with keyed
    state in the checkpoint. The state holds every key seen; with ``within=(time column,
    delay)`` keys are forgotten once the watermark passed them. The static side (corpus,
    index tables) is captured by ``lookup``.
    """
    if within is None:
        queries = queries.dropDuplicates([key])
    else:
        queries = queries.withWatermark(*within).dropDuplicatesWithinWatermark([key])

    def run(batch: DataFrame, batch_id: int) -> None:
        # read once: the plan of a stateful batch must not run again for every action of the lookup
        res = lookup(materialize(batch, "batch"))
        res.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch_id={batch_id}")

    q = (queries.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
