"""The reference's entry points as Spark jobs.

* ``sequence_job``: commit tables + function version files -> commit rows with the edit
  script of their structure sequences (``ast_seq``), written per project; projects
  already in the output are skipped, failed commits go to a quarantine table.
* ``dataset_job``: commit rows -> feature vectors -> exact train / valid / test / corpus
  split, written per split.
* ``retrieval_job``: the test split retrieved against the corpus split, retrieved columns
  attached, written.

Each is a composition of the library's operators; nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from diffsieve.functions.vectors import fuse_channels
from diffsieve.operators.datasets import (merge_tables, pair_versions, quarantine_failures,
                                          skip_finished, split_exact)
from diffsieve.operators.features import encode_features, hash_features
from diffsieve.operators.rank import attach_results
from diffsieve.operators.retrieval import retrieve_hybrid
from diffsieve.plans.diffjob import diff_versions
from diffsieve.session import materialize
from diffsieve.sources.files import scan_commits, scan_versions, write_by_project, write_splits
from diffsieve.sources.index_store import build_index_tables


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def sequence_job(spark: SparkSession, commits_dir: str, versions_dir: str, out_dir: str, *,
                 dialect="html", keep=None, layout: str = "reference",
                 quarantine_dir: str | None = None, max_edits: int | None = None) -> None:
    """Commit rows ``(project, commit_id, diff, ast_seq, message)`` appended per project.

    Versions are paired per ``(project, commit_id)``; when a side has several files the
    last file name wins. Version files whose name does not parse, and commits without
    both versions, are written to ``quarantine_dir`` with a reason (the reference drops
    them silently).
    """
    commits = scan_commits(spark, commits_dir, layout=layout)
    if _exists(spark, out_dir):
        done = spark.read.parquet(out_dir).select("project").distinct()
        commits = skip_finished(commits, done, ("project",))
    versions = scan_versions(spark, versions_dir)
    ok_name = F.col("commit_id").isNotNull() & F.col("side").isin("negative", "positive")
    paired = pair_versions(versions.where(ok_name), keys=("project", "commit_id"),
                           order="file_name")
    # one script per version pair, however many commit rows share it; both outputs read it
    paired = materialize(paired, "version-pairs")
    whole = paired.where(F.col("neg_code").isNotNull() & F.col("pos_code").isNotNull())
    keyed = whole.withColumn("_key", F.to_json(F.struct("project", "commit_id")))
    scripts, too_long = diff_versions(keyed, "neg_code", "pos_code", key="_key", dialect=dialect,
                                      keep=keep, max_edits=max_edits, quarantine=True)
    scripts = materialize(scripts.select("project", "commit_id", "ast_seq"), "scripts")
    good, bad = quarantine_failures(commits, paired, keys=("project", "commit_id"))
    rows = good.drop("neg_code", "pos_code").join(scripts, ["project", "commit_id"])
    write_by_project(rows.select("project", "commit_id", "diff", "ast_seq", "message"), out_dir)
    if quarantine_dir:
        names = versions.where(~ok_name).select(
            "project", F.col("file_name").alias("commit_id"),
            F.lit("bad_file_name").alias("reason"))
        long = (commits.select("project", "commit_id").distinct()
                .join(too_long.select("project", "commit_id", "reason"), ["project", "commit_id"]))
        new = (bad.select("project", "commit_id", "reason").unionByName(names).unionByName(long)
               .distinct())
        if _exists(spark, quarantine_dir):
            # a re-run meets the same failures again: only new ones are appended
            old = spark.read.parquet(quarantine_dir)
            same = [new[c].eqNullSafe(old[c]) for c in ("project", "commit_id", "reason")]
            new = materialize(new.join(old, same[0] & same[1] & same[2], "left_anti"), "quarantine")
        new.write.mode("append").parquet(quarantine_dir)


def _unique_keys(df: DataFrame) -> DataFrame:
    """``df`` with a unique ``doc_id``: ``xxhash64(project, commit_id)``, drawn again from the
    row's number for all but the first of the rows that share one (repeated commits, or a
    collision of the hash). The rows that share one are found by an aggregate; only they are
    numbered.
    """
    names = df.columns
    whole = F.to_json(F.struct(*sorted(names)))
    out = df.withColumn("doc_id", F.xxhash64("project", "commit_id"))
    for again in range(4):
        out = materialize(out, "row-keys")
        shared = out.groupBy("doc_id").count().where("count > 1").select("doc_id")
        if not shared.limit(1).count():
            return out
        of = Window.partitionBy("doc_id").orderBy(whole)
        part = out.join(shared, "doc_id", "left_semi").withColumn("_n", F.row_number().over(of))
        drawn = F.when(F.col("_n") == 1, F.col("doc_id")).otherwise(
            F.xxhash64("doc_id", "_n", F.lit(again)))
        out = (out.join(shared, "doc_id", "left_anti")
               .unionByName(part.withColumn("doc_id", drawn).drop("_n")).select(*names, "doc_id"))
    raise ValueError("row keys are still not unique")


def dataset_job(spark: SparkSession, tables: Sequence[DataFrame], out_dir: str,
                sizes: Sequence[int], *, seed=114514, dim: int = 64,
                encoder: Callable | None = None, batch_size: int = 32) -> DataFrame:
    """Merge commit tables, add ``v`` and an exact split, write per split.

    The row key ``doc_id`` is a hash of (project, commit_id), made unique where commits
    repeat (the reference keys rows by position). ``encoder`` is the user's batch encoder
    (F1), called once a row; without it ``v`` is the concatenation of the hashed token
    vectors of ``diff`` and ``ast_seq`` (F2 + F3).
    """
    merged = merge_tables(list(tables)).na.fill("", subset=["ast_seq"])
    merged = _unique_keys(merged)
    # the split needs the keys alone; features are made once, for rows that know their split
    split = materialize(split_exact(merged.select("doc_id"), sizes, seed=seed, key="doc_id"), "split")
    merged = merged.join(split.select("doc_id", "split"), "doc_id")
    if encoder is not None:
        withv = encode_features(merged, encoder, batch_size, out="v")
    else:
        a = hash_features(merged, "diff", dim, out="va")
        b = hash_features(merged, "ast_seq", dim, out="vb")
        withv = (merged.join(a, "doc_id").join(b, "doc_id")
                 .withColumn("v", fuse_channels("va", "vb")).drop("va", "vb"))
    write_splits(withv, out_dir)
    return spark.read.parquet(out_dir)


def retrieval_job(spark: SparkSession, splits_dir: str, out_dir: str, *,
                  index_dir: str | None = None, k: int = 2, w_cos: float = 0.5,
                  w_lex: float = 0.5, query_split: str = "test") -> DataFrame:
    """Retrieve every row of ``query_split`` against the ``corpus`` split (W4) and write
    the query rows with ``retrieved_diff``, ``retrieved_ast_seq``, ``retrieved_message``.
    With ``index_dir`` the index tables are built once there and reused while the corpus
    is unchanged (S7)."""
    s = spark.read.parquet(splits_dir)
    corpus = s.where(F.col("split") == "corpus").drop("split")
    queries = s.where(F.col("split") == query_split).drop("split")
    idx = build_index_tables(corpus, index_dir) if index_dir else None
    res = retrieve_hybrid(corpus, queries.withColumnRenamed("doc_id", "query_id"), k,
                          w_cos=w_cos, w_lex=w_lex, index=idx)
    out = attach_results(queries.withColumnRenamed("doc_id", "query_id").drop("v"), res)
    out.write.mode("overwrite").parquet(out_dir)
    return spark.read.parquet(out_dir)
