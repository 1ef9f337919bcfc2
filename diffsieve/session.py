"""Session defaults and the shared working folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job of the library relies on. AQE re-plans joins from runtime sizes,
# coalesces small shuffle partitions and splits skewed ones.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "diffsieve",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    On a cluster ``master`` stays ``None`` and the launcher decides; tests pass
    ``local[*]``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, name: str | None = None) -> str:
    """A fresh sub-folder of the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir`` (set by the cluster). Only when a local
    session has none -- tests -- a new temporary folder is created and registered as the
    checkpoint folder, so that ``DataFrame.checkpoint()`` works as well. On a cluster a
    machine-local folder would be a different one on every executor, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local") or "local-cluster" in spark.conf.get("spark.master", ""):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="diffsieve-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    # the writers that use this folder create it on whatever file system it lives
    return base.rstrip("/") + "/" + (name or "work") + "-" + uuid.uuid4().hex[:12]


def default_parallelism(spark: SparkSession) -> int:
    """Number of task slots to aim block layouts at."""
    try:
        return max(1, int(spark.sparkContext.defaultParallelism))
    except Exception:  # pragma: no cover - connect sessions have no SparkContext
        return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def release_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of plans that are no longer used deleted now.

    Spark deletes them once the driver's garbage collector finds their plan unused, which may
    be never in a short job; a loop of large shuffles would add up on the executors' disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialize(df, name: str = "table"):
    """Write ``df`` as Parquet under the shared folder and read it back.

    Used where one expensive intermediate feeds several branches of a plan (Spark
    would otherwise compute it once per branch) or where lineage should be cut: after
    this, a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
