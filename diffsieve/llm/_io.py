"""Input tables and shared-folder tables of the queries."""

from __future__ import annotations

import gc
import hashlib
import pickle
import sys
import types

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, read by every branch.

    What the tasks shuffled for it isn't needed from then on. Spark deletes shuffle files once
    the driver's garbage collector has found their plan unused, so it is asked to look now;
    otherwise every step's files would stay on the executors' disks until the job ends.
    """
    table = materialize(df, name)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return table


def kept_out(doc_id: str, modulus: int, value: int):
    """Held-out test by crc32 of the id's decimal text; a null id counts as text ''."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus) == value


def worker_cache(name: str, version: object) -> dict:
    """A dict that lives as long as this Python process and ``version`` (any picklable value).

    Functions reach the workers by value, module globals included, so what shall outlast a
    task is kept in a module of its own. Only for values that can be computed again.
    """
    module = sys.modules.setdefault("diffsieve_worker_cache", types.ModuleType("diffsieve_worker_cache"))
    mark = hashlib.sha256(pickle.dumps(version)).hexdigest()
    kept = module.__dict__.get(name)
    if kept is None or kept[0] != mark:
        kept = module.__dict__[name] = (mark, {})
    return kept[1]
