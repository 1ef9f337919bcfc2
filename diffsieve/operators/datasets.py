"""Dataset building: version pairing, commit joins, resume, set operations, exact
splits (J1-J3, P1, P5, U1, U2, S4, A8, A9, W5, W6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from diffsieve.session import materialize

SPLIT_NAMES = ("train", "valid", "test", "corpus")
# Groups of the exact split: the first HASH_GROUP_CHARS hex digits of the row hash
# (20 bits), so the per-group count table has at most 2**20 rows.
HASH_GROUP_CHARS = 5
# A group-count table up to this many rows is broadcast into the row join.
BROADCAST_GROUPS = 1 << 20


# ------------------------------------------------------------------ versions, joins

def parse_version_key(file_name: str = "file_name"):
    """``(commit_id, side)`` from ``x_<commit>_<side>.<ext>``.

    The name is cut at its first ``.`` and split on ``_``; parts 2 and 3 are the commit
    id and the side. A name with too few parts yields nulls (quarantined by callers;
    the reference raises).
    """
    parts = F.split(F.substring_index(F.col(file_name), ".", 1), "_")
    return (F.try_element_at(parts, F.lit(2)).alias("commit_id"),
            F.try_element_at(parts, F.lit(3)).alias("side"))


def pair_versions(versions: DataFrame, keys: Sequence[str] = ("project", "commit_id"),
                  side: str = "side", code: str = "code", order: str = "turn") -> DataFrame:
    """One row per commit with its old (``negative``) and new (``positive``) text.

    When a side has several versions the one with the largest ``order`` wins (the
    reference keeps the file it meets last). A pivot with fixed values: one hash
    aggregate, partial before the shuffle.
    """
    keys = [k for k in keys if k in versions.columns]

    def last(which):
        sel = F.col(side) == which
        return F.max_by(F.when(sel, F.col(code)), F.when(sel, F.col(order)))

    return versions.groupBy(*keys).agg(last("negative").alias("neg_code"),
                                       last("positive").alias("pos_code"))


def join_commit_versions(commits: DataFrame, paired: DataFrame,
                         keys: Sequence[str] = ("project", "commit_id")) -> DataFrame:
    """Commit rows with both of their versions; a missing side drops the commit."""
    keys = [k for k in keys if k in commits.columns and k in paired.columns]
    return (commits.join(paired, keys)
            .where(F.col("neg_code").isNotNull() & F.col("pos_code").isNotNull()))


def quarantine_failures(commits: DataFrame, paired: DataFrame,
                        keys: Sequence[str] = ("project", "commit_id")):
    """Split commits into processable rows and a quarantine with a reason (P5).

    Returns ``(good, bad)``; ``bad`` carries ``reason`` in ``no_versions``,
    ``missing_negative``, ``missing_positive``. The reference drops such rows silently.
    """
    keys = [k for k in keys if k in commits.columns and k in paired.columns]
    j = commits.join(paired.withColumn("_has", F.lit(True)), keys, "left")
    reason = (F.when(F.col("_has").isNull(), F.lit("no_versions"))
              .when(F.col("neg_code").isNull(), F.lit("missing_negative"))
              .when(F.col("pos_code").isNull(), F.lit("missing_positive")))
    j = j.withColumn("reason", reason).drop("_has")
    return j.where(F.col("reason").isNull()).drop("reason"), j.where(F.col("reason").isNotNull())


def skip_finished(rows: DataFrame, done: DataFrame, keys: Sequence[str] = ("project",)) -> DataFrame:
    """Rows whose key is not in the done table (J3), a left anti join."""
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti")


def pending_projects(all_projects: DataFrame, done: DataFrame, col: str = "project") -> DataFrame:
    """Set difference ``all - done`` on one column (U2), ``EXCEPT DISTINCT``."""
    return all_projects.select(col).subtract(done.select(col))


def distinct_projects(rows: DataFrame, col: str = "project") -> DataFrame:
    """De-duplicated project list."""
    return rows.select(col).distinct()


def merge_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Concatenate tables by column name; missing columns become null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


# ------------------------------------------------------------------------ splits

def _split_of(rank, bounds):
    c = F.when(rank <= F.lit(bounds[0]), F.lit(SPLIT_NAMES[0]))
    for b, name in zip(bounds[1:], SPLIT_NAMES[1:3]):
        c = c.when(rank <= F.lit(b), F.lit(name))
    return c.otherwise(F.lit(SPLIT_NAMES[3]))


def running_before(counts: DataFrame, key: str, count: str, out: str = "_before", partitions: int | None = None) -> DataFrame:
    """``counts`` with the sum of ``count`` over all smaller keys, without a one-task window.

    The rows are range-partitioned by ``key`` and written with their partition number; each
    partition is summed by itself, and the partitions' totals (one row each) give their offsets.
    """
    spark = counts.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(counts.repartitionByRange(n, key).withColumn("_part", F.spark_partition_id()), "split-counts")
    totals = sorted((r["_part"], r["n"]) for r in ranged.groupBy("_part").agg(F.sum(count).alias("n")).collect())
    offsets, before = [], 0
    for part, total in totals:
        offsets.append((part, before))
        before += total
    at = F.broadcast(spark.createDataFrame(offsets, "_part int, _offset long"))
    own = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.join(at, "_part").withColumn(out, F.col("_offset") + F.coalesce(F.sum(count).over(own), F.lit(0)))
            .drop("_part", "_offset"))


def _assign_by_groups(rows: DataFrame, group, within: list, sizes: Sequence[int]) -> DataFrame:
    """Give every row its split by a global order ``(group, *within)``.

    Only group counts are ranked globally (``running_before`` over the count table).
    A group whose rows all fall into one split takes it without any ordering; only the
    at most three groups that straddle a boundary are ordered inside (a window per
    group). No step moves all rows through one task.
    """
    if any(s < 0 for s in sizes):
        raise ValueError("split sizes must be non-negative")
    bounds = [sum(sizes[:i + 1]) for i in range(3)]
    g = rows.withColumn("_g", group)
    # the count table (one row per group) is written once by ``running_before``: both branches
    # below and the size check read it instead of recounting the rows
    counts = running_before(g.groupBy("_g").agg(F.count(F.lit(1)).alias("_cnt")), "_g", "_cnt")
    stats = counts.agg(F.sum("_cnt").alias("n"), F.count(F.lit(1)).alias("groups")).first()
    total = int(stats["n"] or 0)
    if total < bounds[2]:
        raise ValueError(f"too few rows for the split: {total} < {bounds[2]}")
    counts = (counts.withColumn("_first", _split_of(F.col("_before") + 1, bounds))
              .withColumn("_last", _split_of(F.col("_before") + F.col("_cnt"), bounds)))
    if int(stats["groups"]) <= BROADCAST_GROUPS:
        counts = F.broadcast(counts)
    j = g.join(counts, "_g")
    whole = j.where(F.col("_first") == F.col("_last")).withColumn("split", F.col("_first"))
    w = Window.partitionBy("_g").orderBy(*within)
    cut = (j.where(F.col("_first") != F.col("_last"))
           .withColumn("split", _split_of(F.col("_before") + F.row_number().over(w), bounds)))
    drop = ["_g", "_cnt", "_before", "_first", "_last"]
    return whole.unionByName(cut).drop(*drop)


def row_hash(key: str, seed) -> F.Column:
    """Seeded order key of a row: md5 of ``seed:key`` as hex text."""
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(key).cast("string")))


def split_exact(rows: DataFrame, sizes: Sequence[int], seed=114514, key: str = "doc_id") -> DataFrame:
    """Seeded shuffle, then exactly ``sizes[0]`` train, ``sizes[1]`` valid,
    ``sizes[2]`` test rows and the rest as ``corpus`` (W5); adds ``split``.

    The order is ``(md5(seed:key), key)``; fewer rows than requested raise.
    """
    h = row_hash(key, seed)
    r = rows.withColumn("_h", h)
    out = _assign_by_groups(r, F.substring(F.col("_h"), 1, HASH_GROUP_CHARS),
                            [F.col("_h"), F.col(key)], sizes)
    return out.drop("_h")


def split_blocked(rows: DataFrame, sizes: Sequence[int], seed=114514, key: str = "doc_id",
                  position: str = "doc_id", block: int = 10_000) -> DataFrame:
    """The reference's split: rows are shuffled only inside consecutive blocks of
    ``block`` positions, blocks stay in file order (W6). ``position`` is the 0-based
    row position."""
    h = row_hash(key, seed)
    r = rows.withColumn("_h", h)
    blk = F.floor(F.col(position) / F.lit(block)).cast("long")
    out = _assign_by_groups(r, blk, [F.col("_h"), F.col(key)], sizes)
    return out.drop("_h")


def split_sizes(split_rows: DataFrame) -> DataFrame:
    """Row count per split."""
    return split_rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
