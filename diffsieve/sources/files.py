"""File sources and sinks of the reference's layout.

Commit tables are CSV files ``<project>_commits.csv`` whose ``diff`` cells span lines
and contain quotes; function versions are whole text files
``<root>/<project>/x_<commit>_<side>.<ext>``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffsieve.operators.datasets import parse_version_key

COMMIT_COLUMNS = ("commit_id", "diff", "message")
COMMIT_SUFFIX = "_commits.csv"

# CSV options that keep multi-line quoted cells whole. With Spark's default escape
# (backslash) a cell holding \" or a trailing backslash tears rows apart.
CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"',
               "encoding": "UTF-8", "mode": "PERMISSIVE"}


def project_from_file(name_col) -> F.Column:
    """Project name = file name without the fixed ``_commits.csv`` suffix (names with
    ``_`` or ``.`` stay whole; the reference cut them at the first ``.`` or ``_``)."""
    return F.regexp_replace(name_col, r"_commits\.csv$", "")


def scan_commits(spark: SparkSession, path: str, columns=COMMIT_COLUMNS,
                 layout: str = "reference", headers: str = "mixed") -> DataFrame:
    """``(project, commit_id, diff, message)`` from commit CSV files.

    ``layout='reference'``: every ``*_commits.csv`` under ``path``, project from the file
    name. ``layout='partitioned'``: folders ``project=<name>/`` as written by
    ``write_by_project``. Columns are picked by header name and read as text (no
    inference); other columns are ignored. ``headers='mixed'``: files may order their columns
    differently or have further ones; one pass over the text finds each file's first line,
    files are read in groups of one header. ``headers='same'`` saves that pass and fails when a
    file's header differs from the first one's (columns are never taken by position).
    """
    options = {**CSV_OPTIONS, "enforceSchema": "false", "recursiveFileLookup": str(layout == "reference").lower()}
    if layout == "reference":
        options["pathGlobFilter"] = "*" + COMMIT_SUFFIX
        project = project_from_file(F.col("_metadata.file_name"))
    else:
        options["pathGlobFilter"] = "*.csv"
        project = F.regexp_extract(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), r"/project=([^/]*)/", 1)
    if headers == "same":
        groups = [(None, [path])]
    else:
        text = {k: v for k, v in options.items() if k in ("pathGlobFilter", "recursiveFileLookup")}
        lines = spark.read.options(**text).text(path).where(F.col("_metadata.file_block_start") == 0)
        first = (lines.select(F.col("_metadata.file_path").alias("file"), "value",
                              F.monotonically_increasing_id().alias("n"))
                 .groupBy("file").agg(F.min_by("value", "n").alias("header")))
        # a row per distinct header; the file names of a group are needed to read it
        groups = [(r["header"], sorted(r["files"])) for r in
                  first.groupBy("header").agg(F.collect_list("file").alias("files")).orderBy("header").collect()]
    out = None
    for _, files in groups:
        part = spark.read.options(**options).csv(files)
        part = part.select(project.alias("project"), *[F.col(c) for c in columns])
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in ("project", *columns)))
    return out


def _norm_path(c) -> F.Column:
    # one spelling for "scheme:///path" and "scheme:/path"
    return F.regexp_replace(c, r"^([A-Za-z][A-Za-z0-9+.-]*):///", "$1:/")


def scan_versions(spark: SparkSession, root: str) -> DataFrame:
    """``(project, commit_id, side, code, file_name, path)`` from the version files
    (S2). Each file is read whole by the binary file source; ``project`` is the parent
    folder.

    Every Spark file scan skips zero-byte files, but an empty version is still a version
    (an added or deleted function). The file index's listing (``inputFiles``, one call)
    keeps them: files listed but not scanned are added back with empty text by an anti
    join -- no per-file calls and nothing scanned on the driver.
    """
    b = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
         .select(_norm_path(F.col("path")).alias("path"), "content"))
    listed = spark.createDataFrame([(x,) for x in
                                    spark.read.format("binaryFile")
                                    .option("recursiveFileLookup", "true").load(root).inputFiles()],
                                   "path string").select(_norm_path(F.col("path")).alias("path"))
    empty = (listed.join(b.select("path"), "path", "left_anti")
             .select("path", F.lit(bytearray()).cast("binary").alias("content")))
    b = b.unionByName(empty)
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    project = F.element_at(F.split(F.col("path"), "/"), -2)
    cid, side = parse_version_key("file_name")
    return (b.withColumn("file_name", name)
            .select(project.alias("project"), cid, side,
                    F.decode(F.col("content"), "UTF-8").alias("code"), "file_name", "path"))


def write_by_project(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    """Append finished rows partitioned by project (S5). ``fmt='csv'`` writes
    header + quoted cells with the same options the scan reads."""
    w = df.write.mode(mode).partitionBy("project")
    if fmt == "csv":
        w.options(**{k: v for k, v in CSV_OPTIONS.items() if k not in ("multiLine", "mode")}).csv(path)
    else:
        w.format(fmt).save(path)


def write_splits(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a split table as one folder per split value."""
    w = df.write.mode(mode).partitionBy("split")
    if fmt == "csv":
        w.options(header="true", quote='"', escape='"').csv(path)
    else:
        w.format(fmt).save(path)
