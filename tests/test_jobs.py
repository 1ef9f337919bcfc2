import csv
import os

from pyspark.sql import functions as F

from diffsieve.plans.jobs import dataset_job, retrieval_job, sequence_job

TRICKY = 'diff --git a b\n+++ b/x.java\n"quoted", comma\\'


def _commits(path, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(["commit_id", "author", "diff", "message"])
        w.writerows(rows)


def _version(root, project, name, body):
    os.makedirs(os.path.join(root, project), exist_ok=True)
    with open(os.path.join(root, project, name), "w", encoding="utf-8") as f:
        f.write(body)


def test_reference_entry_points(spark, tmp):
    cdir, vdir, out, bad = tmp + "/commits", tmp + "/versions", tmp + "/out", tmp + "/bad"
    os.makedirs(cdir)
    _commits(cdir + "/my_proj.v2_commits.csv",
             [("c1", "x", TRICKY, "fix one"), ("c2", "y", "diff --git\n+++ b/y\nz", "fix two"),
              ("c3", "z", "diff three", "no versions")])
    _commits(cdir + "/other_commits.csv", [("d1", "x", "diff --git\n+++ b/q\nw", "other fix")])
    _version(vdir, "my_proj.v2", "x_c1_negative.txt", "a b c d e")
    _version(vdir, "my_proj.v2", "x_c1_positive.txt", "a b e d f")
    _version(vdir, "my_proj.v2", "x_c2_negative.txt", "x y")
    _version(vdir, "my_proj.v2", "x_c2_positive.txt", "")
    _version(vdir, "my_proj.v2", "broken.txt", "?")
    _version(vdir, "other", "x_d1_negative.txt", "p q")
    _version(vdir, "other", "x_d1_positive.txt", "q p")

    def words(t):
        return t.split()
    sequence_job(spark, cdir, vdir, out, dialect=words, quarantine_dir=bad)
    rows = {(r.project, r.commit_id): r for r in spark.read.parquet(out).collect()}
    assert set(rows) == {("my_proj.v2", "c1"), ("my_proj.v2", "c2"), ("other", "d1")}
    assert rows[("my_proj.v2", "c1")].ast_seq == "a b -c -d e +d +f "
    assert rows[("my_proj.v2", "c1")].diff == TRICKY
    assert rows[("my_proj.v2", "c2")].ast_seq == "-x -y "   # an empty new version still pairs
    assert rows[("other", "d1")].ast_seq == "-p q +p "
    reasons = {(r.commit_id, r.reason) for r in spark.read.parquet(bad).collect()}
    assert reasons == {("c3", "no_versions"), ("broken.txt", "bad_file_name")}
    sequence_job(spark, cdir, vdir, out, dialect=words)        # finished projects are skipped
    assert spark.read.parquet(out).count() == 3

    table = spark.read.parquet(out).select(F.col("project").cast("string"), "commit_id", "diff",
                                           "ast_seq", "message")
    splits = dataset_job(spark, [table], tmp + "/splits", (1, 0, 1), dim=16)
    assert {r.split: r.n for r in splits.groupBy("split").agg(F.count("*").alias("n")).collect()} == \
        {"train": 1, "test": 1, "corpus": 1}
    res = retrieval_job(spark, tmp + "/splits", tmp + "/retrieved", index_dir=tmp + "/index")
    r = res.collect()
    assert len(r) == 1 and r[0].retrieved_diff is not None
