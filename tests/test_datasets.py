import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from diffsieve.operators import datasets as DS


def _brute(df, sizes, order):
    w = Window.orderBy(*order)
    r = df.withColumn("rk", F.row_number().over(w))
    b = [sum(sizes[:i + 1]) for i in range(3)]
    s = (F.when(F.col("rk") <= b[0], "train").when(F.col("rk") <= b[1], "valid")
         .when(F.col("rk") <= b[2], "test").otherwise("corpus"))
    return {r.doc_id: r.split for r in r.select("doc_id", s.alias("split")).collect()}


def test_split_exact_equals_global_sort(spark):
    df = spark.range(0, 5000).withColumnRenamed("id", "doc_id")
    sizes = (3000, 700, 600)
    got = {r.doc_id: r.split for r in DS.split_exact(df, sizes, seed=7).collect()}
    h = F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string")))
    assert got == _brute(df.withColumn("h", h), sizes, ["h", "doc_id"])
    counts = {r.split: r.n for r in DS.split_sizes(DS.split_exact(df, sizes, seed=7)).collect()}
    assert counts == {"train": 3000, "valid": 700, "test": 600, "corpus": 700}


def test_split_blocked_equals_block_sort(spark):
    df = spark.range(0, 1000).withColumnRenamed("id", "doc_id")
    sizes = (555, 100, 100)
    got = {r.doc_id: r.split for r in
           DS.split_blocked(df, sizes, seed=3, position="doc_id", block=64).collect()}
    h = F.md5(F.concat(F.lit("3:"), F.col("doc_id").cast("string")))
    want = _brute(df.withColumn("h", h).withColumn("blk", F.floor(F.col("doc_id") / 64)), sizes,
                  ["blk", "h", "doc_id"])
    assert got == want


def test_split_too_few_rows(spark):
    with pytest.raises(ValueError):
        DS.split_exact(spark.range(10).withColumnRenamed("id", "doc_id"), (5, 5, 5))


def test_pair_versions_and_quarantine(spark):
    v = spark.createDataFrame(
        [("p", "c1", "negative", 1, "old1"), ("p", "c1", "negative", 2, "old2"),
         ("p", "c1", "positive", 1, "new"), ("p", "c2", "negative", 1, "only old"),
         ("q", "c1", "positive", 1, "other project")],
        "project string, commit_id string, side string, turn long, code string")
    paired = {(r.project, r.commit_id): (r.neg_code, r.pos_code)
              for r in DS.pair_versions(v).collect()}
    assert paired[("p", "c1")] == ("old2", "new")
    assert paired[("q", "c1")] == (None, "other project")
    commits = spark.createDataFrame([("p", "c1", "d"), ("p", "c2", "d"), ("q", "c1", "d"), ("p", "c3", "d")],
                                    "project string, commit_id string, diff string")
    good, bad = DS.quarantine_failures(commits, DS.pair_versions(v))
    assert [(r.project, r.commit_id) for r in good.collect()] == [("p", "c1")]
    assert sorted((r.commit_id, r.reason) for r in bad.collect()) == [
        ("c1", "missing_negative"), ("c2", "missing_positive"), ("c3", "no_versions")]
    assert DS.join_commit_versions(commits, DS.pair_versions(v)).count() == 1


def test_parse_version_key(spark):
    df = spark.createDataFrame([("x_abc_positive.java",), ("x_abc.java",), ("x_a_negative.v2.txt",)], "f string")
    r = df.select(*DS.parse_version_key("f")).collect()
    assert [(x.commit_id, x.side) for x in r] == [("abc", "positive"), ("abc", None), ("a", "negative")]
