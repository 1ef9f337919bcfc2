import os

from pyspark.sql import functions as F

from diffsieve.sources import files as FS
from diffsieve.streaming.ingest import augment_stream, ingest_incremental

TRICKY = 'line1\n"quoted", comma, and a trailing backslash\\'


def _write_csv(path, rows):
    import csv
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(["commit_id", "extra", "diff", "message"])
        for r in rows:
            w.writerow(r)


def test_scan_commits_tricky_csv(spark, tmp):
    _write_csv(os.path.join(tmp, "my_proj.v2_commits.csv"),
               [("c1", "x", TRICKY, "m1"), ("c2", "y", "plain", "m2")])
    _write_csv(os.path.join(tmp, "other_commits.csv"), [("c3", "z", "d3", "m3")])
    rows = sorted(FS.scan_commits(spark, tmp).collect(), key=lambda r: r.commit_id)
    assert [(r.project, r.commit_id) for r in rows] == [("my_proj.v2", "c1"), ("my_proj.v2", "c2"),
                                                        ("other", "c3")]
    assert rows[0].diff == TRICKY


def test_scan_versions(spark, tmp):
    os.makedirs(os.path.join(tmp, "proj_a"))
    for name, body in [("x_c1_negative.java", "old"), ("x_c1_positive.java", ""), ("bad.java", "b")]:
        with open(os.path.join(tmp, "proj_a", name), "w") as f:
            f.write(body)
    rows = {r.file_name: r for r in FS.scan_versions(spark, tmp).collect()}
    assert rows["x_c1_positive.java"].code == ""  # zero-byte file kept
    assert rows["x_c1_negative.java"].side == "negative" and rows["x_c1_negative.java"].project == "proj_a"
    assert rows["bad.java"].commit_id is None


def test_write_round_trips(spark, tmp):
    df = spark.createDataFrame([("p_1", "c1", TRICKY, "m"), ("p.2", "c2", "d", "m")],
                               "project string, commit_id string, diff string, message string")
    FS.write_by_project(df, tmp + "/pq")
    back = spark.read.parquet(tmp + "/pq")
    assert sorted(map(tuple, back.select("project", "commit_id", "diff").collect())) == \
        sorted(map(tuple, df.select("project", "commit_id", "diff").collect()))
    FS.write_by_project(df, tmp + "/csv", fmt="csv")
    back = spark.read.options(**FS.CSV_OPTIONS).csv(tmp + "/csv")
    assert {r.diff for r in back.collect()} == {TRICKY, "d"}
    s = df.withColumn("split", F.lit("train"))
    FS.write_splits(s, tmp + "/splits")
    assert spark.read.parquet(tmp + "/splits").where("split = 'train'").count() == 2


def test_ingest_incremental_resumes(spark, tmp):
    src, out, ck = tmp + "/src", tmp + "/out", tmp + "/ck"
    os.makedirs(src)
    schema = "commit_id string, extra string, diff string, message string"
    from pyspark.sql.types import _parse_datatype_string
    st = _parse_datatype_string(schema)
    _write_csv(src + "/a_commits.csv", [("c1", "x", TRICKY, "m1")])
    assert ingest_incremental(spark, src, out, ck, schema=st) == 1
    _write_csv(src + "/b_commits.csv", [("c2", "x", "d", "m2"), ("c3", "x", "d", "m3")])
    assert ingest_incremental(spark, src, out, ck, schema=st) == 2
    assert ingest_incremental(spark, src, out, ck, schema=st) == 0
    back = spark.read.parquet(out)
    assert back.count() == 3 and {r.project for r in back.collect()} == {"a", "b"}


def test_augment_stream(spark, tmp):
    qdir = tmp + "/q"
    spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "query_id long, diff string").write.parquet(qdir)
    stream = spark.readStream.schema("query_id long, diff string").parquet(qdir)

    def lookup(batch):
        return batch.withColumn("n", F.length("diff"))
    augment_stream(stream, lookup, tmp + "/res", tmp + "/ck")
    res = spark.read.parquet(tmp + "/res")
    assert sorted(r.query_id for r in res.collect()) == [1, 2]


def test_augment_stream_with_hybrid_lookup(spark, tmp):
    from diffsieve.operators import lexical, retrieval
    from diffsieve.sources import tables as T
    c = T.corpus(spark, "/root/testdata/sf0.001")
    idx = lexical.build_index(c)
    qdir = tmp + "/queries"
    c.select(F.col("doc_id").alias("query_id"), "diff", "ast_seq", "v").write.parquet(qdir)
    stream = spark.readStream.schema(spark.read.parquet(qdir).schema).parquet(qdir)

    def lookup(batch):
        return retrieval.retrieve_hybrid(c, batch, index=idx).select("query_id", "doc_id", "same_key")
    augment_stream(stream, lookup, tmp + "/res", tmp + "/ck")
    got = {(r.query_id, r.doc_id) for r in spark.read.parquet(tmp + "/res").collect()}
    want = {(r.query_id, r.doc_id) for r in retrieval.retrieve_hybrid(
        c, c.select(F.col("doc_id").alias("query_id"), "diff", "ast_seq", "v"), index=idx).collect()}
    assert got == want
