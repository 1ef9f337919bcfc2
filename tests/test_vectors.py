from diffsieve.functions.vectors import check_width, fuse_channel_sequences, parse_vector_text

# FIXTURES.md 2.4
CASES = [
    ("[[0.1, 0.2], [0.3,\n 0.4]]", [0.1, 0.2, 0.3, 0.4], False),
    ("0.5,1e-05", [0.5, 1e-05], False),
    (None, [0.0, 0.0], False),
    ("  ", [0.0, 0.0], False),
    ("nan", [0.0, 0.0], False),
    ("None", [0.0, 0.0], False),
    ("[0.1],[0.2]", [0.1, 0.2], False),
    ("[1., .5]", [1.0, 0.5], False),
    ("tensor([1.0])", None, True),
]


def test_vector_text(spark):
    df = spark.createDataFrame([(t,) for t, *_ in CASES], "t string")
    v, e = parse_vector_text("t", 2)
    got = df.select(v.alias("v"), e.alias("e")).collect()
    for (text, want, err), r in zip(CASES, got):
        assert r.e == err, text
        if want is None:
            assert r.v is None
        else:
            assert [round(x, 6) for x in r.v] == want, text


def test_width_check(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "v array<double>")
    try:
        check_width(df, "v")
        raise AssertionError("expected ValueError")
    except ValueError:
        pass


def test_fuse_sequences(spark):
    df = spark.createDataFrame([([[1.0], [2.0], [3.0]], [[4.0], [5.0]])], "a array<array<double>>, b array<array<double>>")
    r = df.select(fuse_channel_sequences("a", "b").alias("f")).first().f
    assert r == [[1.0, 4.0], [2.0, 5.0]]
