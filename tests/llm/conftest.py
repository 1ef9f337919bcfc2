import pytest

#: Rows with nulls, empty and long texts, ties, repeated rows and further columns of likely names.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, size int, pii_row string, lid_pred string, key int, rank string"


def rows():
    long = " ".join(f"w{k % 977}x{k // 50}" for k in range(4000))
    base = "the quick brown fox jumps over the lazy dog while nine other animals watch from the green hill " * 3
    texts = [base, base, None, "", " \n\t ", "one", "!!! ... ---", long, base + "and then some more words follow here", "ünïcödé ßtraße naïve café " * 12, "x" * 5000]
    out = [(i, t, "en" if i % 2 else None, "s", None if t is None else len(t), 7, i, "r", "p", None, "q") for i, t in enumerate(texts)]
    return out + [out[0], out[0]]


@pytest.fixture
def edge(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def with_null_id(spark):
    return spark.createDataFrame(rows() + [(None, rows()[0][1], "en", None, 1, 7, 0, "r", "p", None, "q")], SCHEMA)
