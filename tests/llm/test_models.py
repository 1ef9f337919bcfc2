"""Toxicity, language and quality models: kernels against plain versions, held-out accuracy, odd rows."""

from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from diffsieve.llm import language_id, quality, toxicity

SF = "/root/testdata/sf0.01"


def plain_kernel(s, t):
    def phi(x):
        out = defaultdict(float)
        for c in combinations(range(len(x)), toxicity.P):
            out[tuple(x[i] for i in c)] += toxicity.DECAY ** (c[-1] - c[0] + 1)
        return out

    a, b = phi(s), phi(t)
    return sum(v * b[k] for k, v in a.items())


@pytest.mark.parametrize("s,t", [("idiot", "idxiot"), ("banana", "ananas"), ("ab", "abc"), ("scum", "scum")])
def test_kernel(s, t):
    code = lambda w: np.pad(np.array([ord(c) for c in w], np.uint32), (0, 10 - len(w)))[:, None]
    assert toxicity.subsequence_kernel(code(s), code(t))[0] == pytest.approx(plain_kernel(s, t), rel=1e-5)


def test_screening_bound_drops_nothing():
    marks = toxicity.Landmarks(["stupid", "worthless"])
    words = ["stupid", "stxupid", "worthles", "spit", "dust", "tedious", "thing", "s"]
    u = toxicity.units([" ".join(words)], toxicity._tables())
    got = {(k, int(i)): v for k, which, value in marks.pairs(u, np.arange(len(words))) for i, v in zip(which, value)}
    for k, m in enumerate(marks.words):
        for i, w in enumerate(words):
            norm = plain_kernel(w, w) * plain_kernel(m, m)
            similar = plain_kernel(w, m) / norm**0.5 if norm else 0
            assert got.get((k, i), 0) == pytest.approx(similar**toxicity.POWER if similar >= toxicity.FLOOR else 0, rel=1e-4)


def test_units_read_through_marks_and_blanks():
    u = toxicity.units(["An i.d-i0o*t! i d i o t Next.\nline", "", "é"], toxicity._tables())
    words = ["".join(map(chr, u.code[a:a + n])) for a, n in zip(u.start, u.size)]
    assert words == ["an", "idiot", "idiot", "next", "line", "é"]
    assert u.row.tolist() == [0, 0, 0, 0, 0, 2] and len(set(u.sentence.tolist())) == 4


def test_toxic_words_with_inserted_letters():
    rng = np.random.default_rng(0)
    clean = ["the ", "and ", "thing ", "other ", "reading ", "station. ", "of ", "house "]
    texts, y = [], []
    for k in range(300):
        words = list(rng.choice(clean, 60))
        if k % 3 == 0:
            words[rng.integers(60)] = rng.choice(["stupid ", "moron ", "worthless "])
        texts.append("".join(words))
        y.append(k % 3 == 0)
    model = toxicity.fit(texts, np.array(y))
    marks, tables = toxicity.Landmarks(model.landmarks), toxicity._tables()
    score = lambda t: 1 / (1 + np.exp(-(model.slope * toxicity.raw_scores(model, [t], marks, tables)[0] + model.offset)))
    for t in ("the stupid thing", "a st-up.id house", "the stuupid thing", "the w o r t h l e s s house", "so worthxless"):
        assert score(t) >= 0.7, t
    for t in ("", "the other station", "reading of the house and the thing"):
        assert score(t) < 0.3, t


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.op1_toxicity(spark, SF)
    rows = got.join(labels, "doc_id").collect()
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    clean = [r["predicted"] for r in rows if r["held_out"] and r["toxic"] == 0]
    assert np.mean(clean) < 0.05
    assert np.mean([r["predicted"] for r in rows if r["held_out"] and r["toxic"] == 1]) > 0.4  # a few learning rows only


def test_toxicity_odd_rows(edge, empty):
    model = toxicity.fit(["you stupid thing here"] * 9 + ["a nice thing here"] * 9, np.arange(18) < 9)
    out = toxicity.score(edge, model, into="toxic")
    assert out.columns == [*edge.columns, "toxic"] and out.where("toxic between 0 and 1").count() == edge.count()
    assert out.where("doc_id = 0").select("toxic").distinct().count() == 1
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.score(edge, toxicity.fit([], np.zeros(0))).where("score < 0.01").count() == edge.count()


def test_language_held_out(spark):
    got = language_id.op2_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.98
    assert np.mean([r["rejected"] for r in got]) < 0.02 and all(0 <= r["score"] <= 1 for r in got)


def test_kneser_ney_sums_to_one(spark):
    docs = spark.createDataFrame([("abra cadabra abra", "x"), ("abba babab", "x")], "text string, lang string")
    model = language_id.train(docs)
    alphabet = [0, *map(ord, "abcdr")]
    for context in ("abr", "  a", "bab"):
        c = [0 if x == " " else ord(x) for x in context]
        grams = np.array([(c[0] << 48) | (c[1] << 32) | (c[2] << 16) | a for a in alphabet], np.uint64)
        total = (2.0 ** model.log_probs(grams)).sum()
        assert 0.9 < total <= 1.001  # what is missing goes to characters never seen


def test_language_model_keeps_rare_grams(spark):
    rows = [("abcd " * 3000, "x")] * 150 + [("qzx", "x"), ("wkv", "x"), ("wkv", "x"), ("efgh", "y")]  # 2.25 million grams, three of them seen once
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    pack = lambda t: sum((0 if c == " " else ord(c)) << 16 * (3 - k) for k, c in enumerate(t))
    seen, new = 2.0 ** model.log_probs(np.array([pack(" qzx"), pack(" qzv")], np.uint64))[:, 0]
    assert seen > 0.3 and new < 0.1
    assert model.langs == ["x", "y"]


@pytest.mark.parametrize("part", [1, 20])
def test_language_model_in_parts(spark, monkeypatch, part):
    docs = spark.createDataFrame([("the house and the river", "en"), ("la maison et la rivière", "fr"), ("das haus", "de")], "text string, lang string")
    g, _ = language_id._grams(["the house in der rivière, maison zzz"], language_id._letters())
    whole = language_id.train(docs)
    monkeypatch.setattr(language_id, "PART", part)
    model = language_id.train(docs)
    assert len(whole.parts) == 1 < len(model.parts)
    assert (model.log_probs(g) == whole.log_probs(g)).all()
    scored = lambda m: language_id.identify(docs, m).orderBy("text").collect()
    assert scored(model) == scored(whole)


def test_language_rejects_and_odd_rows(spark, edge, empty):
    en = ["the house and the river are here with all the other things of the town " * 3] * 30
    fr = ["la maison et la rivière sont ici avec toutes les autres choses de la ville " * 3] * 30
    model = language_id.train(spark.createDataFrame([(t, "en") for t in en] + [(t, "fr") for t in fr] + [("zzz", None)], "text string, lang string"))
    assert model.langs == ["en", "fr"]
    got = {r["doc_id"]: r for r in language_id.identify(edge, model, prefix="m_").collect()}
    assert got[0]["m_pred"] == "en" and {got[i]["m_pred"] for i in (2, 3, 4, 6)} == {"und"} and got[2]["m_score"] == 0
    kept = language_id.accepted(edge)
    assert kept.columns == edge.columns and not {2, 3, 4, 6} & {r["doc_id"] for r in kept.collect()}
    assert language_id.accepted(empty).count() == 0
    nothing = language_id.identify(edge, language_id.train(edge.limit(0))).select("lid_pred").distinct().collect()
    assert [r[0] for r in nothing] == ["und"]


def test_quality_held_out(spark):
    got = quality.op6_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got if r["held_out"]]) > 0.95


def test_trees_against_single_rows():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] < 0)).astype(float)
    model = quality.fit(x, y)
    p = quality.predict(model, x)
    assert ((p > 0.5) == y).mean() > 0.95

    def one(row):
        total = model["base"]
        for feature, split, value in zip(model["feature"], model["split"], model["value"]):
            node = 0
            for _ in range(quality.DEPTH):
                node = 2 * node + 1 + int(row[feature[node]] > split[node])
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(p[:20], [one(r) for r in x[:20]])


def test_statistics():
    name = {k: i for i, k in enumerate(quality.FEATURES)}
    x = quality.features(pa.array(["The cat. The CAT!\nthe cat", None, "", "| | a a"]))
    assert x.shape == (4, len(quality.FEATURES)) and not np.isnan(x).any()
    assert x[0, name["word_len"]] == pytest.approx((3 + 4 + 3 + 4 + 3 + 3) / 6)
    assert x[0, name["caps_words"]] == pytest.approx(1 / 6) and x[0, name["log_lines"]] == pytest.approx(np.log(3))
    assert (x[1] == x[2]).all() and x[3, name["pipe"]] == pytest.approx(2 / 7) and x[3, name["twice_in_a_row"]] == 0.5


def test_quality_odd_rows(edge, empty):
    stats = quality.statistics(edge)
    got = quality.score(stats, quality.fit(np.zeros((0, len(quality.FEATURES)), np.float32), np.zeros(0)))
    assert got.count() == edge.count() and got.select("score").distinct().first()[0] == pytest.approx(0.5)
    assert quality.statistics(empty).count() == 0
    assert got.join(edge.select(F.col("doc_id").alias("d")).distinct(), F.col("id") == F.col("d")).count() == edge.count()


@pytest.mark.parametrize("spare", [1.5, 0.01])
def test_quality_sample_is_the_smallest_hashes(spark, monkeypatch, spare):
    from pyspark.sql import functions as F

    monkeypatch.setattr(quality, "SAMPLE", 40)
    monkeypatch.setattr(quality, "SPARE", spare)  # a limit that is too low is raised
    stats = spark.range(300).select("id", F.array(*[F.col("id").cast("float")] * len(quality.FEATURES)).alias("x")).where("id % 3 > 0")
    labels = spark.range(300).select(F.col("id").cast("int").alias("label_id"), F.expr("if(id % 7 = 0, null, id % 2)").alias("label"))
    x, _ = quality.sample(stats, labels, "label")
    best = [r["id"] for r in stats.where("id % 7 > 0").orderBy(F.xxhash64("id"), "id").limit(40).collect()]
    assert x[:, 0].astype(int).tolist() == best
    assert len(quality.sample(stats, labels.limit(0), "label")[0]) == 0
