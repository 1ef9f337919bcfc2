"""Substring dedup, Jaccard join and decontamination against plain versions."""

import random

import duckdb
import numpy as np
import pytest

import brute
from diffsieve.llm import decontamination, jaccard_join, substring_dedup

SF = "/root/testdata/sf0.001"


def table(name, columns):
    return duckdb.connect().execute(f"select {columns} from read_parquet('{SF}/{name}.parquet')").fetchall()


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def same(got, expected):
    assert sorted(got, key=brute.key) == sorted(expected, key=brute.key)


def test_substrings_of_documents(spark):
    got = substring_dedup.op3_substring_dedup(spark, SF).collect()
    import hashlib

    same([tuple(r) for r in got], [(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute.substrings(table("documents", "doc_id, text"))])


@pytest.mark.parametrize("width", [1, 4, 20])
def test_substrings_of_odd_rows(with_null_id, width):
    got = substring_dedup.dedup_substrings(with_null_id, width=width).collect()
    same([tuple(r) for r in got], brute.substrings(pairs(with_null_id), width))


def test_substrings_within_one_text_and_shared_ids(spark):
    rng = random.Random(1)
    passage = " ".join(f"p{k}" for k in range(40))
    noise = lambda n: " ".join(str(rng.random()) for _ in range(n))
    rows = [(1, f"{noise(9)} {passage} {noise(7)} {passage}"), (1, noise(120)), (2, noise(3) + " " + passage), (3, " ".join(passage.split()[:34]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same([tuple(r) for r in substring_dedup.dedup_substrings(df).collect()], brute.substrings(rows))


def test_covers_are_difference_covers():
    for period, cover in substring_dedup.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_jaccard_of_documents(spark):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.op5_ngram_jaccard_join(spark, SF).collect()}
    assert got == brute.jaccard(table("documents", "doc_id, text"))


def test_jaccard_chains_groups_and_a_common_passage(spark):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(10**6)}"
    chain, rows = [word() for _ in range(80)], []
    for k in range(30):  # a chain: each differs from the one before a little, ends differ wholly
        rows.append((100 + k, " ".join(chain)))
        chain = chain[3:] + [word() for _ in range(3)]
    base = [word() for _ in range(120)]
    for k in range(60):  # near copies, some too far from each other
        own = list(base)
        for _ in range(rng.randrange(5)):
            own[rng.randrange(120)] = word()
        rows.append((300 + k, " ".join(own)))
    passage = " ".join(word() for _ in range(60))
    rows += [(500 + k, passage + " " + " ".join(word() for _ in range(rng.randrange(3, 60)))) for k in range(60)]
    rows += [(600 + k, " ".join(["a", "B", "c"][:k])) for k in range(4)] + [(610, "A b C"), (611, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similarity_classes(df).collect()}
    assert got == brute.jaccard(rows)


@pytest.mark.parametrize("turns, cell", [(0, 4096), (0, 7), (2, 7)])
def test_jaccard_in_cells_of_columns(spark, monkeypatch, turns, cell):
    monkeypatch.setattr(jaccard_join, "TURNS", turns)
    monkeypatch.setattr(jaccard_join, "CELL", cell)
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for g in range(3):
        base = [word() for _ in range(90)]
        for k in range(45):  # groups whose members are linked with some of the others only
            own = list(base)
            for _ in range(rng.randrange(1, 4)):
                own[rng.randrange(90)] = word()
            rows.append((g * 100 + k, " ".join(own)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.jaccard(rows)


def test_near_rounds_leave_few_pairs(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for k in range(500):
        own = list(base)
        for _ in range(rng.randrange(2, 5)):
            own[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
        rows.append((k, " ".join(own)))
    seen = []
    plain = jaccard_join.links
    monkeypatch.setattr(jaccard_join, "links", lambda pairs, *a: (seen.append(pairs.count()), plain(pairs, *a))[1])
    jaccard_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(seen) < 20 * len(rows)  # all pairs are 125,000


def test_near_copies_are_named_by_one_column():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(300) > 0.1], rng.integers(0, 2**64, 30, dtype=np.uint64)])) for _ in range(8)]
    sets += [base[:1], base[:3], np.zeros(0, np.uint64)]  # prefixes of one column, and none
    key, off = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
    head, take = jaccard_join._heads(key, off, 80).view(np.int64), jaccard_join._prefix(np.diff(off), 80)
    once = 0
    for a in range(len(sets) - 1):
        for b in range(a):
            shared = np.intersect1d(sets[a][:take[a]], sets[b][:take[b]]).view(np.int64)
            rows = len(shared)
            own, named = jaccard_join._named_here(shared, np.repeat(head[a:a + 1], rows, 0), np.repeat(head[b:b + 1], rows, 0))
            assert len(own) == (1 if named.any() else rows)
            once += rows > 1 and len(own) == 1
    assert once == 8 * 7 // 2


def test_jaccard_of_odd_rows(with_null_id, empty):
    got = jaccard_join.similarity_classes(with_null_id).collect()
    plain = brute.jaccard([x for x in pairs(with_null_id) if x[0] is not None])
    assert len(got) == with_null_id.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == plain[r["doc_id"]]
    kept = jaccard_join.one_of_each(with_null_id)
    assert kept.columns == with_null_id.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted({c for _, c in plain.values()})
    assert jaccard_join.one_of_each(empty).count() == 0


def test_contamination_of_documents(spark):
    got = decontamination.op7_benchmark_decontamination(spark, SF).collect()
    same([tuple(r) for r in got], brute.contamination(table("documents", "doc_id, text"), table("benchmark", "item_id, text")))


@pytest.mark.parametrize("windows", [1 << 20, 10])
def test_contamination_of_odd_rows(spark, with_null_id, empty, monkeypatch, windows):
    monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", windows)
    items = [(1, "Quick, BROWN fox!"), (2, "the quick brown fox jumps over the lazy dog while nine other animals watch"), (2, "one"), (3, None), (4, ""), (5, "never seen words"),
             (6, "ünïcödé ßtraße"), (7, "hill the quick")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(with_null_id, bench).collect()
    expected = brute.contamination(pairs(with_null_id), items)
    same([tuple(r) for r in got], expected)
    kept = decontamination.clean_rows(with_null_id, bench)
    assert kept.columns == with_null_id.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((x[0] for x in expected if not x[5]), key=str)
    assert decontamination.clean_rows(with_null_id, bench.limit(0)).count() == with_null_id.count()
    assert decontamination.clean_rows(empty, bench).count() == 0


def test_shared_ids_are_judged_by_their_own_text(spark):
    rows = [(1, "alpha beta gamma delta"), (1, "something else entirely here"), (1, "alpha beta gamma delta")]
    bench = [(9, "beta gamma")]
    got = decontamination.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    same([tuple(r) for r in got], brute.contamination(rows, bench))


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "zero red green blue"), (2, "red x green y blue"), (3, "red a b c d e f g green blue")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "red green blue")], "item_id long, text string")
    got = {(r["doc_id"], r["item"], r["displaced"]) for r in decontamination.proximity_matches(docs, bench, slop=2).collect()}
    assert (1, "5", 0) in got and (2, "5", 2) in got
    assert not any(i == 3 for i, _, d in got if d <= 2)
