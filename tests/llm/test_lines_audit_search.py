"""Operators 11 to 13 against plain versions, on small and awkward tables."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from brute import LOWER, key
from diffsieve.llm import lexical_tree, line_dedup, source_audit
from diffsieve.llm._words import NON_ALNUM, Words

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_lines(rows, min_docs, min_chars=1, keep_first=False):
    keyed = [(i, [(x, x.strip(WHITE).translate(LOWER)) for x in (t or "").split("\n")]) for i, t in rows]
    seen = collections.Counter(k for _, lines in keyed for k in {k for _, k in lines} if len(k) >= min_chars)
    first = {}
    for i, lines in keyed:
        for n, (_, k) in enumerate(lines):
            at = ((i is not None, i if i is not None else 0), n)
            first[k] = min(first.get(k, at), at)
    out = []
    for i, lines in keyed:
        kept = [x for n, (x, k) in enumerate(lines)
                if seen[k] < min_docs or (keep_first and first[k] == ((i is not None, i if i is not None else 0), n))]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=key)


def line_rows():
    rng = random.Random(5)
    common = ["  Footer LINE \t", "footer line", "ÄÖ line", "x" * 5000 + "A", "é", "\x0b\x0c "]
    rows = []
    for i in range(60):
        lines = [rng.choice(common) if rng.random() < 0.5 else f"own {i} {k}" for k in range(rng.randrange(1, 9))]
        rows.append((i, "\n".join(lines) + rng.choice(["", "\n", "\n\n"])))
    return rows + [(None, "footer line\nmine"), (None, None), (70, ""), (71, "\n"), rows[3], rows[3]]


@pytest.mark.parametrize("options", [{}, {"min_docs": 2}, {"min_docs": 3, "keep_first": True}, {"min_docs": 4, "min_chars": 2}])
@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_lines_match_plain_version(spark, options, sent):
    rows = line_rows()
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, key string, line int").repartition(5)
    got = line_dedup.dedup_lines(docs, sent_bytes=sent, **options)
    assert got.columns == ["id", "text", "n_lines", "n_dropped"]
    assert sorted((tuple(r) for r in got.collect()), key=key) == plain_lines(rows, **{"min_docs": 10, **options})


def test_full_filters_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "_bits", lambda n: line_dedup.MIN_BITS // 16)
    rows = [(i, "\n".join(f"line {i * 40 + k}" for k in range(400))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(7)
    got = line_dedup.dedup_lines(docs)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(plain_lines([(str(i), t) for i, t in rows], 10), key=key)


def test_merged_filter_knows_keys_of_two_tasks(spark):
    rows = [(i, f"shared {i % 50}\nown {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(9)
    bits, data = line_dedup._sent_filter(docs, 1).value
    lines = line_dedup.Lines(pa.array([f"shared {k}" for k in range(50)]))
    assert line_dedup.Bloom(bits, data).has(lines.hash).all()
    other = line_dedup.Lines(pa.array([f"own {k}" for k in range(100)]))
    assert line_dedup.Bloom(bits, data).has(other.hash).mean() < 0.1


def test_lines_of_awkward_tables(spark, edge, empty, with_null_id):
    assert line_dedup.dedup_lines(empty).count() == 0
    for df in (edge, with_null_id):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        got = line_dedup.dedup_lines(df, min_docs=2)
        assert sorted((tuple(r) for r in got.collect()), key=key) == plain_lines(rows, 2)


def plain_audit(rows, min_docs=10, top=10):
    rows = [tuple(x or "" for x in r) for r in rows]
    count, docs, groups = collections.Counter(), collections.Counter(), {(lang, s) for _, lang, s in rows}
    for text, lang, s in rows:
        terms = LETTERS.findall(text.translate(LOWER))
        docs.update((lang, t) for t in set(terms))
        count.update((lang, s, t) for t in terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), n in docs.items() if x == lang and n >= min_docs]
        names = sorted(s for x, s in groups if x == lang)
        whole = {s: sum(count[lang, s, t] for t in kept) + 2 * len(kept) for s in names}
        share = {s: {t: 1 + 10**9 * (count[lang, s, t] + 2) // whole[s] for t in kept} for s in names}
        both = {t: 1 + 10**9 * (sum(count[lang, s, t] for s in names) + 2) // (sum(whole.values()) - 2 * len(kept) * (len(names) - 1)) for t in kept}
        f = lambda p, q: (p - q) * (p - q) // (p + q)
        for s in names:
            pairs = [(sum(f(share[s][t], share[o][t]) for t in kept), o) for o in names if o != s]
            terms = [(f(share[s][t], both[t]), t) for t in kept if count[lang, s, t] and share[s][t] > both[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, v, rank))
    return sorted(out)


def audit_rows():
    rng = random.Random(3)
    words = ["a", "Be", "eightlet", "ninebytes", "sixteenletterszz", "seventeenlettersz", "großeÄnderung", "ü", "x" * 40, "Y" * 41, "日本語", "日本語テキスト処理", "d1g1t"]
    rows = [(" ".join(rng.choice(words[: 4 + k % 10]) for _ in range(rng.randrange(0, 30))), rng.choice(["en", "de", None, ""]), rng.choice(["s", "t", "u", None, "π"])) for k in range(150)]
    return rows + [(None, "en", "nothing"), ("", "xx", "lone"), ("123 --", "yy", "b"), ("", "yy", "c"), rows[0], rows[0]]


def test_audit_matches_plain_version(spark):
    rows = audit_rows()
    docs = spark.createDataFrame([(*r, 1, "g", 2) for r in rows], "text string, lang string, source string, gid int, item string, rank int").repartition(6)
    for options in ({}, {"min_docs": 1, "top": 3}, {"min_docs": 1000}):
        got = source_audit.audit_sources(docs, **options)
        assert sorted(tuple(r) for r in got.collect()) == plain_audit(rows, **options)


def test_audit_in_small_blocks_of_sources(spark, monkeypatch):
    rows = [(f"w{chr(97 + k % 7)} common w{chr(97 + k % 3)}", "en", f"s{k % 23}") for k in range(400)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    monkeypatch.setattr(source_audit, "SIDE", 4)
    monkeypatch.setattr(source_audit, "CELLS", 40)
    assert sorted(tuple(r) for r in source_audit.audit_sources(docs).collect()) == plain_audit(rows)


def test_audit_of_awkward_tables(spark, edge, empty):
    assert source_audit.audit_sources(empty).count() == 0
    rows = [(r.text, r.lang, r.source) for r in edge.collect()]
    assert sorted(tuple(r) for r in source_audit.audit_sources(edge, min_docs=1).collect()) == plain_audit(rows, 1)


def test_shares_of_counts_near_the_64_bit_limit():
    whole = 9_000_000_000_000_000
    count = np.array([0, 7, whole // 3, whole - 2], np.int64)
    assert source_audit.share(count, np.int64(whole)).tolist() == [1 + 10**9 * (int(c) + 2) // whole for c in count]


def test_radix_order_is_stable():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 3, 5000).astype(np.uint64) << np.uint64(50), rng.integers(0, 2**63, 5000, dtype=np.uint64) % np.uint64(9)
    assert (source_audit.radix_order([a, b]) == np.lexsort((b, a))).all()


def plain_search(docs, items, k):
    texts = [(i, ALNUM.findall((t or "").translate(LOWER))) for i, t in docs]
    texts = [(i, w, collections.Counter(w)) for i, w in texts if w]
    big_n, big_l = len(texts), sum(len(w) for _, w, _ in texts)
    df = collections.Counter(t for _, _, c in texts for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i].update(ALNUM.findall((t or "").translate(LOWER)))
    out = []
    for item, terms in asked.items():
        found = []
        for i, w, c in texts:
            m = 50 + 50 * len(w) * big_n // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                found.append((-s, i is not None, i))
        found.sort(key=lambda x: (x[0], x[1], x[2] if x[1] else 0))
        out += [(item, r, x[2], -x[0]) for r, x in enumerate(found[:k], 1)]
    return sorted(out, key=key)


def search_rows():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(120)] + ["ünï", "x" * 30, "x" * 31]
    weights = [1 / (k + 1) for k in range(len(words))]
    texts = [" ".join(rng.choices(words, weights, k=rng.randrange(0, 60))) for _ in range(900)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(2000 + i, texts[7]) for i in range(400)] + [(5000, None), (None, texts[8]), (None, texts[8])]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for i in range(25)] + [(100, None), (101, "absent"), (102, texts[7].upper()), (None, "w3 w4"), (0, "w50")]
    return docs, items


@pytest.mark.parametrize("sizes, postings, block", [((256, 2048, 16384), 2_000_000, 1 << 19), ((2, 5, 17), 3000, 40), ((1,), 500, 1000)])
def test_search_matches_plain_version(spark, monkeypatch, sizes, postings, block):
    monkeypatch.setattr(lexical_tree, "SIZES", sizes)
    monkeypatch.setattr(lexical_tree, "TREE_POSTINGS", postings)
    docs, items = search_rows()
    d = spark.createDataFrame([(*r, "b", 1) for r in docs], "doc_id long, text string, item string, n int").repartition(3)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = lexical_tree.search(d, q, k=10, block_terms=block)
    assert sorted((tuple(r) for r in got.collect()), key=key) == plain_search(docs, items, 10)


def test_search_of_awkward_tables(spark, edge, empty, with_null_id):
    items = spark.createDataFrame([(1, "the quick fox"), (2, "w1x0 w2x0 one")], "item_id int, text string")
    assert lexical_tree.search(empty, items).count() == 0
    assert lexical_tree.search(edge, items.limit(0)).count() == 0
    rows = [(r.doc_id, r.text) for r in with_null_id.collect()]
    got = lexical_tree.search(with_null_id, items)
    assert sorted((tuple(r) for r in got.collect()), key=key) == plain_search(rows, [tuple(r) for r in items.collect()], 50)


def test_bounds_hold_for_every_text_below():
    rng = np.random.default_rng(4)
    size = rng.integers(0, 9, 300)
    place = np.concatenate([np.sort(rng.choice(30, s, replace=False)) for s in size])
    off = np.r_[0, np.cumsum(size)]
    tree = lexical_tree.Tree(off, place, rng.integers(1, 6, len(place)), rng.integers(50, 200, 300), np.arange(300))
    terms, weight = np.arange(0, 30, 3), np.arange(1, 11) * 100
    exact = tree.levels[0].bounds(terms, weight, 0, 300)
    first = np.arange(300)
    for level in tree.levels[1:]:
        first = np.repeat(np.arange(level.nodes), np.diff(level.child))[first]
        assert (level.bounds(terms, weight, 0, level.nodes)[first] >= exact).all()


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(Words, "_hash", lambda self: (self.ends - self.starts).astype(np.uint64))
    v = lexical_tree.Vocabulary(pa.array(["abc", "abd", "longerthaneight1", "longerthaneight2"]))
    w = Words(pa.array(["abd abc abe longerthaneight2 xyz"]), NON_ALNUM)
    at, number = v.find(w)
    assert sorted(zip(at.tolist(), number.tolist())) == [(0, 1), (1, 0), (3, 3)]


def test_queries_digest_their_operators(spark):
    from diffsieve.llm._io import read

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in read(spark, sf, "documents").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.op11_line_dedup(spark, sf).collect()}
    assert got == {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in plain_lines(docs, 10)}
