from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from diffsieve.operators import edits as ED
from diffsieve.plans.diffjob import diff_versions

# FIXTURES.md 2.1: old, new, rendered, removed, added
GOLDEN = [
    ("a b c d e", "a b e d f", "a b -c -d e +d +f ", [2, 3], [3, 4]),
    ("", "", "", [], []),
    ("a b c", "a b c", "a b c ", [], []),
    ("", "a b", "+a +b ", [], [0, 1]),
    ("a b", "", "-a -b ", [0, 1], []),
    ("a b", "b a", "-a b +a ", [0], [1]),
    ("a b c", "x y z", "-a -b -c +x +y +z ", [0, 1, 2], [0, 1, 2]),
    ("a b c a b b a", "c b a b a c", "-a -b c -a b +a b a +c ", [0, 1, 3], [2, 5]),
    ("c c", "b c b", "-c +b c +b ", [0], [0, 2]),
]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_kernel_golden():
    for old, new, rendered, removed, added in GOLDEN:
        a, b = old.split(), new.split()
        ops = ED.shortest_edit(a, b)
        assert ED.render(ops, a, b) == rendered
        assert [i for op, i, _ in ops if op == "-"] == removed
        assert [j for op, _, j in ops if op == "+"] == added


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_kernel_properties(a, b):
    ops = ED.shortest_edit(a, b)
    assert [a[i] for op, i, _ in ops if op != "+"] == a
    assert [b[j] for op, _, j in ops if op != "-"] == b
    k = lcs(a, b)
    assert sum(op == "=" for op, _, _ in ops) == k
    assert sum(op != "=" for op, _, _ in ops) == len(a) + len(b) - 2 * k


def test_edits_table_golden(spark):
    rows = [(i, o.split(), n.split()) for i, (o, n, *_rest) in enumerate(GOLDEN)]
    pairs = spark.createDataFrame(rows, "pair_id long, old_seq array<string>, new_seq array<string>")
    edits = ED.edit_script(pairs)
    rendered = {r.pair_id: r.ast_seq for r in ED.render_edit_script(edits, pairs).collect()}
    pos = {r.pair_id: (r.removed, r.added) for r in ED.changed_positions(edits).collect()}
    for i, (_o, _n, text, removed, added) in enumerate(GOLDEN):
        assert rendered[i] == text
        if text:
            assert pos[i] == (removed, added)
    summary = {r.pair_id: (r.kept, r.removed, r.added) for r in ED.edit_summary(edits).collect()}
    assert summary[0] == (3, 2, 2)


def test_replay_on_pages(spark):
    from diffsieve.sources import tables as T
    from diffsieve.functions.structure import structure_seq
    pairs = T.page_pairs(spark, "/root/testdata/sf0.001").select(
        "pair_id", structure_seq("old_html").alias("old_seq"), structure_seq("new_html").alias("new_seq"))
    r = ED.replay(ED.edit_script(pairs)).join(
        pairs.select("pair_id", F.col("old_seq").alias("o"), F.col("new_seq").alias("n")), "pair_id")
    bad = r.where((F.col("old_seq") != F.col("o")) | (F.col("new_seq") != F.col("n"))).count()
    assert bad == 0 and r.count() == pairs.count()


def test_diff_versions_user_dialect(spark):
    def words(t):
        return t.split()
    pairs = spark.createDataFrame([(1, "a b c d e", "a b e d f", "m1")],
                                  "pair_id long, neg_code string, pos_code string, message string")
    out = diff_versions(pairs, dialect=words).collect()
    assert out[0].ast_seq == "a b -c -d e +d +f " and out[0].message == "m1"


def test_keep_list(spark):
    from diffsieve.functions.structure import structure_seq
    df = spark.createDataFrame([("<html><body><p>x</p><div></div></body></html>",)], "h string")
    r = df.select(structure_seq("h", keep=["p", "div"]).alias("s")).first().s
    assert r == ["p", "div"]


def test_max_edits_quarantine(spark):
    pairs = spark.createDataFrame([(1, list("abc"), list("abd")), (2, list("abcdef"), list("uvwxyz"))],
                                  "pair_id long, old_seq array<string>, new_seq array<string>")
    good, bad = ED.edit_quarantine(ED.edit_script(pairs, max_edits=3))
    assert [r.pair_id for r in bad.collect()] == [2]
    assert {r.pair_id for r in good.collect()} == {1}
