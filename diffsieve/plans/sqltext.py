"""SQL fragments (DuckDB dialect) that mirror the library's definitions.

They are used by ``oracle_sql()`` to check every registered query against an
independent engine. Each fragment is the plain-SQL statement of a definition in the
library; nothing here runs on Spark.
"""

TOKEN_RE = r"[\p{L}\p{N}_]+"
SCALE = "4294967296.0"


def tok(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '{TOKEN_RE}', 0)"


def pk(x: str) -> str:
    return (f"(CASE WHEN instr(coalesce({x}, ''), '+++ b') = 0 THEN '' ELSE "
            f"replace(substr({x}, instr({x}, '+++ b')), chr(10), '') END)")


COMMITS = ("SELECT doc_id, source AS project, md5(CAST(doc_id AS VARCHAR)) AS commit_id, "
           "'diff --git a b' || chr(10) || '+++ b/' || source || chr(10) || text AS diff, "
           "lang AS message FROM documents")

CORPUS = (f"SELECT c.doc_id, c.project, c.diff, '' AS ast_seq, c.message, e.embedding AS v "
          f"FROM ({COMMITS}) c JOIN embeddings e ON e.vec_id = c.doc_id")

BENCH_QUERIES = "SELECT item_id AS query_id, text AS diff, '' AS ast_seq FROM benchmark"

# self matches, foreign texts with a second text column, and texts without any hit
MIXED_QUERIES = (
    "SELECT item_id AS query_id, text AS diff, 'src1 the' AS ast_seq FROM benchmark "
    f"UNION ALL SELECT 1000000000 + k.doc_id, k.diff, k.message FROM ({COMMITS}) k "
    "JOIN labels l ON l.doc_id = k.doc_id WHERE l.toxic = 1 "
    "UNION ALL SELECT 2000000000 + n_nationkey, 'qq' || n_nationkey || 'xx', '' FROM nation")

VERSIONS = ("SELECT conv_id AS commit_id, CASE role WHEN 'user' THEN 'negative' "
            "WHEN 'assistant' THEN 'positive' END AS side, turn, text AS code, "
            "'x_' || CAST(conv_id AS VARCHAR) || '_' || CASE role WHEN 'user' THEN 'negative' "
            "WHEN 'assistant' THEN 'positive' END || '.txt' AS file_name "
            "FROM conversations WHERE role IN ('user', 'assistant')")

PAGE_PAIRS = ("SELECT a.page_id AS pair_id, a.html AS old_html, b.html AS new_html "
              "FROM pages a JOIN pages b ON b.page_id - 1 = a.page_id")


def bm25_ctes(corpus: str = "c", queries: str = "q") -> str:
    """CTEs ``dt, st, post, dfs, qt, s`` over CTEs named ``corpus`` (doc_id, diff) and
    ``queries`` (query_id, diff, ast_seq). ``s(query_id, doc_id, fx)`` holds BM25 in
    units of 2**-32 (``SCALE``), summed as integers like the Spark operator."""
    return f"""
dt AS (SELECT doc_id, {tok('diff')} AS toks FROM {corpus}),
st AS (SELECT count(*) FILTER (WHERE len(toks) > 0) AS n,
              sum(len(toks)) / count(*) FILTER (WHERE len(toks) > 0) AS avgdl,
              count(*) AS n_rows, min(doc_id) AS min_key FROM dt),
post AS (SELECT term, doc_id, dl, count(*) AS tf
         FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM dt)
         GROUP BY term, doc_id, dl),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
qt AS (SELECT query_id, term, count(*) AS qtf
       FROM (SELECT query_id, unnest(list_concat({tok('diff')}, {tok('ast_seq')})) AS term
             FROM {queries})
       GROUP BY query_id, term),
s AS (SELECT qt.query_id, post.doc_id,
             sum(CAST(floor(qt.qtf * ln(1 + (st.n - dfs.df + 0.5) / (dfs.df + 0.5))
                 * (post.tf / (post.tf + 1.2 * (0.25 + 0.75 * post.dl / st.avgdl)) * {SCALE})
                 + 0.5) AS BIGINT)) AS fx
      FROM qt JOIN dfs USING (term) JOIN post USING (term) CROSS JOIN st
      GROUP BY qt.query_id, post.doc_id)"""


def pick_ctes(ranked: str, fallback: bool, corpus: str = "c", queries: str = "q") -> str:
    """CTEs ``top, p, x`` choosing rank 1 or 2 per query from ``ranked(query_id,
    doc_id, score, rk)`` with the self-match rule (and the row-0 fallback)."""
    if fallback:
        ids = ("coalesce(id1, (SELECT min(doc_id) FROM {c})) AS id1, "
               "coalesce(id2, (SELECT min(doc_id) FROM {c})) AS id2").format(c=corpus)
    else:
        ids = "id1, id2"
    return f"""
top AS (SELECT query_id,
               max(CASE WHEN rk = 1 THEN doc_id END) AS id1,
               max(CASE WHEN rk = 2 THEN doc_id END) AS id2,
               max(CASE WHEN rk = 1 THEN score END) AS s1,
               max(CASE WHEN rk = 2 THEN score END) AS s2
        FROM {ranked} WHERE rk <= 2 GROUP BY query_id),
p AS (SELECT {queries}.query_id, {ids}, id1 IS NULL AS fb1, id2 IS NULL AS fb2, s1, s2,
             {pk(queries + '.diff')} AS qkey
      FROM {queries} LEFT JOIN top USING (query_id)),
x AS (SELECT p.*, coalesce({pk('d.diff')} = qkey AND qkey <> '', false) AS same_key
      FROM p LEFT JOIN {corpus} d ON d.doc_id = p.id1)"""


def picked_cols() -> str:
    return ("query_id, CASE WHEN same_key THEN id2 ELSE id1 END AS doc_id, id1 AS rank1_id, "
            "CASE WHEN same_key THEN s2 ELSE s1 END AS score0, same_key, "
            "CASE WHEN same_key THEN fb2 ELSE fb1 END AS is_fallback")


def cos(a: str, b: str) -> str:
    da, db = f"CAST({a} AS DOUBLE[])", f"CAST({b} AS DOUBLE[])"
    na, nb = f"sqrt(list_dot_product({da}, {da}))", f"sqrt(list_dot_product({db}, {db}))"
    return (f"(CASE WHEN {na} = 0 OR {nb} = 0 OR {na} IS NULL OR {nb} IS NULL THEN 0.0 "
            f"ELSE list_dot_product({da}, {db}) / ({na} * {nb}) END)")


def tags(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '<([a-z][a-z0-9]*)', 1)"


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two lists (row-by-row DP)."""
    return (f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE "
            f"list_reduce({a}, lambda row, x: list_reduce(range(1, len({b}) + 1), "
            f"lambda acc, j: list_append(acc, CASE WHEN x = {b}[j] THEN row[j] + 1 "
            f"ELSE greatest(row[j + 1], acc[j]) END), [0]), "
            f"list_transform(range(len({b}) + 1), lambda i: 0))[len({b}) + 1] END)")


PAGE_SEQ_PAIRS = (f"SELECT pair_id, {tags('old_html')} AS a, {tags('new_html')} AS b "
                  f"FROM ({PAGE_PAIRS})")


def hash_vec(text: str, key: str, source: str, dim: int = 64) -> str:
    """Dense L2-normalised hashed token counts per row, as a rounded double list."""
    return f"""
SELECT k.{key}, list(round(CAST(CAST(coalesce(n.n, 0) / nr.nr AS FLOAT) AS DOUBLE), 6)
                  ORDER BY r.i) AS v
FROM (SELECT {key} FROM {source}) k CROSS JOIN (SELECT range AS i FROM range({dim})) r
LEFT JOIN (SELECT {key}, b, count(*) AS n FROM (
             SELECT {key}, CAST(CAST('0x' || substr(md5(term), 1, 6) AS BIGINT) % {dim} AS INTEGER) AS b
             FROM (SELECT {key}, unnest({tok(text)}) AS term FROM {source}))
           GROUP BY {key}, b) n ON n.{key} = k.{key} AND n.b = r.i
LEFT JOIN (SELECT {key}, sqrt(sum(n * n)) AS nr FROM (
             SELECT {key}, count(*) AS n FROM (
               SELECT {key}, CAST(CAST('0x' || substr(md5(term), 1, 6) AS BIGINT) % {dim} AS INTEGER) AS b
               FROM (SELECT {key}, unnest({tok(text)}) AS term FROM {source}))
             GROUP BY {key}, b) GROUP BY {key}) nr ON nr.{key} = k.{key}
GROUP BY k.{key}"""


# ------------------------------------------------------------ edit scripts

def snake(x, y):
    """Position reached from (x, y) along equal tokens of lists ``a``, ``b`` (lengths n, m)."""
    L = f"greatest(0, least(n - ({x}), m - ({y})))"
    return (f"(({x}) + coalesce(list_position(list_transform(range(0, {L}), "
            f"lambda i: a[({x}) + i + 1] = b[({y}) + i + 1]), false) - 1, {L}))")


def edits_sql(pairs_sql):
    """The edits table ``(pair_id, pos, op, token, old_idx, new_idx)`` of the pairs
    ``(pair_id, a, b)``: the same greedy diagonal search and tie rule as the Spark
    kernel, as a recursive CTE over the edit depth (frontier as a list of segments),
    then a back-trace over parent links."""
    return f"""
WITH RECURSIVE
pp AS (SELECT pair_id, a, b, len(a) AS n, len(b) AS m FROM ({pairs_sql})),
s0 AS (SELECT pair_id, a, b, n, m, {snake('0', '0')} AS x0 FROM pp),
it(pair_id, a, b, n, m, d, segs, front, win) AS (
  SELECT pair_id, a, b, n, m, 0,
         [{{'kind': 0, 'sx': 0, 'sy': 0, 'ex': x0, 'ey': x0, 'par': 0}}],
         [1],
         CASE WHEN x0 = n AND x0 = m THEN {{'kind': 0, 'sx': 0, 'sy': 0, 'ex': x0, 'ey': x0, 'par': 0}} END
  FROM s0
  UNION ALL
  SELECT pair_id, a, b, n, m, d, list_concat(segs, list_transform(c3, lambda c: c.ch)),
         list_transform(range(1, len(c3) + 1), lambda i: len(segs) + i),
         CASE WHEN fk IS NULL THEN NULL
              WHEN c3[fk].ins_fin THEN c3[fk].ins ELSE c3[fk].rem END
  FROM (
    SELECT *, list_position(list_transform(c3, lambda c: c.ins_fin OR c.rem_fin), true) AS fk
    FROM (
      SELECT pair_id, a, b, n, m, d, segs, front,
             list_transform(c2, lambda c: {{
               'ins': c.ins, 'rem': c.rem,
               'ins_fin': coalesce(c.ins.ex = n AND c.ins.ey = m, false),
               'rem_fin': coalesce(c.rem.ex = n AND c.rem.ey = m, false),
               'ch': CASE WHEN c.ins IS NULL THEN c.rem WHEN c.rem IS NULL THEN c.ins
                          WHEN c.rem.ex > c.ins.ex THEN c.rem ELSE c.ins END}}) AS c3
      FROM (
        SELECT pair_id, a, b, n, m, d, segs, front,
               list_transform(c1, lambda c: {{
                 'ins': CASE WHEN c.ins IS NULL THEN NULL ELSE {{
                    'kind': 1, 'sx': c.ins.sx, 'sy': c.ins.sy,
                    'ex': {snake('c.ins.sx', 'c.ins.sy')},
                    'ey': {snake('c.ins.sx', 'c.ins.sy')} - c.ins.sx + c.ins.sy,
                    'par': c.ins.par}} END,
                 'rem': CASE WHEN c.rem IS NULL THEN NULL ELSE {{
                    'kind': 2, 'sx': c.rem.sx, 'sy': c.rem.sy,
                    'ex': {snake('c.rem.sx', 'c.rem.sy')},
                    'ey': {snake('c.rem.sx', 'c.rem.sy')} - c.rem.sx + c.rem.sy,
                    'par': c.rem.par}} END}}) AS c2
        FROM (
          SELECT pair_id, a, b, n, m, d + 1 AS d, segs, front,
                 list_transform(range(d + 1, -(d + 1) - 1, -2), lambda k: {{
                   'ins': CASE WHEN k + 1 <= d THEN {{
                      'sx': segs[front[(d - (k + 1)) // 2 + 1]].ex,
                      'sy': segs[front[(d - (k + 1)) // 2 + 1]].ey + 1,
                      'par': front[(d - (k + 1)) // 2 + 1]}} END,
                   'rem': CASE WHEN k - 1 >= -d THEN {{
                      'sx': segs[front[(d - (k - 1)) // 2 + 1]].ex + 1,
                      'sy': segs[front[(d - (k - 1)) // 2 + 1]].ey,
                      'par': front[(d - (k - 1)) // 2 + 1]}} END}}) AS c1
          FROM it WHERE win IS NULL
        ) t1
      ) t2
    ) t3
  ) t4
),
fin AS (SELECT pair_id, a, b, segs, win FROM it WHERE win IS NOT NULL),
bt(pair_id, a, b, segs, seg, lvl) AS (
  SELECT pair_id, a, b, segs, win, 0 FROM fin
  UNION ALL
  SELECT pair_id, a, b, segs, segs[seg.par], lvl + 1 FROM bt WHERE seg.par > 0
),
ops AS (
  SELECT pair_id, lvl, 0 AS t,
         CASE seg.kind WHEN 1 THEN '+' ELSE '-' END AS op,
         CASE seg.kind WHEN 1 THEN b[seg.sy] ELSE a[seg.sx] END AS token,
         CASE seg.kind WHEN 2 THEN seg.sx - 1 END AS old_idx,
         CASE seg.kind WHEN 1 THEN seg.sy - 1 END AS new_idx
  FROM bt WHERE seg.kind > 0
  UNION ALL
  SELECT pair_id, lvl, t + 1 AS t, '=' AS op, a[seg.sx + t + 1] AS token,
         seg.sx + t AS old_idx, seg.sy + t AS new_idx
  FROM (SELECT pair_id, lvl, seg, a, unnest(range(0, seg.ex - seg.sx)) AS t FROM bt)
)
SELECT pair_id,
       CAST(row_number() OVER (PARTITION BY pair_id ORDER BY lvl DESC, t) - 1 AS INTEGER) AS pos,
       op, token, CAST(old_idx AS INTEGER) AS old_idx, CAST(new_idx AS INTEGER) AS new_idx
FROM ops"""


def rendered_sql(pairs_sql):
    """``(pair_id, ast_seq)``: the script text of every pair, '' for a pair without rows."""
    return f"""
WITH e AS ({edits_sql(pairs_sql)})
SELECT p.pair_id, coalesce(string_agg(CASE e.op WHEN '=' THEN e.token ELSE e.op || e.token END || ' ',
                                      '' ORDER BY e.pos), '') AS ast_seq
FROM ({pairs_sql}) p LEFT JOIN e USING (pair_id) GROUP BY p.pair_id"""
