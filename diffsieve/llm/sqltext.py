"""DuckDB statements of the queries that SQL can express, over whole tables."""

from __future__ import annotations

_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 34], ' ')) AS h
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
dup AS (SELECT doc_id, s FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, s + k AS p FROM dup, (SELECT unnest(range(0, 35)) AS k)),
pos AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
         FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

NGRAM_JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(w[s:s + 4], ' ')) AS h
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, b AS o FROM edges UNION SELECT r.doc_id, edges.b FROM reach r JOIN edges ON edges.a = r.o)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.o, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(o) AS o FROM reach GROUP BY doc_id) m USING (doc_id)"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS size, md5(array_to_string(w[s:s + least(len(w), 13) - 1], ' ')) AS h
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, s, size, md5(array_to_string(w[s:s + size - 1], ' ')) AS h
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s
             FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)),
hit AS (SELECT doc_id, s, dw.size, item_id FROM dw JOIN bw USING (h, size)),
pos AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(s, s + size)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS items
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AND 20 * coalesce(pos.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)"""

_KEY = "translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_DEDUP = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
l AS (SELECT doc_id, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS n FROM d),
k AS (SELECT doc_id, n, line, {_KEY} AS key FROM l),
gone AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS t, count(*) AS c FROM k ANTI JOIN gone USING (key) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(x) AS BIGINT) AS n_lines, CAST(len(x) - coalesce(c, 0) AS BIGINT) AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

SOURCE_AUDIT = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all({_LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT doc_id, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 10),
v AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS n FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY t.lang, source, term),
gn AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY lang, source),
p AS (SELECT grp.lang, grp.source, kept.term, coalesce(c.n, 0) AS n,
             CAST(1 + 1000000000 * (coalesce(c.n, 0) + 2) // (coalesce(gn.n, 0) + 2 * v.v) AS BIGINT) AS p,
             CAST(1 + 1000000000 * (kept.n + 2) // (v.n + 2 * v.v) AS BIGINT) AS q
      FROM grp JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN gn ON gn.lang = grp.lang AND gn.source = grp.source
      LEFT JOIN c ON c.lang = grp.lang AND c.source = grp.source AND c.term = kept.term),
pv AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
       FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
          FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
every AS (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
WHERE part = 'pair' OR rank <= 10"""

LEXICAL_SEARCH = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
s AS (SELECT count(*) AS big_n, CAST(sum(len(w)) AS BIGINT) AS big_l FROM d WHERE len(w) > 0),
t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM b) GROUP BY doc_id, term),
df AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, s GROUP BY term, big_n),
m AS (SELECT doc_id, 100 - 50 + ((50 * CAST(len(w) AS BIGINT) * big_n) // big_l) AS m FROM d, s),
r AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
      FROM b JOIN t USING (term) JOIN df USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
WHERE rank <= 50"""

SQL = {
    "op11_line_dedup": LINE_DEDUP,
    "op12_source_divergence_audit": SOURCE_AUDIT,
    "op13_ranked_lexical_search": LEXICAL_SEARCH,
    "op3_substring_dedup": SUBSTRING_DEDUP,
    "op5_ngram_jaccard_join": NGRAM_JACCARD,
    "op7_benchmark_decontamination": DECONTAMINATION,
}
