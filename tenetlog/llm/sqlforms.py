"""SQL forms of the queries of this folder that SQL can express on whole tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"

# Components by reaching: all pairs of different shingle sets that share a shingle are counted.
OP2 = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w)=0 THEN [] WHEN len(w)<4 THEN [array_to_string(w,' ')]
 ELSE list_sort(list_distinct(list_transform(generate_series(1,len(w)-3), lambda i: array_to_string(w[i:i+3],' ')))) END AS g FROM d),
k AS (SELECT doc_id, g, len(g) AS n, CASE WHEN len(g)>0 THEN sha256(array_to_string(g, chr(10))) END AS node FROM s),
nodes AS (SELECT node, min(doc_id) AS id, any_value(g) AS g, any_value(n) AS n FROM k WHERE node IS NOT NULL AND doc_id IS NOT NULL GROUP BY node),
x AS (SELECT node, n, unnest(g) AS sh FROM nodes),
e AS (SELECT a.node AS a, b.node AS b FROM x a JOIN x b ON a.sh=b.sh AND a.node<>b.node GROUP BY a.node, b.node, a.n, b.n
 HAVING 100*count(*) >= 80*(a.n+b.n-count(*))),
reach AS (SELECT node AS a, node AS b FROM nodes UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b=e.a),
c AS (SELECT a, min(id) AS id FROM reach JOIN nodes ON node=b GROUP BY a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(c.id, doc_id) AS component_id,
 doc_id IS NOT DISTINCT FROM coalesce(c.id, doc_id) AS kept FROM k LEFT JOIN c ON c.a=k.node"""

# Every window of 35 words as text; a word goes if a repeated window starts at most 34 words before it.
OP6 = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text,''), {_WORDS}) AS w FROM documents),
starts AS (SELECT r, w, unnest(generate_series(1, len(w)-34)) AS i FROM d WHERE len(w)>=35),
windows AS (SELECT r, i, sha256(array_to_string(w[i:i+34],' ')) AS k FROM starts),
again AS (SELECT k FROM windows GROUP BY k HAVING count(*)>1),
covered AS (SELECT DISTINCT r, unnest(generate_series(i, i+34)) AS j FROM windows SEMI JOIN again USING (k)),
gone AS (SELECT r, count(*) AS n FROM covered GROUP BY r),
words AS (SELECT r, unnest(generate_series(1, len(w))) AS j, unnest(w) AS word FROM d SEMI JOIN gone USING (r)),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY j) AS t FROM words ANTI JOIN covered USING (r, j) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
 sha256(CASE WHEN n IS NULL THEN array_to_string(w,' ') ELSE coalesce(t,'') END) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)"""

ORACLE_SQL = {"op2_minhash_dedup": OP2, "op6_substring_dedup": OP6}
