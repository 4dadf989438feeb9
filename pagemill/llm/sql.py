"""SQL of operators whose results SQL can express, though not at scale: brute force over whole (small) tables."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(_LOWER)} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] ELSE range(1, greatest(2, CAST(len(w) AS BIGINT) - 3)) END) AS i FROM w),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM p),
n AS (SELECT w.doc_id, count(s) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT n.doc_id, any_value(n.n) AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id
"""

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) AS BIGINT) - 11)) AS i FROM w)),
f AS (SELECT g, min(doc_id) AS first FROM p GROUP BY g),
gone AS (SELECT DISTINCT p.doc_id, i + k AS j FROM p JOIN f ON p.g = f.g AND p.doc_id > f.first, range(13) t(k)),
x AS (SELECT doc_id, unnest(range(1, CAST(len(w) AS BIGINT) + 1)) AS j, unnest(w) AS word FROM w),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.j) AS kept, count(*) AS n FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.j = x.j WHERE gone.j IS NULL GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) AS BIGINT) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""

def _runs(d: str, length: int) -> str:
    """CTEs p, f, q, r, s with the suffix ``d``: maximal runs a..b of bytes that repeated strings of so many bytes cover."""
    return f"""
p{d} AS (SELECT doc_id, i, md5_number(substr(h, CAST(2 * i + 1 AS BIGINT), {2 * length})) AS g FROM (SELECT doc_id, h, unnest(range(0, n - {length - 1})) AS i FROM d)),
f{d} AS (SELECT g FROM p{d} GROUP BY g HAVING count(*) > 1),
q{d} AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM p{d} WHERE g IN (SELECT g FROM f{d})),
r{d} AS (SELECT doc_id, i, sum(CASE WHEN step <= {length} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM q{d}),
s{d} AS (SELECT doc_id, run, min(i) AS a, max(i) + {length} AS b FROM r{d} GROUP BY doc_id, run)"""


SUFFIX_DEDUP = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
{_runs('', 400)},
{_runs('2', 200)},
t AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS gone, count(*) AS runs FROM s GROUP BY doc_id),
u AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS again FROM s2 GROUP BY doc_id),
e AS (SELECT doc_id, a, b FROM s UNION ALL SELECT doc_id, n, n FROM d),
k AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS left_at FROM e),
j AS (SELECT k.doc_id, string_agg(substr(h, CAST(2 * left_at + 1 AS BIGINT), CAST(2 * (a - left_at) AS BIGINT)), '' ORDER BY a) AS kept FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY k.doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(t.gone, 0) AS n_removed, coalesce(t.runs, 0) AS n_spans, sha256(unhex(j.kept)) AS kept_sha256, coalesce(u.again, 0) AS n_repeated
FROM d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN u ON u.doc_id = d.doc_id JOIN j ON j.doc_id = d.doc_id
"""
