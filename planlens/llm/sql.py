"""DuckDB SQL for those queries that SQL can express."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS ws FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []
   WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
   ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w),
each AS (SELECT doc_id, unnest(s) AS t, len(s) AS n FROM sets),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM each a JOIN each b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair WHERE 100 * k >= 75 * (na + nb - k)),
both_ways AS (SELECT a AS u, b AS v FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM reach r JOIN both_ways l ON r.v = l.u)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(v) AS component_id FROM sets JOIN reach ON u = sets.doc_id GROUP BY ALL
"""

REPEATED_PASSAGES = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
earliest AS (SELECT t, min(doc_id) AS d FROM win GROUP BY t),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN earliest USING (t), range(0, 13) AS x(j) WHERE d < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""


def _vector_codes(rounds: int = 6) -> str:
    """Lloyd rounds one after the other; a distance and an entry are one number, so the least has the lowest index."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (SELECT rid, p, min(d * 16 + k) AS m FROM (
   SELECT rid, parts.p, k, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(x, c)]) AS d FROM parts JOIN book{k} USING (p)) GROUP BY ALL)""")
        if k < rounds:
            steps.append(f"""sums{k} AS (SELECT p, k, j, sum(v) AS s, count(*) AS n FROM (
   SELECT p, CAST(m % 16 AS BIGINT) AS k, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS j FROM near{k} JOIN parts USING (rid, p)) GROUP BY ALL),
book{k + 1} AS MATERIALIZED (SELECT p, k, coalesce(n.c, o.c) AS c FROM book{k} o LEFT JOIN (
   SELECT p, k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM sums{k} GROUP BY p, k) n USING (p, k))""")
    return f"""
WITH kept AS (SELECT vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v, row_number() OVER (ORDER BY vec_id) AS rid
   FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS MATERIALIZED (SELECT rid, p, list_slice(v, p * len(v) // 8 + 1, (p + 1) * len(v) // 8) AS x FROM kept, range(8) AS t(p)),
book0 AS MATERIALIZED (SELECT p, rid - 1 AS k, x AS c FROM parts WHERE rid <= 16),
{", ".join(steps)},
coded AS (SELECT rid, string_agg(printf('%02x', CAST(m % 16 AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(m // 16) AS BIGINT) AS error FROM near{rounds} GROUP BY rid),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (rid), digest
"""


VECTOR_CODES = _vector_codes()


def oracle_sql() -> dict[str, str]:
    return {"op1_jaccard_join": NEAR_DUPLICATES, "op2_substring_dedup": REPEATED_PASSAGES, "op13_vector_codes": VECTOR_CODES}
