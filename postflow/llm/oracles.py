"""SQL of corpus operators that SQL can express over whole tables."""

from __future__ import annotations

FILTER_AUDIT_SQL = r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
first AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
w AS (SELECT d.*, regexp_extract_all(d.text, '[^\x20\x09-\x0D]+') AS ws, coalesce(d.doc_id > first.least, false) AS again FROM d JOIN first ON d.text = first.text),
marks AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels GROUP BY doc_id),
fails AS (SELECT w.part, coalesce(marks.good, 0) AS good, coalesce(marks.toxic, 0) AS toxic,
    len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
    100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 3 * length(w.text) AS c,
    regexp_matches(w.text, '[#$%&*|]') AS d, again AS e
  FROM w LEFT JOIN marks ON marks.doc_id = w.doc_id),
counts AS (SELECT part, a, b, c, d, e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY ALL),
letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT concat(p.x, q.x, r.x, s.x, t.x) AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before FROM orders, range(1, 6) AS t(step)),
failing AS (SELECT *, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fs FROM counts),
placed AS (SELECT part, filter_order, step, f, n, good, toxic, fs, contains(fs, f) AS fails_here,
    before <> '' AND regexp_matches(fs, '[' || before || '~]') AS gone FROM failing, steps),
told AS (SELECT part, filter_order, CAST(step AS INT) AS step, f,
    CAST(sum(CASE WHEN NOT gone AND NOT fails_here THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN NOT gone AND fails_here THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN gone AND fails_here THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN fs = f THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN NOT gone AND fails_here THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN NOT gone AND fails_here THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM placed GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM told"""


def _centroid_sql(clusters: int = 40, rounds: int = 5, seed: int = 2, dimensions: int = 64) -> str:
    """Every distance in long form, by vector, centroid and dimension."""
    sql = f"""WITH kept AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions}),
long AS (SELECT r, k, CAST(floor(256 * CAST(embedding[k] AS DOUBLE)) AS BIGINT) AS x FROM kept, range(1, {dimensions + 1}) AS t(k)),
first AS (SELECT r, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, embedding) - 1 AS c FROM kept),
c0 AS (SELECT c, k, x FROM first JOIN long USING (r) WHERE c < {clusters})"""
    for n in range(rounds + 1):
        sql += f""",
d{n} AS (SELECT r, c, sum((long.x - c{n}.x) * (long.x - c{n}.x)) AS d FROM long JOIN c{n} USING (k) GROUP BY r, c),
a{n} AS (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{n} GROUP BY r)"""
        if n < rounds:
            sql += f""",
m{n} AS (SELECT c, k, sum(x) AS s, count(*) AS n FROM a{n} JOIN long USING (r) GROUP BY c, k),
c{n + 1} AS (SELECT c, k, CAST(coalesce((s - ((s % n) + n) % n) // n, x) AS BIGINT) AS x FROM c{n} LEFT JOIN m{n} USING (c, k))"""
    return sql + f""",
named AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY k)) AS name FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, name AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN named USING (c)"""


CENTROID_SQL = _centroid_sql()
