"""DuckDB SQL that must return the rows of a query, for the operators SQL can express."""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Connected components of ``links (a, b)``, both directions in it, as ``tree (node, component)``.
_TREE = """
reach AS (SELECT a AS node, b AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
tree AS (SELECT node, least(node, min(other)) AS component FROM reach GROUP BY node)"""

OP2_SQL = rf"""
WITH iw AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
iwin AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM iw WHERE len(w) > 0)),
dw AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
pos AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM dw WHERE len(w) > 0),
ahead AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS ws FROM pos),
dwin AS (SELECT doc_id, i, size, array_to_string(ws[1 : size], ' ') AS g FROM ahead, (SELECT DISTINCT size FROM iwin) WHERE len(ws) >= size),
met AS (SELECT doc_id, item_id, i, size FROM dwin JOIN iwin USING (size, g)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS j FROM met) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP7_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x) AND list_cosine_similarity(p.x, q.x) >= 0.95),
{_TREE},
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN tree ON node = vec_id
"""

OP8_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
pos AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM w WHERE len(w) > 0),
ahead AS (SELECT doc_id, n, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS ws FROM pos),
s AS (SELECT DISTINCT doc_id, array_to_string(ws, ' ') AS g FROM ahead WHERE len(ws) = least(n, 5)),
size AS (SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id),
met AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS shared FROM s p JOIN s q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * shared >= 80 * (p.n_shingles + q.n_shingles - shared)),
{_TREE}
SELECT doc_id, coalesce(n_shingles, 0) AS n_shingles, coalesce(component, doc_id) AS component_id
FROM documents LEFT JOIN size USING (doc_id) LEFT JOIN tree ON node = doc_id
"""

#: Texts as hex, so that bytes can be cut anywhere; a window is a string of 100 bytes, cut from pieces of 1,000 starts, as
#: a cut costs the length of what it is made from; ``c`` holds the covered bytes as runs.
OP5_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS (SELECT doc_id, x, len(x) // 2 AS n_bytes FROM d),
piece AS (
  SELECT doc_id, base, substr(x, 2 * base + 1, 2198) AS x
  FROM (SELECT doc_id, x, unnest(generate_series(0, n_bytes - 100, 1000)) AS base FROM n WHERE n_bytes >= 100)),
win AS (
  SELECT doc_id, base + k AS i, md5(substr(x, 2 * k + 1, 200)) AS g
  FROM (SELECT doc_id, base, x, unnest(generate_series(0, least(999, len(x) // 2 - 100))) AS k FROM piece)),
again AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
runs AS (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM again)),
c AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM c),
left_over AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS head
  FROM gaps JOIN n USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM n LEFT JOIN left_over USING (doc_id)
"""


def _lloyd_sql(k: int = 40, rounds: int = 5) -> str:
    """Lloyd's rounds in long form: ``x`` (row, dimension, value), ``c0`` the first centroids, ``a<r>`` assignments, ``c<r>`` centroids after round r."""
    parts = [
        f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS MATERIALIZED (SELECT r, unnest(v) AS e, unnest(generate_series(1, 64)) AS d FROM kept),
first AS (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v
  FROM (SELECT v, sha256('2:' || CAST(vec_id AS VARCHAR)) AS h FROM kept WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k})),
c0 AS MATERIALIZED (SELECT j, unnest(v) AS m, unnest(generate_series(1, 64)) AS d FROM first)"""
    ]
    for n in range(rounds + 1):
        parts.append(
            f"""
a{n} AS MATERIALIZED (
  SELECT r, j, dist FROM (SELECT r, j, sum((e - m) * (e - m)) AS dist FROM x JOIN c{n} USING (d) GROUP BY r, j)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY dist, j) = 1)"""
        )
        if n < rounds:
            # A sum less its remainder, taken as one that isn't negative, divides without one: so quotients are floors.
            parts.append(
                f"""
s{n} AS (SELECT j, d, CAST(sum(e) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{n} USING (r) GROUP BY j, d),
c{n + 1} AS MATERIALIZED (SELECT j, d, coalesce((s - ((s % n) + n) % n) // n, m) AS m FROM c{n} LEFT JOIN s{n} USING (j, d))"""
            )
    parts.append(
        f"""
inert AS (SELECT j, sum(dist) AS cluster_inertia FROM a{rounds} GROUP BY j),
named AS (SELECT j, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY j)"""
    )
    return (
        ",".join(parts)
        + f"""
SELECT vec_id, CAST(j AS INTEGER) AS cluster, CAST(dist AS BIGINT) AS distance, CAST(cluster_inertia AS BIGINT) AS cluster_inertia,
       CAST((SELECT sum(dist) FROM a{rounds}) AS BIGINT) AS inertia, centroid_sha256
FROM kept JOIN a{rounds} USING (r) JOIN inert USING (j) JOIN named USING (j)
"""
    )


OP12_SQL = _lloyd_sql()
