"""DuckDB SQL for the operators that SQL can express."""

OP4 = """
WITH doc AS (SELECT row_number() OVER () AS k, doc_id, text, source, string_split(text, chr(10)) AS parts FROM documents),
line AS (SELECT k, doc_id, text, source, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM doc),
solid AS (SELECT * FROM line WHERE trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
bad AS (SELECT line, min(doc_id) AS d FROM solid GROUP BY line HAVING count(DISTINCT source) >= 10),
first AS (SELECT b.line, b.d, min(s.pos) AS p FROM bad b JOIN solid s ON s.line = b.line AND s.doc_id = b.d GROUP BY b.line, b.d),
gone AS (SELECT s.k, s.pos FROM solid s JOIN first f ON s.line = f.line WHERE NOT (s.doc_id = f.d AND s.pos = f.p)),
kept AS (SELECT l.k, string_agg(l.line, chr(10) ORDER BY l.pos) AS kept FROM line l ANTI JOIN gone g ON l.k = g.k AND l.pos = g.pos GROUP BY l.k),
lost AS (SELECT k, count(*) AS n FROM gone GROUP BY k)
SELECT doc.doc_id, CAST(coalesce(len(doc.parts), 0) AS BIGINT) AS n_lines, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed,
  CAST(CASE WHEN doc.text IS NOT NULL THEN length(coalesce(kept.kept, '')) END AS BIGINT) AS kept_chars,
  CASE WHEN doc.text IS NOT NULL THEN sha256(coalesce(kept.kept, '')) END AS kept_sha256
FROM doc LEFT JOIN kept ON kept.k = doc.k LEFT JOIN lost ON lost.k = doc.k
"""

OP7 = r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents),
b AS (SELECT DISTINCT item_id, text FROM benchmark),
dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda w: w <> '') AS w FROM d),
bw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda w: w <> '') AS w FROM b),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM dw WHERE len(w) >= 5),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM bw WHERE len(w) >= 5),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n_shared, n_item, round(n_shared / n_item, 6) AS containment
FROM (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id) JOIN n USING (item_id)
WHERE n_shared >= 0.8 * n_item
UNION ALL SELECT DISTINCT doc_id, item_id, CAST(1 AS BIGINT), CAST(1 AS BIGINT), CAST(1 AS DOUBLE) FROM dw JOIN bw ON len(bw.w) BETWEEN 1 AND 4 AND contains(' ' || array_to_string(dw.w, ' ') || ' ', ' ' || array_to_string(bw.w, ' ') || ' ')
"""

OP11 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to, true AS intact
FROM f
"""


def op13(k: int = 40, rounds: int = 5) -> str:
    """Lloyd's rounds one after the other; means are floored in integers."""
    out = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS c, x FROM v ORDER BY sha256('2:' || vec_id), x LIMIT {k})"""
    for i in range(rounds + 1):
        out += f""",
d{i} AS (SELECT r, c, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - m{i}.x[i]) * (v.x[i] - m{i}.x[i]))) AS d FROM v, m{i}),
a{i} AS MATERIALIZED (SELECT r, c, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""
        if i < rounds:
            out += f""",
e{i} AS (SELECT c, i, sum(e) AS s, count(*) AS n FROM (SELECT a{i}.c, unnest(v.x) AS e, unnest(range(64)) AS i FROM a{i} JOIN v USING (r)) GROUP BY c, i),
f{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS x FROM e{i} GROUP BY c),
m{i + 1} AS MATERIALIZED (SELECT m{i}.c, coalesce(f{i}.x, m{i}.x) AS x FROM m{i} LEFT JOIN f{i} USING (c))"""
    return f"""{out}
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN m{rounds} m ON m.c = a.c
"""


ORACLES = {"op4_line_dedup": OP4, "op7_decontamination": OP7, "op11_warc": OP11, "op13_clustering": op13()}
