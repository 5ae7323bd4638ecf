"""DuckDB SQL for the operators that SQL can express."""

SQL: dict[str, str] = {}
SQL["op1_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS txt, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
  FROM t WINDOW w AS (PARTITION BY norm ORDER BY length(txt) DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
SQL["op9_jaccard_join"] = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS sh FROM t
), e AS (
  SELECT DISTINCT doc_id, len(sh) AS n, unnest(sh) AS x FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i FROM e a JOIN e b ON a.x = b.x GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p WHERE 100 * i >= 90 * (na + nb - i)
), r(doc_id, reach) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reach = l.a
)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, m.component_id FROM s JOIN (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY 1) m USING (doc_id)
"""

CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda s, c: list_reduce(list_prepend(xor(s, c), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))))"""
SQL["op11_periodic_runs"] = rf"""
WITH t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, {CRC.format("doc_id")} AS h FROM documents
), u AS (
  SELECT doc_id, w, len(w) AS n, h, h // 10 AS g FROM t
), v AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < g % n THEN i ELSE g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8)) END]) ELSE w END AS w FROM u
), x AS (
  SELECT doc_id, n, unnest(range(n - 2)) AS i, unnest(list_transform(range(1, n - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS three FROM v
), y AS (
  SELECT a.doc_id, a.i, b.i - a.i AS q FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.three = b.three AND b.i > a.i AND 3 * (b.i - a.i) <= a.n
), z AS (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM y
), s AS (
  SELECT doc_id, q, min(i) AS s, count(*) + 2 + q AS l FROM z GROUP BY doc_id, q, k HAVING count(*) + 2 + q >= greatest(24, 3 * q)
), r AS (
  SELECT * FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.doc_id = a.doc_id AND b.q < a.q AND b.s <= a.s AND b.s + b.l >= a.s + a.l)
), m AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines, list(struct_pack(s := s, l := l, q := q)) AS rs, first(struct_pack(s := s, l := l, q := q) ORDER BY l::DOUBLE / q DESC, s, q) AS best FROM r GROUP BY 1
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period, 1000 * best.l // best.q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(array_to_string(list_filter(w, lambda e, i: len(list_filter(coalesce(rs, []), lambda r: i > r.s + r.q AND i <= r.s + r.l)) = 0), ' ')) AS collapsed_sha256
FROM v LEFT JOIN m USING (doc_id)
"""

SQL["op13_prefix_trie"] = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS s, strlen(coalesce(text, '')) AS b FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT conv_id, list(struct_pack(s := s, b := b) ORDER BY turn NULLS FIRST, role, s) AS w, {CRC.format("conv_id")} % 9 AS h FROM c GROUP BY 1
), q AS (
  SELECT o.conv_id, list_concat(coalesce(l.w, [])[1:o.h], o.w[o.h + 1:]) AS w FROM o LEFT JOIN o l ON l.conv_id = o.conv_id - o.conv_id % 5
), d AS (
  SELECT conv_id, w, unnest(range(len(w) + 1)) AS d FROM q
), p AS (
  SELECT conv_id, d, array_to_string(list_transform(w[1:d], lambda x: x.s), '') AS own, CASE WHEN d > 0 THEN w[d].b ELSE 0 END AS b, len(w) = d AS ends FROM d
), n AS (
  SELECT own, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(b) AS b, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY 1, 2
), u AS (
  SELECT own[1:64 * (d - 1)] AS up, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1
), e AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, unnest(list_transform(range(d + 1), lambda k: own[1:64 * k])) AS above FROM n LEFT JOIN u ON u.up = n.own
), s AS (
  SELECT above, CAST(count(*) FILTER (n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * b) AS BIGINT) AS saved_tokens FROM e GROUP BY 1
)
SELECT n.conv_id, n.d AS depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(u.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM n JOIN s ON s.above = n.own LEFT JOIN u ON u.up = n.own LEFT JOIN n m ON n.d > 0 AND m.own = n.own[1:64 * (n.d - 1)]
"""
