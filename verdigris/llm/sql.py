"""DuckDB SQL for the queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op5_quality_rules"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), g AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM d WHERE len(w) > 2
), h AS (
  SELECT doc_id, k, w[k] AS a, w[k + 1] AS b, w[k + 2] AS c FROM g
), r AS (
  SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, a, b, c) AS times FROM h) WHERE times > 1
), p AS (
  SELECT doc_id, count(*) AS n FROM (SELECT doc_id, k FROM r UNION SELECT doc_id, k + 1 FROM r UNION SELECT doc_id, k + 2 FROM r) GROUP BY doc_id
), s AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, len(l) AS n_lines,
    len(list_filter(w, lambda x: NOT regexp_matches(x, '[\p{L}\p{N}]'))) AS n_bare_words
  FROM d LEFT JOIN p ON p.doc_id = d.doc_id
), b AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_bare_words > 20 * n_words OR 100 * n_upper > 40 * word_chars
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_dup_lines > 40 * n_lines) AS kept
FROM b
"""


def _license_sql() -> str:
    from verdigris.llm.licenses import COVERAGE, LONG, PHRASES, SHIFT, SHORT, TEMPLATES, TEXTS, grams_of

    known = [(*x, True) for x in PHRASES] + [(*x, False) for x in TEMPLATES + TEXTS]
    rows = ", ".join(f"({k}, {at}, '{gram}')" for k, (words, *_) in enumerate(known) for at, gram in enumerate(grams_of(words)))
    sizes = ", ".join(f"({k}, {len(grams_of(words))}, '{label}', {str(base).lower()})" for k, (words, label, base) in enumerate(known))
    rolled = " UNION ALL ".join(f"SELECT doc_id, k, array_to_string(w[k:k + {n - 1}], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS k FROM d WHERE len(w) >= {n})" for n in (SHORT, LONG))
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), g AS (
  {rolled}
), t(template, place, gram) AS (VALUES {rows}), k(template, size, label, base) AS (VALUES {sizes}),
hit AS (
  SELECT g.doc_id, t.template, t.place, g.k - 1 AS pos, g.k - 1 - t.place AS own FROM g JOIN t USING (gram)
), vote AS (
  SELECT hit.doc_id, hit.template, own - s.shift AS diagonal, count(DISTINCT place) AS votes, max(pos) - min(pos) AS span, any_value(size) AS size, any_value(label) AS label, any_value(base) AS base
  FROM hit JOIN k USING (template) JOIN (SELECT unnest(range(0, {SHIFT + 1})) AS shift) s ON s.shift = 0 OR NOT k.base
  GROUP BY ALL
), judged AS (
  SELECT *, base AND votes = size AS whole, NOT base AND votes / CAST(size AS DOUBLE) >= {COVERAGE} AND span < size + {SHIFT} AS noted FROM vote
), f AS (
  SELECT doc_id, count(*) FILTER (whole) AS n_base, min(diagonal) FILTER (whole) AS first_word, max(diagonal) FILTER (whole) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole OR noted) AS labels,
    max(CASE WHEN whole THEN 1.0 WHEN noted THEN votes / CAST(size AS DOUBLE) END) AS score
  FROM judged GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN f ON f.doc_id = d.doc_id
"""


SQL["op6_license_scan"] = _license_sql()

SQL["op3_nearest_neighbours"] = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS own, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0
), d AS (
  SELECT q.own, q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.x) + 1), lambda i: (q.x[i] - c.x[i]) * (q.x[i] - c.x[i])), lambda a, y: a + y)) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.own <> c.own AND len(q.x) = len(c.x)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10
"""


def _k_means_sql(k: int = 8, rounds: int = 10) -> str:
    """The rounds written out one after another; all numbers are whole."""
    steps = []
    for r in range(rounds + 1):
        square = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
        steps.append(f"a{r} AS MATERIALIZED (SELECT own, arg_min(j, d * 100 + j) AS cluster, min(d) AS distance FROM (SELECT v.own, c.j, CAST({square} AS BIGINT) AS d FROM v CROSS JOIN c{r} c) GROUP BY own)")
        if r < rounds:
            mean = "list_transform(range(1, 65), lambda i: CAST(floor(CAST(sums[i] AS DOUBLE) / n) AS BIGINT))"
            sums = ", ".join(f"sum(v.x[{i}])" for i in range(1, 65))
            steps.append(f"s{r} AS MATERIALIZED (SELECT cluster AS j, count(*) AS n, [{sums}] AS sums FROM a{r} JOIN v USING (own) GROUP BY cluster)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(CASE WHEN s.n > 0 THEN {mean} END, c.x) AS x FROM c{r} c LEFT JOIN s{r} s ON s.j = c.j)")
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS own, list_transform(embedding, lambda y: CAST(floor(CAST(y AS DOUBLE) * 1024) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS INTEGER) AS j, x FROM v ORDER BY j LIMIT {k}
), {", ".join(steps)}, i AS (
  SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM a{rounds} GROUP BY cluster
)
SELECT v.vec_id, a.cluster, a.distance, i.cluster_inertia, CAST((SELECT sum(distance) FROM a{rounds}) AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (own) JOIN i USING (cluster) JOIN c{rounds} c ON c.j = a.cluster
"""


SQL["op11_ball_kmeans"] = _k_means_sql()

SQL["op13_prefix_trie"] = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), n AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base,
    list_reduce([4294967295] || flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ord(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS state
  FROM t
), c AS (
  SELECT conv_id, base, xor(state, 4294967295) % 4 AS h FROM n
), s AS (
  SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos < c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h
), d AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w AS prefix, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
  FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)
), m AS MATERIALIZED (
  SELECT conv_id, depth, sha256(prefix) AS node, coalesce(lag(sha256(prefix)) OVER (PARTITION BY conv_id ORDER BY depth), 'root') AS up, words FROM d
  UNION ALL SELECT conv_id, 0, 'root', NULL, 0 FROM c
), l AS (
  SELECT conv_id, max(depth) AS depth FROM m GROUP BY conv_id
), g AS MATERIALIZED (
  SELECT m.node, m.depth, any_value(up) AS up, min(m.conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) FILTER (l.depth = m.depth), '')) AS ends_sha256
  FROM m JOIN l USING (conv_id) GROUP BY m.node, m.depth
), k AS (
  SELECT up AS node, depth - 1 AS depth, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY ALL
), b AS (
  SELECT m.node, m.depth, count(*) FILTER (y.node NOT IN (SELECT node FROM k)) AS n_leaves, sum((y.n_convs - 1) * y.words) AS saved_tokens
  FROM m JOIN g y ON y.conv_id = m.conv_id AND y.depth >= m.depth GROUP BY m.node, m.depth
)
SELECT g.conv_id, g.depth, p.conv_id AS parent_conv_id, g.n_convs, CAST(coalesce(k.n_children, 0) AS BIGINT) AS n_children, b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, g.ends_sha256
FROM g JOIN b USING (node, depth) LEFT JOIN k USING (node, depth) LEFT JOIN g p ON p.node = g.up AND p.depth = g.depth - 1
"""
