"""DuckDB SQL for the operators that SQL can express."""

SQL: dict[str, str] = {}

SQL["op7_line_dedup"] = r"""
WITH lines AS (
    SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT doc_id, line, pos,
           translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), frequent AS (
    SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
    SELECT doc_id, line, pos, coalesce(doc_id <> last, false) AS gone
    FROM keyed LEFT JOIN frequent USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), ''))
           AS kept_sha256
FROM judged GROUP BY doc_id
"""

SQL["op9_mix"] = r"""
WITH sized AS (
    SELECT doc_id, source, text,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           md5('42:' || coalesce(doc_id::VARCHAR, '')) AS key
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
    FROM sized GROUP BY source
), filled AS (
    SELECT *, 2.0::DOUBLE * source_size AS most,
           1.5::DOUBLE * (SELECT sum(source_size)::BIGINT FROM sources) AS budget,
           coalesce(sum(source_size) OVER lower, 0)::BIGINT AS held,
           sum(w) OVER upper::BIGINT AS free,
           2.0::DOUBLE * source_size / w AS ratio
    FROM sources
    WINDOW lower AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           upper AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST
                     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), level AS (
    SELECT min_by((budget - 2.0::DOUBLE * held) / free, ratio)
               FILTER ((budget - 2.0::DOUBLE * held) / free <= ratio) AS v
    FROM filled
), targets AS (
    SELECT source, source_size, least(most, w * v) AS target,
           floor(least(most, w * v) + 0.5)::BIGINT AS budget
    FROM filled, level
), placed AS (
    SELECT doc_id, size, source_size, target, budget,
           CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs,
           coalesce(sum(size) OVER (
               PARTITION BY t.source ORDER BY key, doc_id, size
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (epochs * size
        + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken
FROM placed
"""

SQL["op4_top_k"] = r"""
WITH v AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, v.vec_id,
           max(coalesce(list_sum(list_transform(
               generate_series(1, len(q.e)), lambda i: q.e[i] * v.e[i])), 0))::BIGINT AS score
    FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e)
    WHERE q.vec_id % 50 = 0
    GROUP BY q.vec_id, v.vec_id
)
SELECT query_id,
       (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
       vec_id, score
FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

# Kind, pattern with the value as its last group, that group's number, and its least length.
_SECRETS = r"""
    ('assign', '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 8),
    ('access', 'AKIA([A-Z0-9]+)', 1, 12),
    ('hex', '([0-9a-f]+)', 1, 32),
    ('pem', '-----BEGIN([A-Z ]+PRIVATE KEY-----)', 1, 1),
    ('forge', 'gh[opsru]_([A-Za-z0-9]+)', 1, 36),
    ('chat', 'xox[abprs]-([A-Za-z0-9-]+)', 1, 10),
    ('jwt', 'eyJ([A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)', 1, 30),
    ('login', '[a-z]+://[A-Za-z0-9_.-]+:([A-Za-z0-9_.~!-]+@)', 1, 7)
"""

SQL["op11_secrets"] = rf"""
WITH rules AS (
    SELECT *, row_number() OVER () AS place FROM (VALUES {_SECRETS}) AS r(kind, pattern, g, least)
), matched AS (
    SELECT doc_id, kind, place, least,
           list_transform(string_split_regex(coalesce(text, ''), pattern), lambda x: length(x)) AS gaps,
           list_transform(regexp_extract_all(coalesce(text, ''), pattern), lambda x: length(x)) AS sizes,
           list_transform(CASE g WHEN 2 THEN regexp_extract_all(coalesce(text, ''), pattern, 2)
                                 ELSE regexp_extract_all(coalesce(text, ''), pattern, 1) END,
                          lambda x: length(x)) AS lengths
    FROM documents, rules
), spans AS (
    SELECT doc_id, kind, place, least, sizes[i] AS size, lengths[i] AS n,
           list_sum(gaps[:i]) + coalesce(list_sum(sizes[:i - 1]), 0) AS start
    FROM matched, unnest(range(1, len(sizes) + 1)) AS t(i)
), kept AS (
    SELECT doc_id, kind, place, start::BIGINT AS start,
           concat(kind, ':', start::BIGINT, ':', (start + size)::BIGINT) AS span
    FROM spans WHERE n >= least
)
SELECT d.doc_id, count(span) FILTER (kind = 'assign')::BIGINT AS n_assign,
       count(span) FILTER (kind = 'access')::BIGINT AS n_access,
       count(span) FILTER (kind = 'hex')::BIGINT AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, place) FILTER (place <= 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start, place), '') AS spans
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
GROUP BY d.doc_id
"""

SQL["op12_filter_audit"] = r"""
WITH words AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), judged AS (
    SELECT d.part,
           [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
            100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text),
            regexp_matches(text, '[#$%&*|]'),
            coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails,
           coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
    FROM words d LEFT JOIN (
        SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic
        FROM labels GROUP BY doc_id) l USING (doc_id)
), classes AS (
    SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good,
           count(*) FILTER (toxic) AS toxic
    FROM judged GROUP BY ALL
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
    SELECT concat(a.x, b.x, c.x, d.x, e.x) AS o
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
    SELECT o, s, ascii(o[s]) - 64 AS f FROM orders, range(1, 6) AS t(s)
), removed AS (
    SELECT part, fails, n, good, toxic, o,
           list_position(list_transform(range(1, 6), lambda s: fails[ascii(o[s]) - 64]), true) AS gone
    FROM classes, orders
), counted AS (
    SELECT part, o, s, f,
           sum(n) FILTER (gone IS NULL OR gone > s) AS kept, sum(n) FILTER (gone = s) AS removed,
           sum(n) FILTER (gone < s AND fails[f]) AS redundant,
           sum(n) FILTER (fails[f] AND len(list_filter(fails, lambda x: x)) = 1) AS unique_fails,
           sum(good) FILTER (gone = s) AS good_lost, sum(toxic) FILTER (gone = s) AS toxic_lost
    FROM removed JOIN steps USING (o) GROUP BY ALL
)
SELECT part, o AS filter_order, s::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept,
       coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
FROM counted
"""

SQL["op13_hard_negatives"] = r"""
WITH v AS (
    SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, a.label AS anchor_label, v.vec_id, v.label,
           coalesce(list_sum(list_transform(
               generate_series(1, len(a.e)), lambda i: a.e[i] * v.e[i])), 0)::BIGINT AS score
    FROM v AS a JOIN v ON a.vec_id <> v.vec_id AND len(a.e) = len(v.e)
    WHERE a.vec_id % 50 = 0
), positives AS (
    SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score
    FROM scored WHERE label = anchor_label
    QUALIFY row_number() OVER (PARTITION BY anchor_id, anchor_label ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
       (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank
FROM positives JOIN scored USING (anchor_id, anchor_label)
WHERE label <> anchor_label
  AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
