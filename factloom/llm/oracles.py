"""DuckDB SQL for the queries of this subpackage that SQL can express, each by the plain definition."""

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, range(0, 8) x(k) GROUP BY r),
line AS (SELECT * FROM (SELECT r, source, t, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM line GROUP BY r),
norm AS (SELECT source, t, l, regexp_replace(trim(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]+', '0', 'g') AS k
    FROM (SELECT DISTINCT source, t, r FROM line QUALIFY r = min(r) OVER (PARTITION BY source, t)) JOIN (SELECT r, l FROM line) USING (r)),
host AS (SELECT source, count(DISTINCT t) AS texts FROM d GROUP BY source),
above AS (SELECT source, k FROM norm GROUP BY source, k HAVING count(DISTINCT t) >= 20),
often AS (SELECT a.source, a.k FROM above a JOIN host h ON h.source IS NOT DISTINCT FROM a.source
    JOIN (SELECT source, k, count(DISTINCT t) AS n FROM norm GROUP BY ALL) c ON c.source IS NOT DISTINCT FROM a.source AND c.k = a.k WHERE c.n >= 0.05 * h.texts OR c.n >= 1000),
sunk AS (SELECT n.source, n.t FROM norm n LEFT JOIN often o ON o.source IS NOT DISTINCT FROM n.source AND o.k = n.k
    GROUP BY n.source, n.t HAVING sum(length(l)) - coalesce(sum(length(l)) FILTER (WHERE o.k IS NOT NULL), 0) < 0.5 * sum(length(l))),
m AS (SELECT d.*, len(w)::BIGINT AS n_words, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(dup.n, 0)::BIGINT AS n_dup_lines FROM d LEFT JOIN cov USING (r) LEFT JOIN dup USING (r))
SELECT doc_id, n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(m.t) - length(regexp_replace(m.t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, n_dup_lines, n_repeat_words,
    (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND sunk.t IS NULL AS kept
FROM m LEFT JOIN sunk ON sunk.source IS NOT DISTINCT FROM m.source AND sunk.t = m.t
"""

SUBSTRING = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
hit AS (SELECT r, i FROM win QUALIFY doc_id > min(doc_id) OVER (PARTITION BY g)),
gone AS (SELECT r, list(DISTINCT i + k) AS p FROM hit, range(0, 13) x(k) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(p), 0)::BIGINT AS n_removed,
    sha256(array_to_string(CASE WHEN p IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(p, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (r)
"""

CLASSES = """
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, l.b FROM reach JOIN links l ON l.a = reach.b),
class AS (SELECT reach.a AS r, min(d.id) AS least FROM reach JOIN d ON d.r = reach.b GROUP BY 1),
counted AS (SELECT a AS r, count(*) AS n FROM links GROUP BY 1)
"""

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id AS id, {WORDS} AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
links AS (SELECT x.a, x.b FROM (SELECT p.r AS a, q.r AS b, count(*) AS shared FROM s p JOIN s q ON p.g = q.g AND p.r <> q.r GROUP BY 1, 2) x
    JOIN n na ON na.r = x.a JOIN n nb ON nb.r = x.b WHERE shared >= 0.8 * (na.n + nb.n - shared) - 1e-9),
{CLASSES}
SELECT d.id AS doc_id, least AS class_id, coalesce(n, 0)::BIGINT AS n_links, d.id = least AS kept FROM d JOIN class USING (r) LEFT JOIN counted USING (r)
"""

EMBEDDINGS = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, vec_id AS id, label, embedding::DOUBLE[] AS v,
    coalesce(len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS good FROM embeddings),
links AS (SELECT p.r AS a, q.r AS b FROM d p JOIN d q ON p.label = q.label AND p.r <> q.r AND len(p.v) = len(q.v) WHERE p.good AND q.good AND list_cosine_similarity(p.v, q.v) >= 0.98),
{CLASSES}
SELECT d.id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, least AS component_id, d.id = least AS kept FROM d JOIN class USING (r) LEFT JOIN counted USING (r)
"""
