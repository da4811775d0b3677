"""SQL that gives the rows of the operators that SQL can express, by brute force."""

from __future__ import annotations

_COMPONENTS = """
 reach AS (SELECT id, id AS other FROM nodes UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
 parts AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
 degrees AS (SELECT a AS id, count(*) AS n_links FROM links GROUP BY a)"""

OP1 = f"""WITH RECURSIVE good AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
 links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM good p JOIN good q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.93),
 nodes AS (SELECT vec_id AS id FROM embeddings), {_COMPONENTS}
SELECT id AS vec_id, coalesce(n_links, 0) AS n_links, component_id, id = component_id AS kept FROM parts LEFT JOIN degrees USING (id)"""

OP6 = f"""WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
 grams AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM words WHERE len(w) > 0)),
 sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
 both_in AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
 links AS (SELECT a, b FROM both_in JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
 nodes AS (SELECT doc_id AS id FROM documents), {_COMPONENTS}
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links FROM parts LEFT JOIN degrees USING (id) LEFT JOIN sizes ON sizes.doc_id = id"""

#: crc32 by its table, which a fold makes from the polynomial; UTF-8 bytes of words in Latin letters from their code points.
_STEP = "CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END"
_FOLD = "range(256)"
for _ in range(8):
    _FOLD = f"list_transform({_FOLD}, lambda c: {_STEP})"

OP12 = f"""WITH RECURSIVE tab AS MATERIALIZED (SELECT {_FOLD} AS t),
 runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]{{7,}}')) AS run FROM documents),
 kinds AS (SELECT id, run, count(*) AS n FROM runs GROUP BY 1, 2),
 bytes AS (SELECT id, run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [CAST(195 AS BIGINT), ord(x) - 64] END)) AS b FROM kinds),
 hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS h FROM bytes, tab),
 words AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
 vocabulary AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM words WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
 holes AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary),
 other AS (SELECT word, n, i, left(word, i - 1) || '*' || substr(word, i + 1) AS star, left(word, i - 1) || substr(word, i + 1) AS less FROM holes),
 near AS (SELECT DISTINCT * FROM (
   SELECT x.word, y.word AS near, y.n FROM other x JOIN other y ON x.star = y.star AND x.i = y.i AND x.word <> y.word
   UNION ALL SELECT x.word, v.word, v.n FROM other x JOIN vocabulary v ON x.less = v.word
   UNION ALL SELECT v.word, x.word, x.n FROM other x JOIN vocabulary v ON x.less = v.word)),
 ranked AS (SELECT word, near, n AS near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, encode(near)) AS r FROM near),
 forms AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * v.n THEN near END AS form, CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n FROM vocabulary v LEFT JOIN ranked ON ranked.word = v.word AND r = 1),
 chain AS (SELECT word, word AS step, 0 AS steps FROM forms UNION ALL SELECT c.word, f.form, steps + 1 FROM chain c JOIN forms f ON f.word = c.step WHERE f.form IS NOT NULL),
 roots AS (SELECT word, arg_max(step, steps) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)"""

OP13 = r"""WITH texts AS (SELECT row_number() OVER () AS k, doc_id, CAST(source AS VARCHAR) AS source, coalesce(text, '') AS text FROM documents),
 parts AS (SELECT k, doc_id, source, text, list_filter(string_split_regex(text, '[ 	-
]+'), lambda w: w <> '') AS w, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ 	-
]')) AS l FROM texts),
 windows AS (SELECT k, i, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM parts)),
 again AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM windows) WHERE c > 1),
 repeats AS (SELECT k, count(DISTINCT i + j) AS n_repeat_words FROM again, range(3) t(j) GROUP BY k),
 rows AS MATERIALIZED (SELECT k, doc_id, source, len(w) AS n_words, length(regexp_replace(text, '[ 	-
]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
   len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines FROM parts LEFT JOIN repeats USING (k)),
 fails AS (SELECT k, source, unnest(['few_words', 'repeats', 'symbols', 'dup_lines', 'word_length']) AS rule, unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > n_words, 10 * n_dup_lines > 3 * n_lines,
   n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 12 * n_words)]) AS failed FROM rows WHERE source IS NOT NULL),
 hosts AS MATERIALIZED (SELECT source, rule, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (failed) AS DOUBLE) AS f FROM fails GROUP BY source, rule),
 sums AS (SELECT rule, count(*) AS hosts, sum(n) AS n, sum(f) / sum(n) AS m, sum(n * n) AS n2, sum(f * f / n) - sum(f) * sum(f) / sum(n) AS spread FROM hosts GROUP BY rule),
 prior AS (SELECT rule, m, 1 / greatest(0.01::DOUBLE, least(1.0::DOUBLE / 11, coalesce(CASE WHEN m * (1 - m) <> 0 AND n - n2 / n - (hosts - 1) > 0 THEN (spread / (m * (1 - m)) - (hosts - 1)) / (n - n2 / n - (hosts - 1)) END, 0))) - 1 AS weight FROM sums),
 bad AS (SELECT DISTINCT source FROM (SELECT source, (f + weight * m) / (n + weight) AS rate, m FROM hosts JOIN prior USING (rule)) WHERE rate > 0.5 AND rate > 2 * m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept FROM rows"""

ORACLE_SQL = {"op1_embedding_dedup": OP1, "op6_ngram_join": OP6, "op12_spelling": OP12, "op13_host_rules": OP13}
