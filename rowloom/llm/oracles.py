"""SQL for the queries whose rows SQL can state. Meant for small tables: it pairs by shingle and walks links row by row."""

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_REACHED = (
    "reach(id, other) AS (SELECT id, id FROM nodes UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other), "
    "label AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id) "
)

OP1 = (
    "WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0), "
    "nodes AS (SELECT vec_id AS id FROM embeddings), "
    "links AS (SELECT p.id AS a, q.id AS b FROM v p JOIN v q ON p.id <> q.id AND list_dot_product(p.x, q.x) / (sqrt(list_dot_product(p.x, p.x)) * sqrt(list_dot_product(q.x, q.x))) >= 0.9), "
    + _REACHED
    + "SELECT n.id AS vec_id, (SELECT count(*) FROM links WHERE a = n.id) AS n_links, component_id, component_id = n.id AS kept FROM nodes n JOIN label USING (id)"
)

OP5 = (
    "WITH RECURSIVE w AS (SELECT doc_id AS id, "
    + _WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    + " AS w FROM documents), "
    "s AS (SELECT id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w), "
    "u AS (SELECT id, len(s) AS n, unnest(s) AS g FROM s), nodes AS (SELECT id FROM s), "
    "links AS (SELECT p.id AS a, q.id AS b FROM u p JOIN u q ON p.g = q.g AND p.id <> q.id GROUP BY p.id, q.id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))), "
    + _REACHED
    + "SELECT id AS doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, component_id = id AS kept FROM s JOIN label USING (id)"
)

OP7 = (
    "WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, " + _WORDS.format("coalesce(text, '')") + " AS w FROM documents), "
    "g AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)), "
    "r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id), "
    "l AS (SELECT doc_id, source, unnest(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) AS line FROM d), "
    "m AS (SELECT doc_id, source, trim(regexp_replace(lower(line), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS k, len(" + _WORDS.format("line") + ") AS n FROM l), "
    "h AS (SELECT source, count(*) AS docs FROM documents GROUP BY source), "
    "f AS (SELECT m.source, k FROM m JOIN h ON h.source IS NOT DISTINCT FROM m.source GROUP BY m.source, k, docs HAVING count(DISTINCT doc_id) > 20 AND count(DISTINCT doc_id) > 0.001 * docs), "
    "z AS (SELECT doc_id, sum(n) AS gone FROM m JOIN f ON f.k = m.k AND f.source IS NOT DISTINCT FROM m.source GROUP BY doc_id), "
    "b AS (SELECT d.doc_id, d.source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars, "
    "CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed_words "
    "FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d) d LEFT JOIN r USING (doc_id) LEFT JOIN z USING (doc_id)), "
    "x AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b) "
    "SELECT *, NOT base_failed AND NOT (n_words - n_removed_words < 0.3 * n_words) AS kept FROM x"
)

#: Windows of 50 words by their text; a word goes if one that covers it starts in a smaller document, too.
OP11 = (
    "WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents), "
    "g AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)), "
    "m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM g), "
    "r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM m WHERE least < doc_id), "
    "a AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d), "
    "k AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM a ANTI JOIN r ON a.doc_id = r.doc_id AND a.p = r.p GROUP BY a.doc_id) "
    "SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"
)
