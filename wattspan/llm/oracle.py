"""Comparison SQL of the operators that SQL can express, over whole tables."""

SQL: dict[str, str] = {}

SQL["op4_substring_dedup"] = r"""
WITH d AS (
    SELECT doc_id, row_number() OVER () AS r,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), s AS (
    SELECT r, i, array_to_string(w[i:i + 34], ' ') AS win
    FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), again AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY win) AS n FROM s) WHERE n > 1
), gone AS (
    SELECT DISTINCT r, i + k AS p FROM again, (SELECT unnest(range(0, 35)) AS k)
), words AS (
    SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
    SELECT r, count(*) AS n, count(g.p) AS lost,
           string_agg(word, ' ' ORDER BY p) FILTER (g.p IS NULL) AS body
    FROM words LEFT JOIN gone g USING (r, p) GROUP BY r
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(lost, 0)::BIGINT AS n_removed,
       sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

SQL["op8_minhash_dedup"] = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
    FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), link AS (
    SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
    WHERE 100 * c >= 85 * (p.n + q.n - c)
), edge AS (
    SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
    SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a
), low AS (
    SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id,
       coalesce(c, doc_id) = doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = doc_id
"""

SQL["op1_voronoi_knn"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 20
"""

SQL["op11_spelling_variants"] = r"""
WITH RECURSIVE crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
), r AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[a-z\x{C0}-\x{FF}]+')) AS w
    FROM documents WHERE text IS NOT NULL
), g AS (
    SELECT coalesce(doc_id::VARCHAR, '') || ':' || w AS s, w, count(*) AS n FROM r WHERE length(w) >= 5 GROUP BY doc_id, w
), b AS (
    SELECT w, n, flatten(list_transform(string_split(s, ''), lambda c:
        CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, (unicode(c) - 64)::BIGINT] END)) AS bytes
    FROM g
), h AS (
    SELECT w, n, 4294967295 - list_reduce(list_prepend(4294967295::BIGINT, bytes),
        lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])) AS h
    FROM b, crc
), words AS (
    SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT CASE WHEN h % 97 = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, n FROM h
    ) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), less AS (
    SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
    SELECT a.word, b.word AS near, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), best AS (
    SELECT word, count(*) AS n_near, max(n) AS top, arg_min(near, (-n, near)) AS near FROM near GROUP BY word
), f AS (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * n THEN near END AS form,
           CASE WHEN top >= 2 * n THEN top END AS form_n
    FROM words LEFT JOIN best USING (word)
), walk AS (
    SELECT word, word AS here, form AS ahead FROM f
    UNION ALL SELECT k.word, k.ahead, f.form FROM walk k JOIN f ON f.word = k.ahead
)
SELECT f.word, form, here AS root, n::BIGINT AS n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n
FROM f JOIN walk k ON k.word = f.word AND k.ahead IS NULL
"""
