"""What SQL can say of the queries' results: statements for DuckDB over whole tables."""

#: Vectors that count, pairs at the threshold within a label, and what links lead to.
EMBEDDINGS = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), good AS (
    SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), components AS (
    SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1
)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM components c
"""

#: Lines as sets of shingles; a line goes if an earlier one shares four fifths of both together.
LINES = r"""
WITH l AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents
), w AS (
    SELECT doc_id, line_no, regexp_extract_all(line, '[^ \t\r\x0B\x0C]+') AS words FROM l
), s AS (
    SELECT doc_id, line_no, list_distinct(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
        WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS tokens FROM w
), sets AS (
    SELECT row_number() OVER (ORDER BY min(doc_id * 1000000 + line_no)) AS k, min(doc_id * 1000000 + line_no) AS first, tokens FROM (SELECT doc_id, line_no, list_sort(tokens) AS tokens FROM s WHERE len(tokens) > 0) GROUP BY tokens
), t AS (
    SELECT k, len(tokens) AS n, unnest(tokens) AS token FROM sets
), gone AS (
    SELECT DISTINCT k FROM (
        SELECT a.k, b.k AS earlier, a.n, b.n AS m, count(*) AS common FROM t a JOIN t b ON a.token = b.token AND b.k < a.k GROUP BY ALL
    ) WHERE common >= 0.8 * (n + m - common) - 1e-9
), removed AS (
    SELECT doc_id, line_no FROM s JOIN sets ON list_sort(s.tokens) = sets.tokens WHERE doc_id * 1000000 + line_no <> first OR k IN (SELECT k FROM gone)
)
SELECT d.doc_id, d.n_lines, count(r.line_no) AS n_removed, coalesce(string_agg(r.line_no::VARCHAR, ',' ORDER BY r.line_no), '') AS removed
FROM (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY 1) d LEFT JOIN removed r USING (doc_id) GROUP BY 1, 2
"""

#: Windows are compared as texts; a word goes if one that covers it starts twice or more.
SUBSTRINGS = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS words FROM documents
), p AS (
    SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place, len(words) AS n FROM d
), windows AS (
    SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS content FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM d)
), repeated AS (
    SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY content) > 1
), marked AS (
    SELECT p.doc_id, p.place, p.word, max(r.i) OVER (PARTITION BY p.doc_id ORDER BY p.place) AS latest FROM p LEFT JOIN repeated r ON p.doc_id = r.doc_id AND p.place = r.i
), kept AS (
    SELECT doc_id, count(*) FILTER (WHERE latest IS NOT NULL AND place < latest + 35) AS n_removed, string_agg(word, ' ' ORDER BY place) FILTER (WHERE latest IS NULL OR place >= latest + 35) AS words FROM marked GROUP BY 1
)
SELECT doc_id, len(d.words)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.words, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

#: Of equal payloads the smallest page_id is the response; base 32 is made of 20 bits, four letters, at a time.
WARC = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS payload FROM pages
), h AS (
    SELECT page_id, payload, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS first FROM p
)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda k: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substring(hex, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM h
"""
