"""DuckDB SQL for the queries of this package that SQL can express over whole tables."""

from __future__ import annotations

LINE_DEDUP = r"""
WITH page AS (
    SELECT row_number() OVER () AS page, page_id,
           nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '') AS host,
           regexp_replace(regexp_replace(regexp_replace(html,
               '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g'),
               '(?i)</?(?:p|div|br|li|ul|ol|nav|h[1-6]|title|head|body|html|header|footer|main|article|section|aside|form|'
               || 'table|tr|td|th|blockquote|pre|figure|figcaption|dl|dt|dd|hr|option|select)\b[^>]*>', chr(10), 'g'),
               '<[^>]*>', '', 'g') AS text
    FROM pages
), line AS (
    SELECT page, host, i, lines[i] AS line, regexp_replace(lines[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare
    FROM (SELECT page, host, lines, unnest(range(1, len(lines) + 1)) AS i
          FROM (SELECT page, host, string_split(text, chr(10)) AS lines FROM page WHERE text IS NOT NULL))
), repeated AS (
    SELECT host, bare
    FROM (SELECT host, bare, count(DISTINCT page) AS n FROM line WHERE bare <> '' GROUP BY host, bare)
    JOIN (SELECT host AS h, count(*) AS pages FROM page GROUP BY host) ON host IS NOT DISTINCT FROM h
    WHERE n >= 3 AND n > 0.1 * pages
), marked AS (
    SELECT line.page, i, line, repeated.bare IS NOT NULL AS dropped
    FROM line LEFT JOIN repeated ON line.host IS NOT DISTINCT FROM repeated.host AND line.bare = repeated.bare
), rebuilt AS (
    SELECT page, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '') AS text,
           count(*) FILTER (dropped) AS lines_dropped
    FROM marked GROUP BY page
)
SELECT page_id, host, CAST(length(r.text) AS BIGINT) AS n_chars, coalesce(lines_dropped, 0) AS lines_dropped,
       sha256(r.text) AS text_sha256
FROM page LEFT JOIN rebuilt r USING (page)
"""

MIXING = r"""
WITH RECURSIVE sized AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
           substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS hash
    FROM documents
), total AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
    SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
           [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
    FROM total
), filled AS (  -- sources at their limit give the rest to the others, until none is above it
    SELECT 0 AS round, source, source_size, cap, weight, false AS full_now,
           1.5::DOUBLE * (SELECT sum(source_size) FROM total)::DOUBLE AS left_over, (SELECT sum(weight) FROM weighed) AS open_weight
    FROM weighed
    UNION ALL
    SELECT round + 1, source, source_size, cap, weight, full_after,
           1.5::DOUBLE * (SELECT sum(source_size) FROM total)::DOUBLE - sum(CASE WHEN full_after THEN cap ELSE 0 END) OVER (),
           sum(CASE WHEN full_after THEN 0 ELSE weight END) OVER ()
    FROM (SELECT *, full_now OR left_over * weight / open_weight > cap AS full_after FROM filled)
    WHERE round < (SELECT count(*) FROM total)
), target AS (
    SELECT source, source_size, CASE WHEN full_now THEN cap ELSE left_over * weight / open_weight END AS target
    FROM filled WHERE round = (SELECT count(*) FROM total)
), passed AS (
    SELECT *, least(floor(target / greatest(source_size, 1)), 2)::BIGINT AS passes FROM target
), hashed AS (
    SELECT source, hash, sum(size) OVER (PARTITION BY source ORDER BY hash RANGE UNBOUNDED PRECEDING) AS upto,
           sum(size) OVER (PARTITION BY source, hash) AS words, doc_id, size
    FROM sized
), drawn AS (
    SELECT h.doc_id, h.size, p.source_size, p.target, p.passes,
           CASE WHEN upto <= target - passes * source_size THEN 1
                WHEN upto - words <= target - passes * source_size
                     AND upto - (target - passes * source_size) < (target - passes * source_size) - (upto - words) THEN 1
                ELSE 0 END AS once_more
    FROM hashed h JOIN passed p ON h.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE size * least(passes + once_more, 2) END AS taken
FROM drawn
"""


TOP_PRODUCTS = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""

SOURCE_DIVERGENCE = r"""
WITH doc AS (
    SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), used AS (
    SELECT row, lang, source, unnest(regexp_extract_all(text, '[a-z\x{80}-\x{10FFFF}]+')) AS term FROM doc
), kept AS (
    SELECT lang, term, count(*) AS lang_n FROM used GROUP BY lang, term HAVING count(DISTINCT row) >= 30
), size AS (
    SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang
), grp AS (
    SELECT lang, source, coalesce(v, 0) AS v, coalesce(lang_total, 0) AS lang_total
    FROM (SELECT DISTINCT lang, source FROM doc) LEFT JOIN size USING (lang)
), cell AS (  -- every group and kept term
    SELECT g.lang, g.source, k.term, k.lang_n, g.v, g.lang_total, coalesce(c.n, 0) AS n
    FROM grp g JOIN kept k USING (lang)
    LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM used GROUP BY lang, source, term) c
        ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), total AS (
    SELECT lang, source, sum(n) AS total FROM cell GROUP BY lang, source
), share AS (
    SELECT lang, source, term, n,
           CAST(1 + (1000000000::HUGEINT * (n + 5)) // (total::HUGEINT + 5 * v) AS BIGINT) AS p,
           CAST(1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total::HUGEINT + 5 * v) AS BIGINT) AS q
    FROM cell JOIN total USING (lang, source)
), pair AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), valued AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
    FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, p - q FROM share WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
    FROM valued
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def registered() -> dict[str, str]:
    return {"op12_source_divergence": SOURCE_DIVERGENCE, "op2_line_dedup": LINE_DEDUP, "op6_mixing": MIXING, "op10_topk": TOP_PRODUCTS}
