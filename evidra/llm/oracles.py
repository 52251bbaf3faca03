"""DuckDB SQL for the contract queries that SQL can express."""

from __future__ import annotations

from .op4_mixing import SEED
from .op9_sharding import SHARDS, SLOTS

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

OP4 = f"""
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents
), t AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source
), r AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM t
), c AS (
  SELECT *, row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST) AS place FROM r
), d AS (
  SELECT *, (SELECT sum(source_size) FROM c) - (SELECT coalesce(sum(b.cap), 0) FROM c b WHERE b.place < c.place) AS rest,
    (SELECT sum(weight) FROM c) - (SELECT coalesce(sum(b.weight), 0) FROM c b WHERE b.place < c.place) AS rest_weight FROM c
), l AS (
  SELECT place, rest, rest_weight FROM d WHERE CAST(cap AS DOUBLE) * rest_weight > weight * CAST(rest AS DOUBLE) ORDER BY place LIMIT 1
), g AS (
  SELECT source, source_size, CASE WHEN (SELECT count(*) FROM l) = 0 OR place < (SELECT place FROM l) THEN CAST(cap AS DOUBLE)
    ELSE CAST(weight * (SELECT rest FROM l) AS DOUBLE) / CAST((SELECT rest_weight FROM l) AS DOUBLE) END AS target FROM d
), j AS (
  SELECT s.doc_id, s.size, g.source_size, g.target,
    CASE WHEN g.source_size > 0 THEN g.target / CAST(g.source_size AS DOUBLE) ELSE 0.0 END AS rate,
    CAST(CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS drawn
  FROM s LEFT JOIN g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  size * (CAST(floor(rate) AS BIGINT) + CASE WHEN drawn < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM j
"""

OP9 = f"""
WITH RECURSIVE names AS (
  SELECT unnest(range({len(SHARDS)})) AS i, unnest({list(SHARDS)!r}) AS shard
), prefs AS (
  SELECT list(CAST(('0x' || substr(md5('offset:' || shard), 1, 15)) AS BIGINT) % {SLOTS} ORDER BY i) AS start,
    list(CAST(('0x' || substr(md5('skip:' || shard), 1, 15)) AS BIGINT) % {SLOTS - 1} + 1 ORDER BY i) AS skip FROM names
), fill(turn, free, taken) AS (
  SELECT 0, list_transform(range({SLOTS}), lambda x: true), CAST(NULL AS BIGINT) FROM prefs
  UNION ALL
  SELECT turn + 1, list_concat(free[1:slot], [false], free[slot + 2:]), slot
  FROM (SELECT turn, free, list_filter(list_transform(range({SLOTS}), lambda j: (start[turn % {len(SHARDS)} + 1] + j * skip[turn % {len(SHARDS)} + 1]) % {SLOTS}), lambda z: free[z + 1])[1] AS slot
    FROM fill, prefs WHERE turn < {SLOTS})
), slots AS (
  SELECT CAST(taken AS INTEGER) AS slot, (turn - 1) % {len(SHARDS)} AS i FROM fill WHERE turn > 0
)
SELECT d.doc_id, slots.slot, names.shard
FROM (SELECT doc_id, CAST(CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) % {SLOTS} AS INTEGER) AS slot FROM documents) d
JOIN slots ON slots.slot = d.slot JOIN names ON names.i = slots.i
"""

OP10 = rf"""
WITH a AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '{WORD}') AS w, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS lines FROM a
), g AS (
  SELECT r, unnest(list_transform(range(len(w) - 2), lambda p: {{'a': w[p + 1], 'b': w[p + 2], 'c': w[p + 3]}})) AS t, unnest(range(len(w) - 2)) AS p FROM w WHERE len(w) >= 4
), h AS (
  SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, t) AS c FROM g) WHERE c > 1
), n AS (
  SELECT r, count(DISTINCT q) AS n_repeat_words FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM h) GROUP BY r
), m AS (
  SELECT w.r, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN n ON n.r = w.r
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN n_words = 0 THEN 0 WHEN 100 * word_chars < 200 * n_words OR 100 * word_chars > 1400 * n_words THEN 3
      WHEN 100 * word_chars < 300 * n_words OR 100 * word_chars > 1000 * n_words THEN 2
      WHEN 100 * word_chars < 350 * n_words OR 100 * word_chars > 800 * n_words THEN 1 ELSE 0 END AS l_length,
    CASE WHEN n_words = 0 THEN 0 WHEN 100 * n_symbols > 30 * n_words THEN 3 WHEN 100 * n_symbols > 10 * n_words THEN 2 WHEN 100 * n_symbols > 5 * n_words THEN 1 ELSE 0 END AS l_symbols,
    CASE WHEN n_words = 0 THEN 0 WHEN 100 * n_dup_lines > 50 * n_lines THEN 3 WHEN 100 * n_dup_lines > 30 * n_lines THEN 2 WHEN 100 * n_dup_lines > 15 * n_lines THEN 1 ELSE 0 END AS l_lines
  FROM m
), hosts AS (
  SELECT source, CAST(count(*) AS DOUBLE) AS n, unnest(['base', 'length', 'symbols', 'lines']) AS rule,
    unnest([CAST(count(*) FILTER (base_failed) AS DOUBLE), CAST(count(*) FILTER (l_length > 1) AS DOUBLE), CAST(count(*) FILTER (l_symbols > 1) AS DOUBLE), CAST(count(*) FILTER (l_lines > 1) AS DOUBLE)]) AS k
  FROM f GROUP BY source
), sums AS (
  SELECT rule, sum(n) AS total, sum(n * n) AS squares, count(*) AS h, sum(k) / sum(n) AS m, sum(k * k / n) AS q FROM hosts GROUP BY rule
), parts AS (
  SELECT rule, m, m * (1 - m) AS spread, q - total * m * m - (h - 1) * m * (1 - m) AS between_hosts, total - squares / total AS scale FROM sums
), prior AS (
  SELECT rule, m, CASE WHEN between_hosts <= 0 OR scale <= 0 THEN 1000000.0 ELSE least(greatest(spread * scale / between_hosts - 1, 1.0), 1000000.0) END AS strength FROM parts
), rates AS (
  SELECT source, rule, (k + m * strength) / (n + strength) AS rate FROM hosts JOIN prior USING (rule)
), blocked AS (
  SELECT source, max(rate) > 0.5 AS blocked FROM rates GROUP BY source
), verdict AS (
  SELECT b.source, max(CASE WHEN rule = 'length' THEN least_level END) AS v_length, max(CASE WHEN rule = 'symbols' THEN least_level END) AS v_symbols, max(CASE WHEN rule = 'lines' THEN least_level END) AS v_lines
  FROM (SELECT source, rule, CASE WHEN rate > 0.25 THEN 1 WHEN rate < 0.1 THEN 3 ELSE 2 END AS of_rate FROM rates) r
  JOIN blocked b ON r.source IS NOT DISTINCT FROM b.source, LATERAL (SELECT CASE WHEN blocked THEN 1 ELSE of_rate END AS least_level) GROUP BY b.source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND l_length < v_length AND l_symbols < v_symbols AND l_lines < v_lines AS kept
FROM f JOIN verdict ON f.source IS NOT DISTINCT FROM verdict.source
"""


OP3 = f"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents
), s AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), k AS (
  SELECT r, doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS id, s FROM s
), c AS (
  SELECT min(doc_id) AS cls, any_value(n) AS n, id, any_value(s) AS s FROM k WHERE n > 0 AND doc_id IS NOT NULL GROUP BY id
), x AS (
  SELECT cls, n, unnest(s) AS g FROM c
), p AS (
  SELECT a.cls AS a, b.cls AS b FROM x a JOIN x b ON a.g = b.g AND a.cls < b.cls GROUP BY a.cls, b.cls, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), e AS (
  SELECT a, b FROM p UNION SELECT b, a FROM p
), reach(a, b) AS (
  SELECT a, a FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b
), m AS (
  SELECT a AS cls, min(b) AS component FROM reach GROUP BY a
)
SELECT k.doc_id, CAST(k.n AS BIGINT) AS n_shingles, CASE WHEN k.n > 0 THEN coalesce(m.component, c.cls) ELSE k.doc_id END AS component_id,
  coalesce(k.doc_id = CASE WHEN k.n > 0 THEN coalesce(m.component, c.cls) ELSE k.doc_id END, true) AS kept
FROM k LEFT JOIN c ON c.id = k.id AND k.n > 0 AND k.doc_id IS NOT NULL LEFT JOIN m ON m.cls = c.cls
"""

OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


#: Each sign of the corpus is one byte here, as the distance counts bytes; beyond 120 signs the query stops.
OP7 = rf"""
WITH d AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents
), o AS (
  SELECT doc_id, unnest(range(len(l))) AS no, trim(unnest(l), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM d
), t AS (
  SELECT doc_id, no, x FROM o WHERE x <> ''
), f AS (
  SELECT x, min({{'d': doc_id, 'n': no}}) AS spot FROM t GROUP BY x
), signs AS (
  SELECT c, row_number() OVER (ORDER BY c) AS i FROM (SELECT DISTINCT unnest(string_split(x, '')) AS c FROM f WHERE length(x) >= 32)
), plain AS (
  SELECT x, string_agg(CASE WHEN i > 120 THEN error('more than 120 signs') ELSE chr(CAST(i AS INTEGER)) END, '' ORDER BY p) AS b, count(*) AS n
  FROM (SELECT x, unnest(string_split(x, '')) AS c, unnest(range(length(x))) AS p FROM f WHERE length(x) >= 32) JOIN signs USING (c) GROUP BY x
), g AS (
  SELECT f.x, spot, b, n FROM f JOIN plain USING (x)
), near AS (
  SELECT DISTINCT later.x FROM g later JOIN (SELECT *, unnest([-2, -1, 0, 1, 2]) AS k FROM g) first ON later.n = first.n + first.k
  WHERE first.spot < later.spot AND levenshtein(later.b, first.b) <= 2
), gone AS (
  SELECT t.doc_id, list(t.no) AS gone FROM t JOIN f USING (x) LEFT JOIN near USING (x)
  WHERE near.x IS NOT NULL OR f.spot <> {{'d': t.doc_id, 'n': t.no}} GROUP BY t.doc_id
), r AS (
  SELECT d.doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
    CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(len(l)), lambda i: NOT list_contains(gone, i)), lambda i: l[i + 1]), chr(10)) END AS text
  FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id
)
SELECT doc_id, n_lines, n_removed, text FROM r WHERE n_removed = 0 OR regexp_matches(text, '{WORD}')
"""

OP8 = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_minhash_dedup": OP3, "op4_mixing_sources": OP4, "op5_va_file_top_k": OP5, "op7_line_dedup_join": OP7, "op8_warc_captures": OP8, "op9_shard_lookup": OP9, "op10_host_rules": OP10}
