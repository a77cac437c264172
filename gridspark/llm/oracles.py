"""DuckDB SQL for queries whose methods are exact: the same rows by plain joins."""

from __future__ import annotations

from . import quality_rules as q

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SMALL = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BLANK = r"[^\x20\x09-\x0D]+"

NGRAM_JOIN = f"""
    WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_SMALL}, '{_BLANK}') AS w FROM documents),
    s AS MATERIALIZED (SELECT r, unnest(CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
    n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
    p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
    l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
    e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
    reach(a, b) AS (SELECT r, r FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
    c AS (SELECT reach.a AS r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY 1)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM d JOIN c USING (r) LEFT JOIN n USING (r)"""

CONTAMINATION = f"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_SMALL}, '{_ALNUM}') AS w FROM documents),
    i AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all({_SMALL}, '{_ALNUM}') AS w FROM benchmark),
    k AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS pos FROM i WHERE len(w) > 0),
    win AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(w[pos:pos + n - 1], ' ') AS g FROM k),
    t AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, (SELECT DISTINCT n FROM win)),
    m AS MATERIALIZED (SELECT r, pos, t.n, item_id FROM t JOIN win ON win.n = t.n AND win.g = array_to_string(w[pos:pos + t.n - 1], ' ')),
    h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(pos, pos + n)) AS p FROM m) GROUP BY r),
    o AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM m WHERE item_id IS NOT NULL) GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN h USING (r) LEFT JOIN o USING (r)"""

QUALITY = f"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_BLANK}') AS w FROM documents),
    g AS (SELECT r, pos, array_to_string(w[pos:pos + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS pos FROM d)),
    f AS (SELECT r, pos, count(*) OVER (PARTITION BY r, g) AS n FROM g),
    rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(pos, pos + 5)) AS p FROM f WHERE n > 1) GROUP BY r),
    l0 AS (SELECT r, source, md5(text) AS h, unnest(string_split(text, chr(10))) AS line FROM d),
    l AS MATERIALIZED (SELECT r, source, h, line, regexp_extract_all(regexp_replace(translate(line, '{_UPPER}', '{_LOWER}'), '[0-9]', '0', 'g'), '{_BLANK}') AS w FROM l0),
    lw AS MATERIALIZED (SELECT r, source, h, line, array_to_string(w, ' ') AS plain, len(w) AS n FROM l WHERE len(w) > 0),
    dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lw GROUP BY r),
    lim AS (SELECT source, greatest({q.LIMIT_DOCS}, {q.LIMIT_SHARE} * count(DISTINCT text)) AS lim FROM d GROUP BY source),
    fr AS (SELECT lw.source, plain FROM lw JOIN lim ON lim.source IS NOT DISTINCT FROM lw.source GROUP BY lw.source, plain, lim HAVING count(DISTINCT h) > lim),
    lost AS (SELECT r, sum(n) AS n_removed_words FROM lw JOIN fr ON fr.plain = lw.plain AND fr.source IS NOT DISTINCT FROM lw.source GROUP BY r),
    x AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
      coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_removed_words, 0)::BIGINT AS n_removed_words
      FROM d LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN lost USING (r))
    SELECT *, (n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > {q.REPEAT_PERCENT} * n_words) AS base_failed,
      NOT (n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > {q.REPEAT_PERCENT} * n_words) AND n_words - n_removed_words >= {q.LEAST_LEFT} * n_words AS kept FROM x"""
