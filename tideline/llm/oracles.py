"""DuckDB SQL for the queries of this subpackage that SQL can express, written from their contracts and not from the operators."""

OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n FROM pages),
     q AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY body) END AS first_id FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM q
"""

#: Windows of 200 bytes on the hexadecimal text; starts of repeated ones are joined to runs.
OP5_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, ''))::BIGINT AS n, hex(coalesce(text, '')) AS x FROM documents),
     w AS (SELECT r, k, md5(substr(x, 2 * k + 1, 400)) AS m FROM (SELECT r, x, unnest(range(0, n - 199)) AS k FROM d WHERE n >= 200)),
     t AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY m) AS c FROM w) WHERE c > 1),
     g AS (SELECT r, k, sum(fresh) OVER (PARTITION BY r ORDER BY k) AS g FROM (SELECT r, k, CASE WHEN k <= lag(k) OVER (PARTITION BY r ORDER BY k) + 200 THEN 0 ELSE 1 END AS fresh FROM t)),
     s AS (SELECT r, g, min(k) AS a, max(k) + 200 AS b FROM g GROUP BY r, g),
     e AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM s),
     c AS (SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM e JOIN d USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN c USING (r)
"""

#: References of all labelled texts, each with its shares in units of 2**-32; the label * stands for all together.
OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, CAST(lang AS VARCHAR) AS lang, text IS NOT NULL AND text <> '' AS filled, coalesce(text, '') AS t FROM documents),
     w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
                  [len(regexp_replace(t, '[^' || p || ']', '', 'g')) FOR p IN ['a-z', '\x20\x09-\x0D', 'A-Z', '.,;:!?''"()\-', '0-9']] AS five, len(regexp_replace(t, '[\x00-\x7F]', '', 'g')) AS other FROM d),
     c AS (SELECT * EXCLUDE (five, other), list_concat(five, [len(t) - other - list_sum(five)::BIGINT, other]) AS classes FROM w),
     f AS (SELECT *, [CASE WHEN len(t) > 0 THEN x / len(t) ELSE 0 END FOR x IN classes] AS shares FROM c),
     a AS (SELECT lang AS label, k, sum(CAST(floor(shares[k] * 4294967296 + 0.5) AS BIGINT)) AS s FROM (SELECT *, unnest(range(1, 8)) AS k FROM f WHERE lang IS NOT NULL AND filled) GROUP BY 1, 2),
     a2 AS (SELECT * FROM a UNION ALL SELECT '*', k, sum(s) FROM a GROUP BY k),
     rc AS (SELECT label, list(s / t ORDER BY k) AS ref_classes FROM (SELECT *, sum(s) OVER (PARTITION BY label) AS t FROM a2) GROUP BY label),
     v AS (SELECT lang AS label, lower(x) AS word, sum(share) AS share FROM (SELECT lang, unnest(w) AS x, CAST(floor(4294967296.0::DOUBLE * (1.0::DOUBLE / len(w)) + 0.5) AS BIGINT) AS share FROM f WHERE lang IS NOT NULL AND filled) GROUP BY 1, 2),
     v2 AS (SELECT * FROM v UNION ALL SELECT '*', word, sum(share) FROM v GROUP BY word),
     v3 AS (SELECT *, sum(share) OVER (PARTITION BY label) AS total, row_number() OVER (PARTITION BY label ORDER BY share DESC, encode(word)) AS nth FROM v2),
     rw AS (SELECT label, list(word ORDER BY nth) AS common, list(share::DOUBLE / total ORDER BY nth) AS ref_words FROM v3 WHERE nth <= 24 GROUP BY label),
     g AS (SELECT f.*, len(w)::BIGINT AS n_words, rc.ref_classes, rw.common, list_append(rw.ref_words, greatest(0, 1 - list_sum(rw.ref_words))) AS ref_words
           FROM f LEFT JOIN rc ON rc.label = CASE WHEN f.lang IN (SELECT label FROM rc) THEN f.lang ELSE '*' END LEFT JOIN rw ON rw.label = rc.label),
     q AS (SELECT r, count(DISTINCT k + o)::BIGINT AS n FROM (SELECT r, k, unnest(range(0, 8)) AS o FROM (SELECT r, k, count(*) OVER (PARTITION BY r, win) AS c FROM (SELECT r, k, list_slice(w, k, k + 7) AS win FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS k FROM c WHERE len(w) > 8))) WHERE c > 1) GROUP BY r),
     hw AS (SELECT r, i, count(*) AS n FROM (SELECT r, list_position(common, lower(x)) AS i FROM (SELECT r, common, unnest(w) AS x FROM g WHERE n_words >= 100)) WHERE i IS NOT NULL GROUP BY r, i),
     wp AS (SELECT g.r, g.ref_words, list_transform(range(1, len(g.ref_words)), lambda i: coalesce(m[i], 0)::DOUBLE) AS each, n_words FROM g LEFT JOIN (SELECT r, map(list(i), list(n)) AS m FROM hw GROUP BY r) USING (r) WHERE n_words >= 100),
     js AS (SELECT r, 'w' AS kind, ref_words AS q, [x / n_words FOR x IN list_append(each, n_words - coalesce(list_sum(each), 0))] AS p FROM wp UNION ALL SELECT r, 'c', ref_classes, shares FROM g WHERE n_words >= 30),
     jd AS (SELECT r, kind, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS dist FROM (SELECT r, kind, unnest(p) AS p, unnest(q) AS q FROM js) GROUP BY r, kind),
     z AS (SELECT r, max(dist) FILTER (WHERE kind = 'c') AS dc, max(dist) FILTER (WHERE kind = 'w') AS dw FROM jd GROUP BY r),
     o AS (SELECT doc_id, n_words, len(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(q.n, 0)::BIGINT AS n_repeat_words, dc, dw
           FROM g LEFT JOIN q USING (r) LEFT JOIN z USING (r))
SELECT *  EXCLUDE (dc, dw), n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, round(dc, 6) AS chars_distance, round(dw, 6) AS words_distance,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND coalesce(dc <= 0.34, true) AND coalesce(dw <= 0.42, true) AS kept
FROM o
"""

#: Document windows of each length that item windows have, joined by their words.
OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     i AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, list_slice(w, k, k + least(10, len(w)) - 1) AS win FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
     p AS (SELECT r, k, n, list_slice(w, k, k + n - 1) AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
     m AS (SELECT r, k, p.n, item_id FROM p JOIN i USING (win)),
     h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS q FROM m) GROUP BY r),
     s AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN s USING (r)
"""

#: Hashes of words are the first 64 bits of MD5; sums of products with powers of the factor modulo 2**64 (its own powers are written out). A sketch is a sorted list of hashes.
_FACTORS = [pow(0x9E3779B97F4A7C15, j, 2**64) for j in range(5)]
OP12_SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST, encode(coalesce(text, ''))) AS r, doc_id, coalesce(text, '') AS t FROM documents),
     e AS MATERIALIZED (SELECT *, coalesce(lead(r) OVER (ORDER BY r), 1) AS s, coalesce(lead(t) OVER (ORDER BY r), first_value(t) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS u FROM d),
     x AS MATERIALIZED (SELECT r, false AS new, t FROM e UNION ALL SELECT r, true, substr(t, 1, length(t) - length(t) // 3) || substr(u, 1, length(t) // 3) FROM e),
     w AS (SELECT r, new, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM x),
     n AS (SELECT r, new, len(w) AS n, [('0x' || md5(v)[:16])::UBIGINT::UHUGEINT FOR v IN w] AS h FROM w),
     k AS (SELECT *, unnest(range(1, greatest(n - 4, 1) + 1)) AS k FROM n WHERE n > 0),
     g AS (SELECT DISTINCT r, new, ({' + '.join(f"coalesce(h[k + {j}], 0) * {f}::UHUGEINT % 18446744073709551616::UHUGEINT" for j, f in enumerate(_FACTORS))}) % 18446744073709551616::UHUGEINT AS g FROM k),
     f AS (SELECT r, new, g FROM (SELECT *, min(g) OVER (PARTITION BY r, new) AS least FROM g) WHERE g < 2305843009213693952::UHUGEINT OR g = least AND least >= 2305843009213693952::UHUGEINT),
     l AS MATERIALIZED (SELECT r, new, list(g ORDER BY g) AS l, string_agg(printf('%016x', g::UBIGINT), '' ORDER BY g) AS f FROM f GROUP BY r, new),
     p AS (SELECT e.r, e.doc_id, length(e.t) AS n_chars, sha256(x.t) AS edited_sha256, coalesce(a.f, '') AS fingerprint, coalesce(b.f, '') AS edited_fingerprint, coalesce(a.l, []) AS a, coalesce(b.l, []) AS b, coalesce(c.l, []) AS c
           FROM e JOIN x ON x.r = e.r AND x.new LEFT JOIN l a ON a.r = e.r AND NOT a.new LEFT JOIN l b ON b.r = e.r AND b.new LEFT JOIN l c ON c.r = e.s AND NOT c.new),
     i AS (SELECT *, len(list_intersect(a, b)) AS ab, len(list_intersect(a, c)) AS ac FROM p)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE ab::DOUBLE / (len(a) + len(b) - ab) END::DOUBLE AS near_edited, CASE WHEN len(a) + len(c) = 0 THEN 1.0 ELSE ac::DOUBLE / (len(a) + len(c) - ac) END::DOUBLE AS near_next,
       CASE WHEN len(a) > 0 THEN ab::DOUBLE / len(a) WHEN len(b) > 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS held_edited, CASE WHEN len(a) > 0 THEN ac::DOUBLE / len(a) WHEN len(c) > 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS held_next
FROM i
"""

_ROUND = """,
     a{n} AS MATERIALIZED (SELECT r, p, min(CAST(xx - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS BIGINT) * 256 + e) AS m FROM x JOIN b{n} USING (p) GROUP BY r, p)"""
_MOVE = """,
     f{n} AS MATERIALIZED (SELECT p, m % 256 AS e, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, m, v, unnest(range(1, len(v) + 1)) AS i FROM a{n} JOIN x USING (r, p)) GROUP BY ALL),
     b{m} AS MATERIALIZED (SELECT p, e, coalesce(k, c) AS c FROM b{n} LEFT JOIN (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS k FROM f{n} GROUP BY p, e) USING (p, e))"""

#: Distances are whole numbers below 2**53, so products of lists of doubles are exact; the smallest of distance * 256 + index is the nearest entry.
OP13_SQL = (
    """
WITH q AS (SELECT vec_id, label, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     k AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, q) AS r FROM q),
     x AS MATERIALIZED (SELECT r, p, v, list_inner_product(v, v) AS xx FROM (SELECT r, p, list_slice(q, (p * len(q)) // 4 + 1, ((p + 1) * len(q)) // 4) AS v FROM k, range(4) t(p))),
     b0 AS MATERIALIZED (SELECT p, r - 1 AS e, v AS c FROM x WHERE r <= 256)"""
    + "".join(_ROUND.format(n=n) + _MOVE.format(n=n, m=n + 1) for n in range(4))
    + _ROUND.format(n=4)
    + """,
     c AS (SELECT r, string_agg(printf('%02x', m % 256), '' ORDER BY p) AS code, sum(m // 256)::BIGINT AS error FROM a4 GROUP BY r),
     h AS (SELECT sha256(string_agg(t, ',' ORDER BY p, e)) AS codebooks_sha256 FROM (SELECT p, e, array_to_string([y::BIGINT FOR y IN c], ',') AS t FROM b4))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN c USING (r), h
"""
)

ORACLES: dict[str, str] = {"op2_warc": OP2_SQL, "op5_suffix_repeats": OP5_SQL, "op8_quality_divergence": OP8_SQL, "op9_decontaminate": OP9_SQL, "op12_scaled_sketch": OP12_SQL, "op13_vector_codes": OP13_SQL}
