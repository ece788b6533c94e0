"""DuckDB SQL for the rows of the operators that SQL can express, over the table ``documents``."""

from __future__ import annotations

from . import decontam, jaccard, lines, suffix_dedup

_TOKENS = "list_filter(regexp_split_to_array(lower({0}), '{1}'), lambda w: w <> '')"


def near_duplicates() -> str:
    """All pairs that share a shingle are compared."""
    k = jaccard.WORDS
    return rf"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, {_TOKENS.format('text', chr(92) + 's+')} AS ws FROM documents),
spread AS (SELECT r, CASE WHEN coalesce(len(ws), 0) = 0 THEN [] WHEN len(ws) < {k} THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(ws) - {k - 1}), lambda i: array_to_string(ws[i : i + {k - 1}], ' '))) END AS shingles FROM w),
sets AS (SELECT r, len(shingles) AS n, md5(array_to_string(list_sort(shingles), chr(10))) AS key FROM spread WHERE len(shingles) > 0),
each AS (SELECT r, unnest(shingles) AS s FROM spread),
meets AS (SELECT a.r AS ra, b.r AS rb, count(*) AS c FROM each a JOIN each b ON a.s = b.s AND a.r <> b.r GROUP BY ALL),
links AS (SELECT ra, rb, x.key AS ka, y.key AS kb FROM meets JOIN sets x ON x.r = ra JOIN sets y ON y.r = rb WHERE c / (x.n + y.n - c) >= CAST({jaccard.THRESHOLD} AS DOUBLE)),
reach AS (SELECT r, r AS o FROM w UNION SELECT reach.r, rb FROM reach JOIN links ON ra = o),
classes AS (SELECT reach.r, min(w.doc_id) AS class_id FROM reach JOIN w ON w.r = o GROUP BY reach.r),
counts AS (SELECT ra AS r, count(*) AS n_links, count(DISTINCT CASE WHEN ka <> kb THEN kb END) AS n_text_links FROM links GROUP BY ra)
SELECT w.doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(n_text_links, 0) AS n_text_links FROM w JOIN classes USING (r) LEFT JOIN counts USING (r)"""


def overlaps() -> str:
    """All windows of all items at all places of all texts, without seeds."""
    token = r"[^\p{L}\p{N}]+"
    least = f"CAST({decontam.MIN_SHARE} AS DOUBLE)"
    return rf"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, h FROM (SELECT DISTINCT doc_id, {_TOKENS.format('text', token)} AS h FROM documents)),
items AS (SELECT row_number() OVER () AS q, item_id, ws, len(ws) AS n, least(len(ws), {decontam.WINDOW}) AS size FROM (SELECT DISTINCT item_id, {_TOKENS.format('text', token)} AS ws FROM benchmark) WHERE len(ws) > 0),
doc_words AS (SELECT r, unnest(h) AS w, unnest(generate_series(0, len(h) - 1)) AS p FROM docs WHERE len(h) > 0),
item_words AS (SELECT q, unnest(ws) AS w, unnest(generate_series(0, n - 1)) AS i FROM items),
met AS (SELECT r, q, p - i AS shift, list(i) AS same FROM doc_words JOIN item_words USING (w) GROUP BY ALL),
near AS (SELECT r, q, item_id, n, size, shift, same FROM met JOIN items USING (q) WHERE len(same) / size >= {least}),
placed AS (SELECT r, item_id, size, shift, same, unnest(generate_series(0, n - size)) AS b FROM near),
counted AS (SELECT r, item_id, size, shift, b, len(list_filter(same, lambda i: i >= b AND i < b + size)) AS words FROM placed),
best AS (SELECT doc_id, item_id, count(*) AS n_windows, max(struct_pack(share := words / size, words := words, place := -greatest(0, b + shift))) AS x FROM counted JOIN docs USING (r) WHERE words / size >= {least} GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_windows, x.words AS overlap_words, x.share AS overlap_share, -x.place AS doc_word FROM best"""


def repeats() -> str:
    """Every window of every text is counted, as hexadecimal digits."""
    n = suffix_dedup.LENGTH
    return f"""WITH raws AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
places AS (SELECT r, x, unnest(generate_series(0, len(x) // 2 - {n})) AS a FROM raws WHERE len(x) // 2 >= {n}),
hashed AS (SELECT r, a, hash(substr(x, 2 * a + 1, {2 * n})) AS h FROM places),
twice AS (SELECT h FROM hashed GROUP BY h HAVING count(*) > 1),
starts AS (SELECT r, a FROM hashed SEMI JOIN twice USING (h)),
fresh AS (SELECT r, a, CASE WHEN a - lag(a) OVER (PARTITION BY r ORDER BY a) <= {n} THEN 0 ELSE 1 END AS f FROM starts),
runs AS (SELECT r, a, sum(f) OVER (PARTITION BY r ORDER BY a) AS g FROM fresh),
spans AS (SELECT r, g, min(a) AS b, max(a) + {n} AS e FROM runs GROUP BY r, g),
gaps AS (SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY b), 0) AS b, b AS e FROM spans UNION ALL SELECT r, max(e), NULL FROM spans GROUP BY r),
pieces AS (SELECT r, b, CASE WHEN gaps.e IS NULL THEN substr(x, 2 * b + 1) ELSE substr(x, 2 * b + 1, 2 * (gaps.e - b)) END AS p FROM gaps JOIN raws USING (r)),
whole AS (SELECT r, b, p, regexp_replace(regexp_replace(p, '^([89AB][0-9A-F])+', ''), '([CD][0-9A-F]|E[0-9A-F]([89AB][0-9A-F])?|F[0-9A-F]([89AB][0-9A-F])?([89AB][0-9A-F])?)$', '') AS w FROM pieces),
kept AS (SELECT r, string_agg(p, '' ORDER BY b) AS k, string_agg(w, '' ORDER BY b) AS t FROM whole GROUP BY r),
sums AS (SELECT r, sum(e - b) AS removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, x))) AS kept_sha256, decode(unhex(coalesce(t, x))) AS kept_text FROM raws LEFT JOIN sums USING (r) LEFT JOIN kept USING (r)"""


ORACLE_SQL = {
    "op4_jaccard": near_duplicates(),
    "op5_lines": lines.sql(),
    "op8_decontam": overlaps(),
    "op10_suffix_dedup": repeats(),
}
