"""DuckDB SQL with the same results as the queries of this subpackage, where SQL can express them."""

from __future__ import annotations

from .quality_rules import STOP_WORDS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)

QUALITY_SQL = rf"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), wins AS (
  SELECT r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM base WHERE len(w) >= 3)
), dup AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM wins) WHERE n > 1
), rep AS (
  SELECT r, count(DISTINCT i + k) AS n FROM dup, (VALUES (0), (1), (2)) AS o(k) GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS caps,
    length(t) - length(replace(t, '!', '')) AS bangs,
    len(list_filter(w, lambda x: translate(x, '{_UPPER}', '{_LOWER}') IN ({_STOP}))) AS stops,
    len(lines) AS n_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•|]'))) AS bullets
  FROM base LEFT JOIN rep USING (r)
), v AS (
  SELECT *, greatest(n_words, 1) AS d, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_symbols / d <= 0.1 AND bangs / d <= 0.5 AND caps / greatest(word_chars, 1) <= 0.3
  AND word_chars / d >= 2.0 AND word_chars / d <= 25.0 AND stops / d >= 0.02
  AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AND bullets / greatest(n_lines, 1) <= 0.9 AS kept
FROM v
"""

_ALNUM = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT DISTINCT item_id, {_ALNUM} AS w FROM benchmark),
items AS (SELECT item_id, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0),
wins AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM items)
),
sizes AS (SELECT DISTINCT k FROM wins),
dwins AS (
  SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)
),
found AS (SELECT r, i, k, item_id FROM dwins JOIN wins USING (k, g)),
hit AS (SELECT r, count(DISTINCT i + o) AS n FROM (SELECT r, i, unnest(range(0, k)) AS o FROM found) GROUP BY r),
names AS (
  SELECT r, count(DISTINCT item_id) AS n, string_agg(item_id, ',' ORDER BY item_id) AS s
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM found WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(names.n, 0) AS BIGINT) AS n_items, sha256(coalesce(names.s, '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN names USING (r)
"""

WARC_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages
), f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM f
"""

# crc32 isn't a DuckDB function: a table of the 256 byte values' remainders, then one step for each byte.
_CRC32 = """
bytes AS (
  SELECT i, list_reduce(list_concat([CAST(i AS BIGINT)], range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(3988292384, a // 2) ELSE a // 2 END) AS v
  FROM range(256) AS t(i)
), steps AS (SELECT list(v ORDER BY i) AS tab FROM bytes),
crc AS (
  SELECT doc_id, xor(4294967295, list_reduce(
      list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda a, c: xor(a // 256, tab[CAST(xor(a % 256, c) AS INTEGER) + 1]))) AS h
  FROM (SELECT DISTINCT doc_id FROM documents), steps
)
"""

LM_SQL = rf"""
WITH {_CRC32},
d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(h % 10, -1) <> 0 AS train,
    list_concat([' begin'], regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+'), [' end']) AS w
  FROM documents LEFT JOIN crc USING (doc_id)
), tok AS (SELECT r, train, i, w[i] AS t, w[i - 1] AS h, w[i - 2] AS g FROM (SELECT r, train, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
uni AS (SELECT t, count(*) AS c FROM tok WHERE train GROUP BY t),
bi AS (SELECT h, t, count(*) AS c FROM tok WHERE train AND i > 1 GROUP BY h, t),
tri AS (SELECT g, h, t, count(*) AS c FROM tok WHERE train AND i > 2 GROUP BY g, h, t),
tot AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM uni WHERE t <> ' begin'),
s AS (
  SELECT tok.r, coalesce(u.c, 0) AS c, coalesce(b.c, 0) AS c2, coalesce(ctx.c, 0) AS ch, coalesce(q.c, 0) AS c3, coalesce(ctx2.c, 0) AS ch2, n, v,
    CASE WHEN u.c > 0 THEN (u.c - 0.7::DOUBLE) / n ELSE 0.7::DOUBLE * v / n END AS p1
  FROM tok CROSS JOIN tot LEFT JOIN uni u ON u.t = tok.t LEFT JOIN uni ctx ON ctx.t = tok.h LEFT JOIN bi b ON b.h = tok.h AND b.t = tok.t
    LEFT JOIN bi ctx2 ON tok.i > 2 AND ctx2.h = tok.g AND ctx2.t = tok.h LEFT JOIN tri q ON tok.i > 2 AND q.g = tok.g AND q.h = tok.h AND q.t = tok.t
  WHERE tok.i > 1
), p AS (SELECT *, (c2 + 100::DOUBLE * p1) / (ch + 100::DOUBLE) AS p2 FROM s), a AS (
  SELECT r, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, any_value(n) AS train_tokens,
    fsum(log10((c + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)))) AS base_score, fsum(log10((c3 + 100::DOUBLE * p2) / (ch2 + 100::DOUBLE))) AS score
  FROM p GROUP BY r
)
SELECT doc_id, NOT train AS held_out, n_tokens, n_known, train_tokens, round(base_score, 6) AS base_score, round(score, 6) AS score
FROM d JOIN a USING (r)
"""

# Near words meet where one lacks a code point of the other, or both lack one at the same place.
SPELLING_SQL = rf"""
WITH RECURSIVE bytes AS (
  SELECT i, list_reduce(list_concat([CAST(i AS BIGINT)], range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(3988292384, a // 2) ELSE a // 2 END) AS v
  FROM range(256) AS t(i)
), steps AS (SELECT list(v ORDER BY i) AS tab FROM bytes),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(r, '{_UPPER}', '{_LOWER}') AS w, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents) GROUP BY 1, 2
), hashed AS (
  SELECT w, c, xor(4294967295, list_reduce(
    list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(id || ':' || w, ''),
      lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(192 + unicode(x) // 64 AS BIGINT), CAST(128 + unicode(x) % 64 AS BIGINT)] END))),
    lambda a, x: xor(a // 256, tab[CAST(xor(a % 256, x) AS INTEGER) + 1]))) AS h
  FROM runs, steps
), words AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n
  FROM (SELECT c, CASE WHEN h % 199 = 0 THEN left(w, CAST(h % length(w) AS INTEGER)) || substr(w, CAST(h % length(w) AS INTEGER) + 2) ELSE w END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5
), gaps AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS g FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word AS u, b.word AS v, b.n FROM gaps a JOIN gaps b ON a.i = b.i AND a.g = b.g AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.g = b.word
  UNION SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.g = b.word
), best AS (
  SELECT u, count(*) AS n_near, max(n) AS top FROM near GROUP BY u
), form AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN top >= 5 * w.n THEN (SELECT min(v) FROM near WHERE near.u = w.word AND near.n = best.top) END AS form,
    CASE WHEN top >= 5 * w.n THEN top END AS form_n
  FROM words w LEFT JOIN best ON best.u = w.word
), chain AS (
  SELECT word, word AS tip, 0 AS step FROM form
  UNION ALL SELECT c.word, f.form, c.step + 1 FROM chain c JOIN form f ON f.word = c.tip WHERE f.form IS NOT NULL
), root AS (SELECT word, arg_max(tip, step) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM form JOIN root USING (word)
"""

_DIMS, _CLUSTERS, _ROUNDS = 64, 40, 5


def _kmeans_sql() -> str:
    """Each round as tables: d distances, a assignments, c the next centroids."""
    parts = [
        f"""x AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {_DIMS} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {_DIMS})""",
        f"l AS (SELECT r, unnest(range({_DIMS})) AS i, unnest(v) AS q FROM x)",
        f"s AS (SELECT r, row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS k FROM x QUALIFY k < {_CLUSTERS})",
        "c0 AS (SELECT k, i, q FROM s JOIN l USING (r))",
    ]
    for n in range(_ROUNDS + 1):
        parts += [
            f"d{n} AS (SELECT l.r, k, CAST(sum((l.q - c.q) * (l.q - c.q)) AS BIGINT) AS d FROM l JOIN c{n} c USING (i) GROUP BY l.r, k)",
            f"a{n} AS (SELECT r, k, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)",
            f"m{n} AS (SELECT k, i, CAST(sum(q) AS BIGINT) AS t, count(*) AS n FROM l JOIN a{n} USING (r) GROUP BY k, i)",
            f"c{n + 1} AS (SELECT k, i, coalesce((t - ((t % n + n) % n)) // n, q) AS q FROM c{n} LEFT JOIN m{n} USING (k, i))",
        ]
    return f"""
WITH {", ".join(parts)},
h AS (SELECT k, sha256(string_agg(CAST(q AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{_ROUNDS} GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM x JOIN a{_ROUNDS} USING (r) JOIN h USING (k)
"""


ORACLE_SQL = {
    "op11_spelling_variants": SPELLING_SQL,
    "op12_centroid_clustering": _kmeans_sql(),
    "op2_quality_rules": QUALITY_SQL,
    "op4_lm_scoring": LM_SQL,
    "op6_benchmark_decontamination": DECONTAMINATION_SQL,
    "op7_warc_assembly": WARC_SQL,
}
