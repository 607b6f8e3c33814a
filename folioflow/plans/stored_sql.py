"""DuckDB SQL with the same results as the queries of stored_queries.py: what the store must give, worked out from the plain tables."""

from __future__ import annotations

from .corpus_sql import using
from .more_sql import _KNOWN, _URL
from .sql import _NOW, _search

_NODES = """parts AS (SELECT *, unnest(range(3, len(string_split(path, '/')) + 1)) AS n FROM source_pages WHERE status = 'active'),
      cut AS (SELECT *, array_to_string(string_split(path, '/')[:n], '/') AS node FROM parts),
      nodes AS (SELECT node AS path, n - 2 AS depth, bool_or(node = path) AS is_page, bool_or(node <> path) AS has_children, max(title) FILTER (node = path) AS title, count(*) AS pages FROM cut GROUP BY node, n)"""
_PAGES = "p AS (SELECT page_id, count(*) AS n FROM content_blocks GROUP BY page_id)"

_DISCOVERED = using("source_pages", f"""
      SELECT {_URL} AS canonical_url, CASE WHEN page_id % 3 > 0 THEN '2024-01-1' || page_id % 3 END AS last_modified FROM source_pages
      WHERE page_id % 11 <> 5 AND NOT (starts_with(path, '/docs/de') AND NOT starts_with(path, '/docs/de/web')) AND NOT regexp_matches(path, '^/docs/.*/.*/1')""")

STORED_SQL: dict[str, str] = {
    "search_indexed": _search("the", False, whole=True),
    "search_indexed_rare": _search("mit license", False, whole=True),
    "page_store_upserts": using("source_pages", f"""
      WITH {_KNOWN}, f AS (SELECT {_URL} || o AS canonical_url, path || o AS path FROM (SELECT *, CASE WHEN page_id % 4 = 0 THEN '/new' ELSE '' END AS o FROM source_pages WHERE page_id % 2 = 0)),
      a AS (SELECT {_URL} || CASE WHEN page_id % 10 = 0 THEN '/asked' ELSE '' END AS canonical_url, path || '/asked' AS path FROM source_pages WHERE page_id % 5 = 0),
      one AS (SELECT canonical_url, coalesce(f.path, known.path) AS path, CASE WHEN f.path IS NOT NULL THEN {_NOW} ELSE last_discovered_at END AS last_discovered_at, CASE WHEN f.path IS NULL THEN missing_since END AS missing_since
        FROM known FULL JOIN f USING (canonical_url)),
      two AS (SELECT canonical_url, coalesce(a.path, one.path) AS path, last_discovered_at, missing_since FROM one FULL JOIN a USING (canonical_url))
      SELECT canonical_url, path, last_discovered_at, CASE WHEN missing_since IS NULL AND (last_discovered_at IS NULL OR last_discovered_at < {_NOW} - INTERVAL 1 DAY) THEN {_NOW} ELSE missing_since END AS missing_since FROM two"""),
    "publish_commits": using("content_blocks", f"""
      WITH {_PAGES}
      SELECT page_id, 'published' AS decision, CAST(1 AS BIGINT) AS version, CAST(0 AS BIGINT) AS "commit" FROM p
      UNION ALL SELECT page_id, CASE WHEN page_id % 3 = 1 THEN 'published' ELSE 'unchanged' END, CASE WHEN page_id % 3 = 1 THEN 2 ELSE 1 END, 1 FROM p WHERE page_id % 3 = 2 OR page_id % 3 = 1 AND n > 1
      UNION ALL SELECT page_id, CASE WHEN page_id % 3 = 1 AND n > 1 THEN 'restored' ELSE 'unchanged' END, 1, 2 FROM p WHERE page_id % 2 = 0"""),
    # the second version of a page has its blocks but the first, each with the state it had; fingerprints of a page that occur twice may pair otherwise, so states are the same for all of a page
    "published_blocks": using("fingerprints block_translations", f"""
      WITH {_PAGES}, s AS (SELECT DISTINCT page_id, status FROM block_translations JOIN content_blocks USING (block_id)),
      b AS (SELECT f.*, page_id % 3 = 1 AND page_id % 2 = 1 AND n > 1 AS second FROM fingerprints f JOIN p USING (page_id))
      SELECT b.block_id * 10 + CASE WHEN second THEN 1 ELSE 0 END AS block_id, page_id, CAST(CASE WHEN second THEN 2 ELSE 1 END AS BIGINT) AS version, ordinal, fingerprint,
        CASE WHEN NOT translatable THEN NULL WHEN second THEN coalesce(s.status, 'pending') ELSE 'pending' END AS status, t.current_revision_id
      FROM b LEFT JOIN s USING (page_id) LEFT JOIN block_translations t ON second AND t.block_id = b.block_id WHERE NOT second OR ordinal > 0"""),
    "budget_admission_hot": using("token_ledger", """
      WITH o AS (SELECT list(struct_pack(a := "at", r := reservation_id, t := tokens) ORDER BY "at", reservation_id) AS l FROM token_ledger),
      u AS (SELECT l, list_reduce(list_concat([[CAST(0 AS BIGINT)]], list_transform(l, lambda x: [x.t])), lambda s, x: list_append(s, s[-1] + CASE WHEN s[-1] + x[1] <= 1000000 THEN x[1] ELSE 0 END)) AS s FROM o),
      f AS (SELECT unnest(l) AS x, unnest(s[:-2]) AS before, unnest(s[2:]) AS used_after FROM u)
      SELECT 'all' AS usage_date, x.a AS "at", x.r AS reservation_id, x.t AS tokens, before + x.t <= 1000000 AS admitted, used_after FROM f"""),
    "glossary_protected": using("source_pages content_blocks", r"""
      WITH terms AS (SELECT list(DISTINCT lower(w)) AS l FROM (SELECT unnest(regexp_extract_all(title, '[\p{L}\p{N}_]+')) AS w FROM source_pages) WHERE length(w) >= 8),
      b AS (SELECT block_id, block_type, source_text, greatest(instr(source_text, ' ') - 1, 0) AS p FROM content_blocks),
      t AS (SELECT *, list_filter(regexp_extract_all(substr(source_text, p + 1), '[\p{L}\p{N}_]+'), lambda w: list_contains(l, lower(w))) AS found FROM b, terms)
      SELECT block_id, CASE WHEN block_type = 'code' THEN 'not_translatable' END AS error, CAST(CASE WHEN block_type = 'code' THEN 0 ELSE len(found) + CASE WHEN p > 0 THEN 1 ELSE 0 END END AS INTEGER) AS tokens,
        CASE WHEN block_type <> 'code' THEN source_text END AS restored, CASE WHEN block_type <> 'code' THEN CASE WHEN p > 0 THEN left(source_text, p) ELSE found[1] END END AS first_value FROM t"""),
    "reservation_timers": """
      WITH e AS (SELECT event_id AS i, event_type IN ('signup', 'purchase') AS starts, event_type = 'purchase' AS settles, epoch_us(ts) // 1000 AS t, 60000 * CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
          60000 * (event_id % 10) AS s, CAST(floor(value) AS BIGINT) + 1 AS tokens, CASE WHEN event_id % 7 <> 0 THEN event_id % 300 END AS used FROM events),
      f AS (SELECT *, starts AND k < 1800000 AS started, settles AND k < 1800000 AND s < 300000 AS settled FROM e)
      SELECT i AS reservation_id, t AS at_ms, i * 3 AS event_id, 'reserved' AS outcome, CAST(0 AS BIGINT) AS number FROM f
      UNION ALL SELECT i, t + 1800000, NULL, 'released_stale', 0 FROM f WHERE NOT started
      UNION ALL SELECT i, t + k, i * 3 + 1, CASE WHEN started THEN 'request_started' ELSE 'error' END, 0 FROM f WHERE starts
      UNION ALL SELECT i, t + k + 300000, NULL, 'settled_stale', tokens FROM f WHERE started AND NOT settled
      UNION ALL SELECT i, t + k + s, i * 3 + 2, CASE WHEN settled THEN 'settled' WHEN started THEN 'unchanged' ELSE 'error' END, CASE WHEN settled THEN least(tokens, coalesce(used, tokens)) WHEN started THEN tokens ELSE 0 END FROM f WHERE settles""",
    "navigation_all": using("source_pages", f"""
      WITH {_NODES}
      SELECT regexp_replace(path, '/[^/]*$', '') AS parent, path, CASE depth WHEN 1 THEN (SELECT label FROM (VALUES ('en', 'English'), ('de', 'German'), ('fr', 'French'), ('es', 'Spanish')) v(s, label) WHERE s = segment)
        ELSE coalesce(nullif(trim(title), ''), upper(left(segment, 1)) || substr(segment, 2)) END AS label, is_page, has_children
      FROM (SELECT *, regexp_extract(path, '[^/]*$') AS segment FROM nodes)"""),
    "navigation_intervals": using("source_pages", f"""
      WITH {_NODES}, o AS (SELECT *, row_number() OVER (ORDER BY translate(path, '/', chr(1))) - 1 AS pre FROM nodes)
      SELECT path, CAST(depth AS INTEGER) AS depth, pages, pre, pre + (SELECT count(*) FROM nodes n WHERE n.path = o.path OR starts_with(n.path, o.path || '/')) - 1 AS "last" FROM o"""),
    "payloads_stored": f"""
      SELECT event_id AS fetch_id, sha256(coalesce(html, '')) AS hash, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS bytes
      FROM events JOIN pages ON pages.page_id = user_id % (SELECT count(*) FROM pages)
      WHERE event_type IN ('error', 'view') AND ts < {_NOW} AND ts + CASE WHEN event_type = 'error' THEN INTERVAL 7 DAY ELSE INTERVAL 1 DAY END > {_NOW}""",
    "discovered_pages": _DISCOVERED,
    "discovered_again": _DISCOVERED,
    "mirror_pages": using("source_pages", f"""
      SELECT 'https://docs.example.com/maps/' || split_part(path, '/', 3) || '-' || split_part(path, '/', 4) || '-' || page_id // 20000 || '.xml' AS url, CASE WHEN page_id % 11 <> 5 THEN {_URL} END AS canonical_url,
        CASE WHEN page_id % 3 > 0 THEN '2024-01-1' || page_id % 3 END AS last_modified, CASE WHEN page_id % 11 = 5 THEN 'query' END AS error FROM source_pages
      UNION ALL SELECT 'https://docs.example.com/index.xml', NULL, NULL, 'invalid_mirror'"""),
    "policy_store": "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS written FROM events GROUP BY user_id",
}
