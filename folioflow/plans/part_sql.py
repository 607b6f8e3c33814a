"""DuckDB SQL with the same results as the queries of part_queries.py."""

from __future__ import annotations

from .corpus_sql import using

_RECOGNIZABLE = r"(regexp_matches(text, '(?m)^#{1,6}\s+\S') OR len(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda p: trim(p) <> '')) >= 2 OR length(trim(text)) >= 80)"

PART_SQL: dict[str, str] = {
    "fetch_results": rf"""
      WITH t AS (SELECT doc_id, [200, 200, 404, 406, 304, 410, 200, 503][doc_id % 8 + 1] AS st, doc_id % 3 < 2 AS plain, coalesce({_RECOGNIZABLE}, false) AS known,
          [200, 200, 404, 500, 200][doc_id % 5 + 1] AS sh, doc_id % 4 < 2 AS html, doc_id % 13 = 0 OR coalesce(regexp_full_match(text, '\s*'), true) AS blank FROM documents),
      f AS (SELECT *, st IN (404, 406) OR st = 200 AND NOT (plain AND known) AS fallback FROM t)
      SELECT doc_id, CASE WHEN fallback THEN CASE WHEN sh = 404 THEN 'gone' WHEN sh = 500 OR NOT html OR blank THEN 'failed' ELSE 'content' END
          WHEN st = 304 THEN 'not_modified' WHEN st = 410 THEN 'gone' WHEN st = 503 THEN 'failed' ELSE 'content' END AS kind, CASE WHEN fallback THEN 'html' ELSE 'text' END AS format,
        CASE WHEN fallback THEN CASE WHEN sh = 404 THEN NULL WHEN sh = 500 THEN 'server_error' WHEN NOT html THEN 'content_type_invalid' WHEN blank THEN 'content_empty' END WHEN st = 503 THEN 'server_error' END AS error FROM f""",
    "prompt_active": "SELECT 3 AS version, r_name || ': {{sourceText}}' AS template FROM region WHERE r_regionkey = 2",
    "prompt_creation": """
      WITH n AS (SELECT 5 + row_number() OVER (ORDER BY n_nationkey) AS version, n_name || ' {{sourceText}}' AS template FROM nation WHERE n_nationkey % 3 <> 2),
      a AS (SELECT r_regionkey + 1 AS version, r_name || ': {{sourceText}}' AS template FROM region UNION ALL SELECT * FROM n)
      SELECT CAST(version AS INTEGER) AS version, template, version = (SELECT max(version) FROM a) AS active FROM a""",
    "budget_settlements": using("token_ledger", """
      WITH r AS (SELECT CASE WHEN event_id % 19 = 0 THEN -event_id - 1 ELSE event_id END AS reservation_id, CASE WHEN event_id % 5 > 0 THEN CASE WHEN event_id % 23 = 1 THEN -1 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END END AS i, user_id AS o FROM events),
      x AS (SELECT r.reservation_id, i, o, tokens, input_tokens, output_tokens, CASE WHEN i < 0 THEN 'invalid_report' WHEN status IS NULL THEN 'missing_reservation' WHEN status = 'released' THEN 'released_reservation' WHEN status = 'settled' THEN 'unchanged' ELSE 'settled' END AS outcome
        FROM r LEFT JOIN token_ledger USING (reservation_id))
      SELECT reservation_id, outcome, CAST(CASE outcome WHEN 'settled' THEN least(tokens, coalesce(i + o, tokens)) WHEN 'unchanged' THEN least(tokens, coalesce(input_tokens + output_tokens, tokens)) END AS BIGINT) AS charged FROM x"""),
    "sessions_deleted": """
      SELECT event_id AS session_id, user_id FROM events e
      WHERE user_id % 10 <> 0 AND CASE WHEN user_id % 10 = 1 AND event_id % 50 = 7 THEN true ELSE event_type <> 'purchase' END
        AND NOT EXISTS (SELECT 1 FROM events k WHERE k.user_id = e.user_id AND k.user_id % 10 = 1 AND k.event_id % 50 = 7 AND k.event_id <> e.event_id)""",
    "current_block_list": using("source_pages fingerprints block_translations", """
      SELECT path, ordinal, f.block_id, fingerprint, t.status, t.current_revision_id FROM fingerprints f JOIN source_pages p USING (page_id) LEFT JOIN block_translations t ON t.block_id = f.block_id WHERE translatable AND page_id % 5 <> 0"""),
    "snapshots": using("source_pages fingerprints", """
      SELECT page_id, path, sha256(string_agg(ordinal || ':' || block_type || ':' || fingerprint, ',' ORDER BY ordinal)) AS snapshot, count(fingerprint) AS n_blocks FROM source_pages LEFT JOIN fingerprints USING (page_id) GROUP BY page_id, path"""),
    "restored_outputs": using("content_blocks", r"""
      WITH n AS (SELECT block_id, source_text, block_id % 5 AS k, len(list_filter(regexp_extract_all(source_text, '[\p{L}\p{N}_]+'), lambda w: lower(w) IN ('the', 'und', 'la'))) AS n FROM content_blocks WHERE translatable),
      e AS (SELECT *, CASE WHEN k = 1 AND n > 0 THEN 'missing_placeholder' WHEN k = 2 AND n > 0 THEN 'duplicate_placeholder' WHEN k = 3 AND n > 1 THEN 'reordered_placeholder' WHEN k = 4 THEN 'unknown_placeholder' END AS error FROM n)
      SELECT block_id, CASE WHEN error IS NULL THEN source_text END AS text, error FROM e"""),
}
