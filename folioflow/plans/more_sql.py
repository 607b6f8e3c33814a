"""DuckDB SQL of the queries in more_queries.py."""

from __future__ import annotations

from .corpus_sql import using

_NOW, _BEFORE = "TIMESTAMP '2024-01-15 12:00:00'", "TIMESTAMP '2024-01-10 00:00:00'"
_URL = "'https://docs.example.com' || path"
_KNOWN = f"""known AS (SELECT {_URL} AS canonical_url, path, page_id, CASE WHEN page_id % 3 = 0 THEN {_BEFORE} ELSE {_NOW} END AS last_discovered_at,
        CASE WHEN page_id % 6 = 0 THEN {_BEFORE} END AS missing_since FROM source_pages)"""
_CORRECTIONS = """c AS (SELECT r.revision_id AS id, CASE WHEN r.revision_id % 2 = 0 THEN 'block' ELSE 'global' END AS scope, f.block_id, f.fingerprint, r.turn AS a
        FROM translation_revisions r JOIN fingerprints f USING (block_id) WHERE r.source = 'manual')"""
_CALLS = """calls AS (SELECT user_id AS job_id, event_id AS call, CASE WHEN event_id % 4 = 0 THEN 'secondary' ELSE 'primary' END AS provider,
        ['timeout', 'rate_limited', NULL, 'configuration', 'server_error', 'bad_request', 'timeout'][event_id % 7 + 1] AS error, event_id % 40 AS retry_after_s, props AS request FROM events)"""

MORE_SQL: dict[str, str] = {
    "status_classes": """
      WITH s AS (SELECT event_id, [200, 304, 404, 410, 429, 500, 503, 403, 302][event_id % 9 + 1] AS s FROM events)
      SELECT event_id, CASE WHEN s = 304 THEN 'not_modified' WHEN s BETWEEN 200 AND 299 THEN 'ok' WHEN s IN (404, 410) THEN 'gone' WHEN s = 429 THEN 'rate_limited' WHEN s >= 500 THEN 'server_error'
          WHEN s IN (401, 403) THEN 'forbidden' ELSE 'unexpected_status' END AS result, s = 429 OR s >= 500 AS retryable,
        CASE WHEN (s = 429 OR s >= 500) AND event_id % 3 = 0 THEN event_id % 50 END AS retry_after_s FROM s""",
    "resource_urls": using("source_pages", f"""
      SELECT page_id, {_URL} || CASE WHEN page_id % 2 = 0 THEN '.txt' ELSE '' END || '?v=1' AS resource, {_URL} || '.txt' AS text_url, CASE WHEN page_id % 2 = 0 THEN 'text' ELSE 'html' END AS format, {_URL} AS safe FROM source_pages"""),
    "fetch_log": "SELECT event_id, CASE WHEN event_type = 'error' THEN 'gone' ELSE 'ok' END AS result, CASE WHEN event_type = 'error' THEN ts + INTERVAL 7 DAY END AS expires_at FROM events",
    "payloads_kept": f"SELECT event_id FROM events WHERE ts + INTERVAL 7 DAY > {_NOW}",
    "sessions_active": f"SELECT count(*) AS active_sessions FROM events WHERE user_id % 3 <> 0 AND ts + INTERVAL 3 DAY > {_NOW}",
    "sessions_left": f"SELECT event_id AS session_id FROM events WHERE ts + INTERVAL 3 DAY > {_NOW}",
    "recent_jobs": using("job_log", """
      SELECT job_id, queue, type, status, attempts, left(message, 200) AS message, run_at FROM job_log WHERE status IN ('failed', 'running') ORDER BY run_at DESC, job_id DESC LIMIT 20"""),
    "navigation_parents": using("source_pages", """
      SELECT page_id, CASE WHEN page_id % 5 IN (0, 3) AND regexp_full_match(path, '/docs(/[A-Za-z0-9._~-]+)*') THEN path END AS parent FROM source_pages"""),
    "correction_history": using("fingerprints translation_revisions", f"""
      WITH {_CORRECTIONS}, h AS (
        SELECT c.block_id AS target_id, id, scope, a FROM c JOIN fingerprints USING (block_id) WHERE scope = 'block'
        UNION ALL SELECT f.block_id, id, scope, a FROM c JOIN fingerprints f USING (fingerprint) WHERE scope = 'global')
      SELECT target_id, id, scope, CAST(row_number() OVER (PARTITION BY target_id ORDER BY a DESC, id DESC) AS INTEGER) AS place FROM h"""),
    "corrections_recorded": using("fingerprints translation_revisions", f"""
      WITH {_CORRECTIONS}, k AS (SELECT block_id, max(id) AS id FROM c WHERE id % 5 <> 0 GROUP BY block_id)
      SELECT block_id, id AS correction_id, CASE WHEN id % 2 = 0 THEN block_id END AS correction_block_id, 'manually_corrected' AS status, CAST(NULL AS VARCHAR) AS reason FROM k"""),
    "shown_texts": using("block_translations", """
      SELECT b.block_id, coalesce(nullif(r.translated_text, ''), b.source_text) AS shown,
        CASE t.status WHEN 'ai_translated' THEN 'Translated' WHEN 'manually_corrected' THEN 'Corrected' WHEN 'review_required' THEN 'Needs review' WHEN 'failed' THEN 'Failed' WHEN 'oversized' THEN 'Too large' ELSE 'Pending' END AS label
      FROM content_blocks b LEFT JOIN block_translations t ON t.block_id = b.block_id LEFT JOIN translation_revisions r ON r.revision_id = t.current_revision_id"""),
    "strict_reservations": "SELECT doc_id, CAST(octet_length(encode(text)) + 4096 AS BIGINT) AS tokens FROM documents",
    "discovery_upsert": using("source_pages", f"""
      WITH {_KNOWN}, f AS (SELECT DISTINCT {_URL} || o AS canonical_url, path || o AS path FROM (SELECT *, CASE WHEN page_id % 4 = 0 THEN '/new' ELSE '' END AS o FROM source_pages WHERE page_id % 2 = 0))
      SELECT canonical_url, coalesce(f.path, known.path) AS path, CASE WHEN f.path IS NOT NULL THEN {_NOW} ELSE last_discovered_at END AS last_discovered_at, CASE WHEN f.path IS NULL THEN missing_since END AS missing_since
      FROM known FULL JOIN f USING (canonical_url)"""),
    "missing_pages": using("source_pages", f"""
      WITH {_KNOWN} SELECT canonical_url, CASE WHEN missing_since IS NULL AND last_discovered_at < {_NOW} - INTERVAL 1 DAY THEN {_NOW} ELSE missing_since END AS missing_since FROM known"""),
    "refresh_pages": using("source_pages", "SELECT page_id, path FROM source_pages WHERE status = 'active'"),
    "inherited_states": using("fingerprints block_translations", """
      WITH r AS (SELECT f.block_id, f.ordinal % 4 = 3 AS fresh, f.page_id % 3 = 1 AS changed, t.status, t.current_revision_id FROM fingerprints f LEFT JOIN block_translations t USING (block_id) WHERE f.translatable)
      SELECT block_id, CASE WHEN fresh THEN 'pending' WHEN changed AND status IN ('manually_corrected', 'review_required') THEN 'review_required' WHEN changed THEN 'pending' ELSE coalesce(status, 'pending') END AS status,
        CASE WHEN NOT fresh AND changed AND status IN ('manually_corrected', 'review_required') THEN 'source_changed_after_manual_correction' END AS reason, CASE WHEN NOT fresh THEN current_revision_id END AS current_revision_id FROM r"""),
    "publish_decisions": using("content_blocks", """
      SELECT DISTINCT page_id, ['unchanged', 'restored', 'published', 'published'][page_id % 4 + 1] AS decision, [1, 1, 2, 1][page_id % 4 + 1]::BIGINT AS version FROM content_blocks"""),
    "translation_jobs": using("fingerprints", "SELECT block_id, 'translate:' || block_id || ':' || fingerprint AS dedupe_key, 10 AS priority FROM fingerprints WHERE translatable"),
    "failed_marks": using("block_translations", """
      SELECT t.block_id, CASE WHEN page_id % 2 = 0 AND page_id % 6 <> 0 AND t.current_revision_id IS NULL THEN CASE WHEN page_id % 4 = 0 THEN 'oversized' ELSE 'failed' END ELSE t.status END AS status,
        t.current_revision_id, CASE WHEN page_id % 2 = 0 AND page_id % 6 <> 0 THEN 'timeout' END AS error FROM block_translations t JOIN content_blocks USING (block_id)"""),
    "discovery_jobs": using("source_pages", f"SELECT {_URL} AS canonical_url, 'fetch:' || {_URL} AS dedupe_key, CASE WHEN page_id % 2 = 0 THEN 20 ELSE 10 END AS priority FROM source_pages"),
    "maintenance_jobs": "SELECT DISTINCT k AS type, k || ':' || CAST(CAST(ts AS DATE) AS VARCHAR) AS dedupe_key FROM events, (VALUES ('discover'), ('cleanup')) t(k)",
    "page_requests": using("source_pages", "SELECT page_id, 100 AS priority FROM source_pages WHERE page_id % 3 = 0 OR page_id % 2 <> 0"),
    "retry_plans": f"""
      WITH {_CALLS}, t AS (SELECT *, count(*) FILTER (provider = 'primary') OVER (PARTITION BY job_id ORDER BY call) AS n FROM calls), a AS (
        SELECT *, CASE WHEN error IS NULL THEN 'done' WHEN error = 'configuration' OR provider = 'secondary' THEN 'fail' WHEN error IN ('timeout', 'rate_limited', 'server_error') AND n < 3 THEN 'retry' ELSE 'secondary' END AS action FROM t)
      SELECT call, action, CASE WHEN action = 'retry' THEN greatest(n, least(retry_after_s, 30)) END AS wait_s FROM a""",
    "call_audit": f"""
      WITH {_CALLS} SELECT job_id, call, CAST(row_number() OVER (PARTITION BY job_id ORDER BY call) AS INTEGER) AS sequence, CASE WHEN error IS NULL THEN 'succeeded' ELSE 'failed' END AS status,
        sha256(request) AS request_hash, left(error, 2000) AS message FROM calls""",
    "cut_messages": "SELECT doc_id, left(text, 100) AS message FROM documents",
    "image_texts": "SELECT doc_id, lang AS alt, source AS caption FROM documents",
    "current_versions": """
      WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS first FROM events),
      c AS (SELECT *, sum(first::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM f),
      v AS (SELECT user_id, ts, event_id, max(CASE WHEN first THEN n END) OVER (PARTITION BY user_id, event_type) AS version FROM c)
      SELECT user_id AS page_id, CAST(arg_max(version, {'t': ts, 'i': event_id}) AS BIGINT) AS version FROM v GROUP BY user_id""",
    "latest_policies": "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS written FROM events GROUP BY user_id",
    "enqueue_actions": """
      WITH RECURSIVE e AS (SELECT user_id, event_id, CASE WHEN event_type IN ('click', 'view') THEN 'enqueue' WHEN event_type = 'signup' THEN 'claim' WHEN event_type = 'error' THEN 'requeue' ELSE 'finish' END AS event,
          CAST(event_id % 10 AS INTEGER) AS p, epoch_us(ts) + (event_id % 7) * 60000000 AS r, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
      f AS (
        SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS event_id, '' AS action, 0 AS job_number, 'none' AS s, 0 AS p, 0::BIGINT AS r FROM (SELECT DISTINCT user_id FROM e)
        UNION ALL
        SELECT e.user_id, e.i, e.event_id,
          CASE e.event WHEN 'enqueue' THEN CASE WHEN f.s NOT IN ('queued', 'running') THEN 'created' WHEN f.s = 'queued' AND (e.p > f.p OR e.r < f.r) THEN 'promoted' ELSE 'deduplicated' END
            WHEN 'claim' THEN CASE WHEN f.s = 'queued' THEN 'claimed' ELSE 'ignored' END WHEN 'requeue' THEN CASE WHEN f.s = 'running' THEN 'requeued' ELSE 'ignored' END
            ELSE CASE WHEN f.s = 'running' THEN 'finished' ELSE 'ignored' END END,
          f.job_number + CASE WHEN e.event = 'enqueue' AND f.s NOT IN ('queued', 'running') THEN 1 ELSE 0 END,
          CASE e.event WHEN 'enqueue' THEN CASE WHEN f.s IN ('queued', 'running') THEN f.s ELSE 'queued' END WHEN 'claim' THEN CASE WHEN f.s = 'queued' THEN 'running' ELSE f.s END
            WHEN 'requeue' THEN CASE WHEN f.s = 'running' THEN 'queued' ELSE f.s END ELSE CASE WHEN f.s = 'running' THEN 'finished' ELSE f.s END END,
          CASE WHEN e.event = 'enqueue' AND f.s NOT IN ('queued', 'running') THEN e.p WHEN e.event = 'enqueue' AND f.s = 'queued' THEN greatest(e.p, f.p) ELSE f.p END,
          CASE WHEN e.event = 'enqueue' AND f.s NOT IN ('queued', 'running') THEN e.r WHEN e.event = 'enqueue' AND f.s = 'queued' THEN least(e.r, f.r) WHEN e.event = 'requeue' AND f.s = 'running' THEN e.r ELSE f.r END
        FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
      SELECT event_id, action, job_number FROM f WHERE i > 0""",
    "renewed_leases": using("job_log", f"""
      SELECT job_id, job_id % 2 = 0 AND status = 'running' AND lease_until > {_BEFORE} AS renewed,
        CASE WHEN job_id % 2 = 0 AND status = 'running' AND lease_until > {_BEFORE} THEN {_BEFORE} + INTERVAL 2 MINUTE END AS new_lease_until FROM job_log"""),
    "seeded_revisions": using("content_blocks", """
      WITH k AS (SELECT source_text, 'T: ' || source_text AS translated_text FROM content_blocks WHERE page_id % 5 = 0 GROUP BY source_text)
      SELECT block_id, k.translated_text FROM content_blocks JOIN k USING (source_text) WHERE translatable"""),
    "return_paths": using("source_pages", """
      SELECT page_id, [path || '?q=1', '/admin', '/admin/review?x=1', '/admin', '/admin'][page_id % 5 + 1] AS path FROM source_pages"""),
    "glossary_hashes": using("glossary_terms", "SELECT version, sha256(CAST(to_json(list_sort(list_distinct(list(lower(trim(source_term)))))) AS VARCHAR)) AS hash FROM glossary_terms GROUP BY version"),
    "request_hashes": "SELECT conv_id, turn, sha256(CAST(to_json([role, text]) AS VARCHAR)) AS hash FROM conversations",
    "prompts": using("content_blocks", """
      WITH j AS (SELECT block_id, lag(source_text) OVER w AS p, source_text AS t, lead(source_text) OVER w AS n FROM content_blocks WINDOW w AS (PARTITION BY page_id ORDER BY ordinal)),
      v AS (SELECT block_id, CASE WHEN p IS NULL THEN '{}' ELSE '{"value":' || CAST(to_json(p) AS VARCHAR) || '}' END AS p, '{"value":' || CAST(to_json(t) AS VARCHAR) || '}' AS t,
        CASE WHEN n IS NULL THEN '{}' ELSE '{"value":' || CAST(to_json(n) AS VARCHAR) || '}' END AS n FROM j)
      SELECT block_id, sha256('Translate. heading: {}' || chr(10) || 'before: ' || p || chr(10) || 'text: ' || t || chr(10) || 'after: ' || n || ' End.') AS prompt_hash FROM v"""),
    "output_checks": r"""
      WITH b AS (SELECT conv_id, turn, conv_id % 5 = 0 AS bare, CASE WHEN conv_id % 4 = 0 THEN ' ' ELSE text END AS t, text FROM conversations),
      e AS (SELECT *, CASE WHEN octet_length(encode(CASE WHEN bare THEN text ELSE '{"translatedText":' || CAST(to_json(t) AS VARCHAR) || '}' END)) > 200 THEN 'response_too_large'
        WHEN bare THEN 'invalid_json' WHEN NOT regexp_matches(t, '\S') THEN 'empty_translation' END AS error FROM b)
      SELECT conv_id, turn, CASE WHEN error IS NULL THEN t END AS text, error FROM e""",
    "inline_code_kinds": using("glossary_terms", r"""
      WITH v AS (SELECT term_id, CASE WHEN term_id % 2 = 0 THEN source_term ELSE upper(left(split_part(source_term, ' ', 1), 1)) || lower(substr(split_part(source_term, ' ', 1), 2)) || ['Id', '.Id', '/x', '.ts', '\y', '-z'][term_id % 6 + 1] END AS v FROM glossary_terms)
      SELECT term_id, CASE WHEN regexp_matches(v, '\s') THEN 'inline_code' WHEN regexp_matches(v, '[\\/]') OR regexp_matches(v, '(?i)\.(toml|json|ya?ml|tsx?|jsx?|liquid|graphql|md)$') THEN 'file_path'
        WHEN regexp_matches(v, '^[A-Z][A-Za-z0-9_]*(\.[A-Za-z0-9_]+)*$') THEN 'identifier' ELSE 'inline_code' END AS kind FROM v"""),
    "recognizable_text": r"""
      SELECT doc_id, regexp_matches(text, '(?m)^#{1,6}\s+\S') OR len(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda p: trim(p) <> '')) >= 2 OR length(trim(text)) >= 80 AS recognizable FROM documents""",
    "protected_blocks": using("content_blocks", r"""
      SELECT block_id, CASE WHEN block_type = 'code' THEN 'not_translatable' END AS error, CAST(CASE WHEN block_type = 'code' THEN 0
          ELSE len(list_filter(regexp_extract_all(source_text, '[\p{L}\p{N}_]+'), lambda w: lower(w) IN ('the', 'und', 'la'))) END AS INTEGER) AS tokens,
        CASE WHEN block_type <> 'code' THEN source_text END AS restored FROM content_blocks"""),
    "login_window": """
      WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
      f AS (
        SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS event_id, 0::BIGINT AS t, false AS ok, true AS allowed, NULL::BIGINT AS anchor, 0 AS n FROM (SELECT DISTINCT user_id FROM o)
        UNION ALL
        SELECT user_id, i, event_id, t, ok, NOT (live AND n >= 2), CASE WHEN live AND n >= 2 THEN anchor WHEN ok THEN NULL WHEN live THEN anchor ELSE t END,
          CASE WHEN live AND n >= 2 THEN n WHEN ok THEN 0 WHEN live THEN n + 1 ELSE 1 END
        FROM (SELECT o.*, f.anchor, f.n, f.anchor IS NOT NULL AND o.t < f.anchor + 86400000000 AS live FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1))
      SELECT user_id, t AS at_us, event_id AS attempt_id, ok, allowed FROM f WHERE i > 0""",
}
