"""DuckDB SQL with the same results as the queries, where SQL can express them."""

from __future__ import annotations

from .corpus_sql import using

_PENDING = "coalesce(t.status, 'pending')"
_NOW, _BEFORE = "TIMESTAMP '2024-01-15 12:00:00'", "TIMESTAMP '2024-01-10 00:00:00'"


def _search(word: str, identifier: bool, whole: bool = False) -> str:
    fold = lambda c: f"coalesce(contains(lower({c}), '{word.lower()}'), false)"
    like = lambda c: f"coalesce({c} ILIKE '%{word}%', false)"
    return using("source_pages block_translations", f"""
    WITH found AS (
      SELECT p.page_id, p.path, p.title, b.ordinal, b.block_id, b.source_text, r.translated_text,
        CASE WHEN {like('p.title')} THEN 0 WHEN {like('p.path')} THEN 1 WHEN {like('r.translated_text')} THEN 2 ELSE 3 END AS k
      FROM source_pages p JOIN content_blocks b USING (page_id) LEFT JOIN block_translations t ON t.block_id = b.block_id
      LEFT JOIN translation_revisions r ON r.revision_id = t.current_revision_id
      WHERE p.status = 'active' AND ({like('p.title')} OR {like('p.path')} OR {like('r.translated_text')} OR {like('b.source_text')})
    ), cand AS (SELECT *, row_number() OVER (ORDER BY k, path, ordinal, block_id) AS place FROM found{"" if whole else " QUALIFY place <= 500"}),
    scored AS (
      SELECT *, CASE WHEN {f"contains(source_text, '{word}')" if identifier else 'false'} THEN {{'s': 120, 'k': 'identifier', 't': source_text}}
        WHEN {fold('title')} THEN {{'s': 100, 'k': 'title', 't': title}} WHEN {fold('path')} THEN {{'s': 90, 'k': 'path', 't': path}}
        WHEN {fold('translated_text')} THEN {{'s': 80, 'k': 'translation', 't': translated_text}} ELSE {{'s': 70, 'k': 'source', 't': source_text}} END AS b FROM cand
    ), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY b.s DESC, place) = 1),
    ranked AS (SELECT row_number() OVER (ORDER BY b.s DESC, coalesce(title, path), page_id) AS rank, * FROM best)
    SELECT rank, page_id, path, title, b.k AS kind, b.s AS score, b.t AS snippet FROM ranked WHERE rank <= 20""")


ORACLE_SQL: dict[str, str] = {
    "search_topk": _search("the", False),
    "search_identifier": _search("The", True),
    "reader_page": using("source_pages block_translations", """
      SELECT b.page_id, b.ordinal, b.block_type, b.source_text, t.status, r.translated_text, coalesce(h.n, 0) AS revisions
      FROM source_pages p JOIN content_blocks b USING (page_id) LEFT JOIN block_translations t ON t.block_id = b.block_id
      LEFT JOIN translation_revisions r ON r.revision_id = t.current_revision_id
      LEFT JOIN (SELECT block_id, count(*) AS n FROM translation_revisions GROUP BY 1) h ON h.block_id = b.block_id
      WHERE p.status = 'active' AND p.page_id = 1"""),
    "reader_summary": using("block_translations", f"""
      SELECT page_id, count(*) AS blocks, count(*) FILTER (translatable) AS translatable,
        count(*) FILTER (translatable AND {_PENDING} IN ('ai_translated', 'manually_corrected')) AS translated, count(*) FILTER (translatable AND {_PENDING} = 'pending') AS pending,
        count(*) FILTER (translatable AND {_PENDING} = 'failed') AS failed, count(*) FILTER (translatable AND {_PENDING} = 'review_required') AS review_required
      FROM content_blocks LEFT JOIN block_translations t USING (block_id) GROUP BY page_id"""),
    "reader_contents": using("source_pages content_blocks", """
      SELECT page_id, ordinal, source_text, depth FROM content_blocks JOIN source_pages USING (page_id) WHERE block_type = 'heading' AND NOT (ordinal = 0 AND source_text = title)"""),
    "review_items": using("source_pages block_translations", f"""
      WITH r AS (SELECT b.block_id, p.path, b.ordinal, {_PENDING} AS status, CASE {_PENDING} WHEN 'review_required' THEN 0 WHEN 'failed' THEN 1 WHEN 'pending' THEN 2
          WHEN 'ai_translated' THEN 3 WHEN 'manually_corrected' THEN 4 WHEN 'oversized' THEN 5 ELSE 6 END AS urgency, t.current_revision_id AS revision
        FROM content_blocks b JOIN source_pages p USING (page_id) LEFT JOIN block_translations t ON t.block_id = b.block_id WHERE b.translatable)
      SELECT *, row_number() OVER (ORDER BY urgency, revision DESC NULLS LAST, path, ordinal, block_id) AS rank FROM r QUALIFY rank <= 50"""),
    "block_context": using("content_blocks", """
      SELECT block_id, page_id, ordinal, lag(source_text) OVER w AS previous_text, lead(source_text) OVER w AS next_text FROM content_blocks WINDOW w AS (PARTITION BY page_id ORDER BY ordinal)"""),
    "ops_queue_status": using("job_log", """
      SELECT queue, status, jobs, row_number() OVER (ORDER BY queue, CASE status WHEN 'failed' THEN 0 WHEN 'running' THEN 1 WHEN 'queued' THEN 2 ELSE 3 END) AS rank
      FROM (SELECT queue, status, count(*) AS jobs FROM job_log GROUP BY ALL)"""),
    "ops_recent_failures": using("job_log", "SELECT job_id, queue, type, run_at FROM job_log WHERE status = 'failed' ORDER BY run_at DESC, job_id DESC LIMIT 5"),
    "ops_alerts": using("job_log glossary_versions", """
      WITH a AS (SELECT 0 AS i, 'no_enabled_provider' AS alert WHERE NOT (SELECT bool_or(n_regionkey = 1) FROM nation) UNION ALL SELECT 1, 'no_active_prompt' UNION ALL SELECT 2, 'no_active_glossary' WHERE NOT (SELECT bool_or(active) FROM glossary_versions)
        UNION ALL SELECT 3, 'failed_jobs:' || n FROM (SELECT count(*) AS n FROM job_log WHERE status = 'failed') WHERE n > 0)
      SELECT CAST(row_number() OVER (ORDER BY i) - 1 AS INTEGER) AS place, alert FROM a"""),
    "glossary_history": using("glossary_versions glossary_terms", "SELECT version, active, count(term_id) AS terms FROM glossary_versions LEFT JOIN glossary_terms USING (version) GROUP BY ALL ORDER BY version DESC LIMIT 10"),
    "glossary_active": using("glossary_versions glossary_terms", "SELECT t.* FROM glossary_terms t JOIN glossary_versions v USING (version) WHERE active"),
    "glossary_differences": using("glossary_versions glossary_terms", """
      WITH top AS (SELECT * FROM glossary_versions ORDER BY version DESC LIMIT 20), own AS (SELECT DISTINCT version, normalized_term AS n FROM glossary_terms SEMI JOIN top USING (version)),
      base AS (SELECT n FROM own JOIN top USING (version) WHERE active)
      SELECT version, active, (SELECT count(*) FROM own WHERE own.version = top.version AND n NOT IN (SELECT n FROM base)) AS added,
        (SELECT count(*) FROM base WHERE n NOT IN (SELECT n FROM own WHERE own.version = top.version)) AS removed FROM top"""),
    "glossary_validation": using("glossary_terms", r"""
      SELECT version, term_id, trim(source_term) AS source_term, lower(trim(source_term)) AS normalized_term,
        CASE WHEN NOT regexp_full_match(trim(source_term), '[\x20-\x7e]+') THEN 'not_ascii' WHEN count(*) OVER (PARTITION BY version, lower(trim(source_term))) > 1 THEN 'duplicate_term' END AS error FROM glossary_terms"""),
    "glossary_activation": using("glossary_versions", "SELECT version, false AS active FROM glossary_versions UNION ALL SELECT max(version) + 1, true FROM glossary_versions"),
    "navigation_root": using("source_pages", """
      WITH n AS (SELECT split_part(path, '/', 3) AS s, bool_or(path = '/docs/' || split_part(path, '/', 3)) AS is_page, bool_or(split_part(path, '/', 4) <> '') AS has_children
        FROM source_pages WHERE status = 'active' AND starts_with(path, '/docs/') GROUP BY 1)
      SELECT place, '/docs/' || s AS path, label, is_page, has_children FROM n JOIN (VALUES (0, 'en', 'English'), (1, 'de', 'German'), (2, 'fr', 'French'), (3, 'es', 'Spanish')) v(place, s, label) USING (s)"""),
    "navigation_children": using("source_pages", """
      SELECT '/docs/en/' || split_part(path, '/', 4) AS path, upper(left(split_part(path, '/', 4), 1)) || substr(split_part(path, '/', 4), 2) AS label, false AS is_page, true AS has_children
      FROM source_pages WHERE status = 'active' AND starts_with(path, '/docs/en/') GROUP BY split_part(path, '/', 4)"""),
    "navigation_below": using("source_pages", "SELECT page_id, path, title FROM source_pages WHERE status = 'active' AND starts_with(path, '/docs/de/')"),
    "url_canonical": using("source_pages", """
      SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN 'https://docs.example.com' || path END AS url, CASE WHEN page_id % 3 = 0 THEN 'query' END AS error FROM source_pages"""),
    "block_fingerprints": using("fingerprints", "SELECT block_id, block_type, fingerprint FROM fingerprints"),
    "page_fingerprints": using("fingerprints", """
      SELECT page_id, sha256('[' || string_agg('{"type":"' || block_type || '","contentFingerprint":"' || fingerprint || '"}', ',' ORDER BY ordinal) || ']') AS fingerprint FROM fingerprints GROUP BY page_id"""),
    "budget_admission": using("token_ledger", """
      WITH o AS (SELECT usage_date, "at", reservation_id, tokens, row_number() OVER (PARTITION BY usage_date ORDER BY "at", reservation_id) AS i FROM token_ledger),
      f AS (
        SELECT usage_date, i, "at", reservation_id, tokens, tokens <= 5000 AS admitted, CASE WHEN tokens <= 5000 THEN tokens ELSE 0 END AS used_after FROM o WHERE i = 1
        UNION ALL SELECT o.usage_date, o.i, o."at", o.reservation_id, o.tokens, f.used_after + o.tokens <= 5000, f.used_after + CASE WHEN f.used_after + o.tokens <= 5000 THEN o.tokens ELSE 0 END
        FROM f JOIN o ON o.usage_date = f.usage_date AND o.i = f.i + 1)
      SELECT CAST(usage_date AS VARCHAR) AS usage_date, "at", reservation_id, tokens, admitted, used_after FROM f""").replace("WITH token_ledger", "WITH RECURSIVE token_ledger", 1),
    "budget_days": using("token_ledger", """
      SELECT CAST(usage_date AS VARCHAR) AS usage_date, CAST(reserved AS BIGINT) AS reserved, CAST(charged AS BIGINT) AS charged, CAST(greatest(0, 100000 - reserved - charged) AS BIGINT) AS remaining, 100000 - reserved - charged <= 0 AS exhausted
      FROM (SELECT usage_date, sum(CASE WHEN status IN ('reserved', 'request_started') THEN tokens ELSE 0 END) AS reserved,
        sum(CASE WHEN status = 'settled' THEN least(tokens, coalesce(input_tokens + output_tokens, tokens)) ELSE 0 END) AS charged FROM token_ledger GROUP BY usage_date)"""),
    "budget_reconcile": using("token_ledger", f"""
      SELECT reservation_id, CASE WHEN status = 'reserved' AND "at" <= {_BEFORE} THEN 'released' WHEN status = 'request_started' AND "at" <= {_NOW} THEN 'settled' ELSE status END AS new_status,
        CASE WHEN status = 'reserved' AND "at" <= {_BEFORE} THEN 0 WHEN status = 'request_started' AND "at" <= {_NOW} THEN tokens END AS charge FROM token_ledger"""),
    "budget_start": using("token_ledger", """
      SELECT reservation_id, status, CASE status WHEN 'reserved' THEN 'request_started' WHEN 'released' THEN 'error' ELSE 'unchanged' END AS outcome FROM token_ledger"""),
    "budget_resets": using("token_ledger", "SELECT reservation_id, CAST(usage_date AS VARCHAR) AS day, CAST(usage_date AS TIMESTAMP) + INTERVAL 16 HOUR AS reset_at FROM token_ledger"),
    "queue_merge": using("job_log", """
      WITH f AS (SELECT dedupe_key, arg_min({'p': priority, 'r': run_at, 'j': job_id}, {'a': run_at, 'i': job_id}) AS x, max(priority) AS priority, min(run_at) AS run_at, count(*) AS requests FROM job_log GROUP BY dedupe_key)
      SELECT dedupe_key, x.j AS job_id, priority, run_at, requests, priority > x.p OR run_at < x.r AS promoted FROM f"""),
    "queue_claim": using("job_log", f"""
      SELECT queue, job_id, priority, CAST(row_number() OVER (PARTITION BY queue ORDER BY priority DESC, run_at, job_id) AS INTEGER) AS place FROM job_log
      WHERE attempts < max_attempts AND ((status = 'queued' AND run_at <= {_NOW}) OR (status = 'running' AND lease_until <= {_NOW})) QUALIFY place <= 10"""),
    "queue_exhausted": using("job_log", f"SELECT job_id, 'lease_exhausted' AS error FROM job_log WHERE status = 'running' AND lease_until <= {_NOW} AND attempts >= max_attempts"),
    "queue_retry": using("job_log", f"""
      SELECT job_id, CASE WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END AS new_status,
        CASE WHEN attempts < 3 THEN {_NOW} + CASE WHEN attempts <= 1 THEN INTERVAL 1 MINUTE ELSE INTERVAL 5 MINUTE END END AS new_run_at FROM job_log"""),
    "queue_deferred": using("job_log", "SELECT job_id, greatest(attempts - 1, 0) AS attempts FROM job_log"),
    "daily_refreshes": using("source_pages", """
      SELECT page_id, 'refresh:' || page_id || ':2024-01-15' AS dedupe_key,
        TIMESTAMP '2024-01-15' + to_seconds(CAST('0x' || substr(sha256(CAST(page_id AS VARCHAR)), 1, 8) AS BIGINT) % 86400) AS run_at, 10 AS priority FROM source_pages WHERE status = 'active'"""),
    "reader_requests": using("fingerprints block_translations", f"""
      SELECT b.block_id, 'translate:' || b.block_id || ':' || fingerprint AS dedupe_key, 100 AS priority FROM fingerprints b LEFT JOIN block_translations t ON t.block_id = b.block_id
      WHERE translatable AND {_PENDING} IN ('pending', 'failed')"""),
    "retranslations": using("content_blocks", "SELECT block_id, 'retranslate:' || block_id || ':1:1' AS dedupe_key, CASE WHEN ordinal = 0 THEN 'deduplicated' ELSE 'enqueued' END AS action FROM content_blocks"),
    "spaced_starts": """
      WITH r AS (SELECT event_id, user_id % 16 AS host, epoch_us(ts) // 1000 AS a FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY a, event_id) - 1 AS i FROM r)
      SELECT event_id AS request_id, max(a - i * 60000) OVER (PARTITION BY host ORDER BY i) + i * 60000 AS start_ms FROM o""",
    "translation_memory": using("fingerprints translation_revisions", """
      WITH s AS (SELECT f.fingerprint, r.translated_text AS text, r.source, r.turn AS a, r.revision_id AS id, r.block_id FROM translation_revisions r JOIN fingerprints f USING (block_id)),
      own AS (SELECT block_id, arg_max(text, {'a': a, 'i': id}) AS o FROM s WHERE source = 'manual' AND id % 2 = 0 GROUP BY 1),
      glo AS (SELECT fingerprint, arg_max(text, {'a': a, 'i': id}) AS g FROM s WHERE source = 'manual' AND id % 2 <> 0 GROUP BY 1),
      mem AS (SELECT fingerprint, arg_max(text, {'a': a, 'i': id}) AS m FROM s WHERE source IN ('ai', 'ai_memory') GROUP BY 1)
      SELECT b.block_id, CASE WHEN o IS NOT NULL THEN 'block_correction' WHEN g IS NOT NULL THEN 'global_correction' WHEN m IS NOT NULL THEN 'memory' ELSE 'model' END AS origin, coalesce(o, g, m) AS text
      FROM fingerprints b LEFT JOIN own USING (block_id) LEFT JOIN glo ON glo.fingerprint = b.fingerprint LEFT JOIN mem ON mem.fingerprint = b.fingerprint"""),
    "revision_publish": using("block_translations", """
      SELECT revision_id, CASE WHEN page_id % 5 <> 0 THEN 'published' ELSE 'stale' END AS outcome,
        CASE WHEN page_id % 5 = 0 THEN t.status WHEN source = 'manual' THEN 'manually_corrected' WHEN t.status = 'review_required' THEN t.status ELSE 'ai_translated' END AS new_status
      FROM translation_revisions r JOIN content_blocks b USING (block_id) LEFT JOIN block_translations t ON t.block_id = b.block_id"""),
    "translation_backfill": using("block_translations", "SELECT block_id, 'pending' AS status FROM content_blocks WHERE translatable AND block_id NOT IN (SELECT block_id FROM block_translations)"),
    "version_decisions": """
      WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS first, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
      c AS (SELECT *, sum(first::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM f)
      SELECT event_id AS fetch_id, CASE WHEN first THEN 'published' WHEN before IS NOT DISTINCT FROM event_type THEN 'unchanged' ELSE 'restored' END AS decision,
        CAST(max(CASE WHEN first THEN n END) OVER (PARTITION BY user_id, event_type) AS BIGINT) AS version FROM c""",
    "latest_page_status": """
      SELECT user_id AS page_id, CASE arg_max(event_type, {'t': ts, 'i': event_id}) WHEN 'error' THEN 'gone' WHEN 'signup' THEN 'blocked' ELSE 'active' END AS status FROM events GROUP BY 1""",
    "html_titles": r"""
      SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '\s+', ' ', 'g')) AS title FROM pages""",
}
