"""The corpus tables of sources/adapters.py as DuckDB common table expressions."""

from __future__ import annotations

from ..config import SITE

ENDS = r"[\t\n\x0B\f\r\p{Z}\x{FEFF}]"

TABLES = {
    "lines": "SELECT doc_id, lang, source, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents",
    "source_pages": f"""SELECT d.doc_id AS page_id, concat_ws('/', '{SITE.root}', d.lang, d.source, CAST(d.doc_id AS VARCHAR)) AS path,
        l[1] AS title, CASE WHEN toxic = 1 THEN 'blocked' ELSE 'active' END AS status
      FROM lines d LEFT JOIN labels USING (doc_id)""",
    "content_blocks": """SELECT page_id * 100000 + ordinal AS block_id, page_id, CAST(ordinal AS INTEGER) AS ordinal,
        CASE WHEN ordinal % 5 = 0 THEN 'heading' WHEN contains(source_text, ' | ') THEN 'code' ELSE 'paragraph' END AS block_type, source_text,
        ordinal % 5 = 0 OR NOT contains(source_text, ' | ') AS translatable, CAST(CASE WHEN ordinal = 0 THEN 1 ELSE 2 END AS INTEGER) AS depth
      FROM (SELECT doc_id AS page_id, unnest(range(len(l))) AS ordinal, unnest(l) AS source_text FROM lines)""",
    "fingerprints": rf"""SELECT *, sha256('{{"type":"' || block_type || '","sourceText":' || CAST(to_json(CASE WHEN block_type = 'code'
        THEN regexp_replace(source_text, '\r\n?', chr(10), 'g') ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(source_text, '\r\n?', chr(10), 'g'),
          '[ \t]+', ' ', 'g'), ' *\n+ *', ' ', 'g'), '^{ENDS}+|{ENDS}+$', '', 'g') END) AS VARCHAR)
        || ',"payload":' || CASE block_type WHEN 'heading' THEN '{{"depth":' || depth || '}}' WHEN 'code' THEN '{{"language":""}}' ELSE '{{"protectedTokens":[]}}' END
        || ',"translatable":' || CASE WHEN block_type = 'code' THEN 'false' ELSE 'true' END || '}}') AS fingerprint FROM content_blocks""",
    "translation_revisions": """SELECT conv_id * 1000 + turn AS revision_id, conv_id * 100000 + 1 AS block_id, turn,
        CASE role WHEN 'user' THEN 'manual' WHEN 'assistant' THEN 'ai' ELSE 'ai_memory' END AS source, text AS translated_text FROM conversations""",
    "block_translations": """SELECT b.block_id, CASE WHEN toxic = 1 THEN 'review_required' WHEN quality = 1 THEN 'ai_translated' ELSE 'failed' END AS status,
        r.revision_id AS current_revision_id
      FROM content_blocks b JOIN labels ON labels.doc_id = b.page_id
      LEFT JOIN (SELECT block_id, max(revision_id) AS revision_id FROM translation_revisions GROUP BY block_id) r ON r.block_id = b.block_id WHERE b.translatable""",
    "job_log": """SELECT event_id AS job_id, 'page:' || user_id AS dedupe_key,
        CASE WHEN event_type IN ('click', 'view') THEN 'ingestion' ELSE 'translation' END AS queue, event_type AS type,
        CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' WHEN 'signup' THEN 'running' ELSE 'queued' END AS status,
        CAST(json_extract_string(props, '$.k') AS INTEGER) AS priority, CAST(event_id % 5 AS INTEGER) AS attempts, 3 AS max_attempts, ts AS run_at,
        ts + INTERVAL 3 MINUTE AS lease_until, props AS message FROM events""",
    "token_ledger": """SELECT event_id AS reservation_id, ts AS "at", CAST(ts + INTERVAL 8 HOUR AS DATE) AS usage_date, CAST(floor(value) AS BIGINT) + 1 AS tokens,
        CASE event_type WHEN 'purchase' THEN 'settled' WHEN 'error' THEN 'released' WHEN 'signup' THEN 'request_started' ELSE 'reserved' END AS status,
        CASE WHEN event_id % 7 <> 0 THEN (CAST(floor(value) AS BIGINT) + 1) // 2 END AS input_tokens, event_id % 300 AS output_tokens FROM events""",
    "glossary_terms": "SELECT p_size AS version, p_partkey AS term_id, p_name AS source_term, lower(p_name) AS normalized_term FROM part",
    "glossary_versions": """SELECT v AS version, v = max(v) OVER () - 1 AS active
      FROM (SELECT DISTINCT p_size AS v FROM part UNION SELECT max(p_size) + 1 FROM part)""",
}
_NEEDS = {
    "source_pages": ("lines",), "content_blocks": ("lines",), "fingerprints": ("content_blocks",), "block_translations": ("content_blocks", "translation_revisions"),
}


def using(names: str, body: str) -> str:
    """A statement with the named corpus tables, and those they need, before it."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, ()):
            add(n)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    more = body.lstrip()
    tables = ", ".join(f"{n} AS ({TABLES[n]})" for n in order)
    return f"WITH {tables}, {more[5:]}" if more[:5].upper() == "WITH " else f"WITH {tables} {more}"
