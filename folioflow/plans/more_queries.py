"""Further queries: the operators on pages, corrections, jobs and calls, each over all rows of its corpus tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from ..operators import budget, jobs, navigation, ops, parse, parse_markdown, protection, publish, reader, translation
from ..sources import adapters as A
from ..storage import stored
from .queries import BEFORE, NOW, query

_STATUSES = (200, 304, 404, 410, 429, 500, 503, 403, 302)


def _pick(index: Column, values: tuple) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(index, F.lit(len(values))).cast("int"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "events")


@query
def status_classes(spark: SparkSession, d: str) -> DataFrame:
    after = F.when(F.pmod("event_id", F.lit(3)) == 0, F.pmod("event_id", F.lit(50)).cast("string")).otherwise("soon")
    found = U.classify_status(_pick(F.col("event_id"), _STATUSES), after)
    return _events(spark, d).select("event_id", found["result"].alias("result"), found["retryable"].alias("retryable"), found["retry_after_s"].alias("retry_after_s"))


@query
def resource_urls(spark: SparkSession, d: str) -> DataFrame:
    page = F.concat(F.lit("https://docs.example.com"), "path")
    raw = F.concat(page, F.when(F.pmod("page_id", F.lit(2)) == 0, ".txt").otherwise(""), F.lit("?v=1#x"))
    return A.source_pages(spark, d).select(
        "page_id", U.canonical_resource(raw)["url"].alias("resource"), U.text_form(page).alias("text_url"), U.source_format(raw).alias("format"), U.https_only(page).alias("safe")
    )


@query
def fetch_log(spark: SparkSession, d: str) -> DataFrame:
    result = F.when(F.col("event_type") == "error", "gone").otherwise("ok")
    log = publish.fetch_log(_events(spark, d).select("event_id", F.col("ts").alias("at"), result.alias("result")))
    return log.select("event_id", "result", F.col("expires_at").cast("timestamp_ntz").alias("expires_at"))


@query
def payloads_kept(spark: SparkSession, d: str) -> DataFrame:
    log = _events(spark, d).select("event_id", (F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"))
    return ops.fetch_log_after_expiry(log, NOW).select("event_id")


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select(F.col("event_id").alias("session_id"), "user_id", (F.col("ts") + F.expr("INTERVAL 3 DAYS")).alias("expires_at"))


@query
def sessions_active(spark: SparkSession, d: str) -> DataFrame:
    users = _events(spark, d).where(F.pmod("user_id", F.lit(3)) != 0).select("user_id").distinct()
    return ops.active_sessions(_sessions(spark, d), users, NOW)


@query
def sessions_left(spark: SparkSession, d: str) -> DataFrame:
    return ops.expired_sessions(_sessions(spark, d), NOW).select("session_id")


@query
def recent_jobs(spark: SparkSession, d: str) -> DataFrame:
    return ops.recent_jobs(A.job_log(spark, d), ["failed", "running"])


@query
def navigation_parents(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.pmod("page_id", F.lit(5)) == 0, F.concat("path", F.lit("//"))).when(F.pmod("page_id", F.lit(5)) == 1, "").when(F.pmod("page_id", F.lit(5)) == 2, F.concat("path", F.lit("/../x"))).when(
        F.pmod("page_id", F.lit(5)) == 3, F.replace("path", F.lit("/"), F.lit("%2F"))
    ).otherwise(F.concat("path", F.lit("/a b")))
    return A.source_pages(spark, d).select("page_id", navigation.parse_parent(value).alias("parent"))


def _corrections(spark: SparkSession, d: str, blocks: DataFrame) -> DataFrame:
    manual = A.translation_revisions(spark, d).where(F.col("source") == "manual").join(blocks.select("block_id", "fingerprint"), "block_id")
    scope = F.when(F.pmod("revision_id", F.lit(2)) == 0, "block").otherwise("global")
    return manual.select(F.col("revision_id").alias("id"), scope.alias("scope"), "block_id", "fingerprint", F.col("translated_text").alias("text"), F.col("turn").alias("at"))


@query
def correction_history(spark: SparkSession, d: str) -> DataFrame:
    blocks = stored(A.content_blocks(spark, d).select("block_id", "fingerprint"), "blocks")  # fingerprints once, not in each join and in its filters
    return translation.correction_history(blocks, _corrections(spark, d, blocks)).select("target_id", "id", "scope", "place")


@query
def corrections_recorded(spark: SparkSession, d: str) -> DataFrame:
    blocks = A.content_blocks(spark, d)
    stale = F.when(F.pmod("id", F.lit(5)) == 0, F.lit("other")).otherwise(F.col("fingerprint"))
    incoming = _corrections(spark, d, blocks).select(F.col("id").alias("correction_id"), "block_id", stale.alias("fingerprint"), "scope")
    return translation.record_corrections(incoming, blocks)


@query
def shown_texts(spark: SparkSession, d: str) -> DataFrame:
    blocks, states, revisions = A.content_blocks(spark, d), A.block_translations(spark, d), A.translation_revisions(spark, d)
    rows = blocks.join(states.select("block_id", "status", "current_revision_id"), "block_id", "left").join(
        revisions.select(F.col("revision_id").alias("current_revision_id"), "translated_text"), "current_revision_id", "left"
    )
    return rows.select("block_id", reader.display_text(F.col("source_text"), F.col("translated_text"), "target").alias("shown"), reader.status_label(F.col("status")).alias("label"))


@query
def strict_reservations(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", budget.strict_reservation(F.col("text"), 4096).cast("long").alias("tokens"))


def _known(spark: SparkSession, d: str) -> DataFrame:
    seen = F.when(F.pmod("page_id", F.lit(3)) == 0, F.lit(BEFORE)).otherwise(F.lit(NOW))
    missing = F.when(F.pmod("page_id", F.lit(6)) == 0, F.lit(BEFORE))
    return A.source_pages(spark, d).select("canonical_url", "path", seen.cast("timestamp_ntz").alias("last_discovered_at"), missing.cast("timestamp_ntz").alias("missing_since"))


@query
def discovery_upsert(spark: SparkSession, d: str) -> DataFrame:
    other = F.when(F.pmod("page_id", F.lit(4)) == 0, "/new").otherwise("")
    found = A.source_pages(spark, d).where(F.pmod("page_id", F.lit(2)) == 0).select(F.concat("canonical_url", other).alias("canonical_url"), F.concat("path", other).alias("path"))
    out = publish.upsert_discovered(_known(spark, d), found, NOW)
    return out.select("canonical_url", "path", F.col("last_discovered_at").cast("timestamp_ntz").alias("last_discovered_at"), F.col("missing_since").cast("timestamp_ntz").alias("missing_since"))


@query
def missing_pages(spark: SparkSession, d: str) -> DataFrame:
    return publish.mark_missing(_known(spark, d), NOW - timedelta(days=1), NOW).select("canonical_url", F.col("missing_since").cast("timestamp_ntz").alias("missing_since"))


@query
def refresh_pages(spark: SparkSession, d: str) -> DataFrame:
    return publish.refresh_list(A.source_pages(spark, d))


@query
def inherited_states(spark: SparkSession, d: str) -> DataFrame:
    blocks = A.content_blocks(spark, d).where("translatable")
    changed = F.when(F.pmod("page_id", F.lit(3)) == 1, F.lit("changed")).otherwise(F.col("fingerprint"))
    current = blocks.select("block_id", F.when(F.pmod("ordinal", F.lit(4)) != 3, F.col("block_id")).alias("previous_id"), changed.alias("fingerprint"))
    return publish.inherit_states(current, blocks, A.block_translations(spark, d))


@query
def publish_decisions(spark: SparkSession, d: str) -> DataFrame:
    blocks = A.content_blocks(spark, d)
    prints = blocks.groupBy("page_id").agg(T.page_fingerprint("ordinal", "block_type", "fingerprint").alias("fingerprint"))
    k = F.pmod("page_id", F.lit(4))
    first = prints.where(k < 3).select("page_id", F.lit(1).alias("version"), F.when(k < 2, F.col("fingerprint")).otherwise("other").alias("fingerprint"), (k != 1).alias("current"))
    second = prints.where(k == 1).select("page_id", F.lit(2).alias("version"), F.lit("newer").alias("fingerprint"), F.lit(True).alias("current"))
    return publish.publish_decisions(blocks, first.unionByName(second))


@query
def translation_jobs(spark: SparkSession, d: str) -> DataFrame:
    return publish.translation_jobs(A.content_blocks(spark, d).where("translatable"), 10)


@query
def failed_marks(spark: SparkSession, d: str) -> DataFrame:
    states = A.block_translations(spark, d).join(A.content_blocks(spark, d).select("block_id", "fingerprint", "page_id"), "block_id")
    failures = states.where(F.pmod("page_id", F.lit(2)) == 0).select(
        "block_id", F.when(F.pmod("page_id", F.lit(6)) == 0, "old").otherwise(F.col("fingerprint")).alias("fingerprint"), F.lit("timeout").alias("error"),
        (F.pmod("page_id", F.lit(4)) == 0).alias("oversized"),
    )
    return translation.mark_failed(states.drop("page_id"), failures)


@query
def discovery_jobs(spark: SparkSession, d: str) -> DataFrame:
    found = A.source_pages(spark, d).select("canonical_url", F.when(F.pmod("page_id", F.lit(2)) == 0, "2024-01-01").alias("last_modified"))
    return jobs.discovery_jobs(found)


@query
def maintenance_jobs(spark: SparkSession, d: str) -> DataFrame:
    return jobs.maintenance(_events(spark, d).select(F.to_date("ts").alias("day")))


@query
def page_requests(spark: SparkSession, d: str) -> DataFrame:
    checked = F.when(F.pmod("page_id", F.lit(3)) != 0, F.lit(NOW - timedelta(hours=5)))
    pages = A.source_pages(spark, d).select("page_id", checked.alias("checked_at"), F.when(F.pmod("page_id", F.lit(2)) == 0, 1).alias("current_version"))
    return jobs.page_requests(pages, NOW, True)


def _calls(spark: SparkSession, d: str) -> DataFrame:
    error = _pick(F.col("event_id"), ("timeout", "rate_limited", None, "configuration", "server_error", "bad_request", "timeout"))
    return _events(spark, d).select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("call"), F.when(F.pmod("event_id", F.lit(4)) == 0, "secondary").otherwise("primary").alias("provider"),
        error.alias("error"), F.pmod("event_id", F.lit(40)).cast("int").alias("retry_after_s"), F.col("props").alias("request"),
    )


@query
def retry_plans(spark: SparkSession, d: str) -> DataFrame:
    return translation.retry_plan(_calls(spark, d)).select("call", "action", "wait_s")


@query
def call_audit(spark: SparkSession, d: str) -> DataFrame:
    return translation.call_audit(_calls(spark, d))


@query
def cut_messages(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", T.cut_message("text", 100).alias("message"))


@query
def image_texts(spark: SparkSession, d: str) -> DataFrame:
    parts = U.image_parts(F.concat_ws("\n", "lang", "source"))
    return A.table(spark, d, "documents").select("doc_id", parts["alt"].alias("alt"), parts["caption"].alias("caption"))


@query
def current_versions(spark: SparkSession, d: str) -> DataFrame:
    fetches = _events(spark, d).select(F.col("user_id").alias("page_id"), F.col("ts").alias("at"), F.col("event_id").alias("fetch_id"), F.col("event_type").alias("fingerprint"))
    return publish.current_versions(publish.version_decisions(fetches))


@query
def latest_policies(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select("user_id", "event_type", F.col("event_id").alias("written"))
    return publish.latest_rows(rows, ["user_id"], "written")


@query
def enqueue_actions(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    event = F.when(kind.isin("click", "view"), "enqueue").when(kind == "signup", "claim").when(kind == "error", "requeue").otherwise("finish")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = _events(spark, d).select(
        F.concat(F.lit("page:"), "user_id").alias("dedupe_key"), at.alias("at_us"), "event_id", event.alias("event"), F.pmod("event_id", F.lit(10)).cast("int").alias("priority"),
        (at + F.pmod("event_id", F.lit(7)) * 60_000_000).alias("run_at_us"),
    )
    return jobs.enqueue(rows).select("event_id", "action", "job_number")


@query
def renewed_leases(spark: SparkSession, d: str) -> DataFrame:
    log = A.job_log(spark, d).withColumn("owner", _pick(F.col("job_id"), ("a", "b")))
    callers = log.select("job_id", F.lit("a").alias("owner"))
    return jobs.renew_leases(log, callers, BEFORE)


@query
def seeded_revisions(spark: SparkSession, d: str) -> DataFrame:
    blocks = A.content_blocks(spark, d)
    known = blocks.where(F.pmod("page_id", F.lit(5)) == 0).select("source_text", F.concat(F.lit("T: "), "source_text").alias("translated_text"))
    return translation.seeded(blocks, known).select("block_id", "translated_text")


@query
def return_paths(spark: SparkSession, d: str) -> DataFrame:
    value = F.concat(_pick(F.col("page_id"), ("", "https://x.example", "/admin/review?x=1#", "/admin", "/docs/a/..")), "path", F.lit("?q=1#part"))
    return A.source_pages(spark, d).select("page_id", translation.return_path(value).alias("path"))


@query
def glossary_hashes(spark: SparkSession, d: str) -> DataFrame:
    return A.glossary_terms(spark, d).groupBy("version").agg(T.glossary_hash("source_term").alias("hash"))


@query
def request_hashes(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "conversations").select("conv_id", "turn", T.config_hash("role", "text").alias("hash"))


@query
def prompts(spark: SparkSession, d: str) -> DataFrame:
    context = reader.block_context(A.content_blocks(spark, d)).join(A.content_blocks(spark, d).select("block_id", "source_text"), "block_id")
    whole = protection.render_prompt("Translate. {{sourceText}} End.", F.lit(None).cast("string"), F.col("previous_text"), F.col("source_text"), F.col("next_text"))
    return context.select("block_id", F.sha2(whole, 256).alias("prompt_hash"))


@query
def output_checks(spark: SparkSession, d: str) -> DataFrame:
    """A model's answers, made from the conversations: some too long, some not JSON, some blank."""
    text = F.when(F.pmod("conv_id", F.lit(4)) == 0, " ").otherwise(F.col("text"))
    body = F.when(F.pmod("conv_id", F.lit(5)) == 0, F.col("text")).otherwise(F.to_json(F.struct(text.alias("translatedText"))))
    none = F.array().cast("array<struct<placeholder:string,value:string>>")
    rows = A.table(spark, d, "conversations").select("conv_id", "turn", protection.validate_output(body, none, 200).alias("r"))
    return rows.select("conv_id", "turn", "r.text", "r.error")


@query
def md_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The documents read as Markdown."""
    return parse_markdown.parse_pages(A.table(spark, d, "documents"), id_col="doc_id")


@query
def parsed_sources(spark: SparkSession, d: str) -> DataFrame:
    """Documents as text and pages as HTML, in one table of blocks."""
    text = A.table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.lit("text").alias("format"), F.col("text").alias("body"))
    html = A.table(spark, d, "pages").select("page_id", F.lit("html").alias("format"), F.col("html").alias("body"))
    return parse.parse_sources(text.unionByName(html))
