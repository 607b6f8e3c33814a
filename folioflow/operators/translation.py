"""Translation memory, corrections, revisions, and the state of a block's translation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_text(df: DataFrame, key: str, name: str) -> DataFrame:
    """The text of each key's newest row, ties to the largest id. Combined before the shuffle, so a key of any size is a few rows."""
    return df.groupBy(key).agg(F.max_by("text", F.struct("at", "id")).alias(name))


def resolve(blocks: DataFrame, corrections: DataFrame, memory: DataFrame) -> DataFrame:
    """block_id, origin, text: a block's own correction, else a global one of the same fingerprint, else
    the machine's memory of the fingerprint, else the model is to be asked.

    corrections: scope (block or global), block_id, fingerprint, text, at, id. memory: fingerprint, text,
    source, at, id. A key is resolved once, however many blocks share it."""
    own = latest_text(corrections.where(F.col("scope") == "block"), "block_id", "_own")
    shared = latest_text(corrections.where(F.col("scope") == "global"), "fingerprint", "_global")
    seen = latest_text(memory.where(F.col("source").isin("ai", "ai_memory")), "fingerprint", "_memory")
    known = shared.join(seen, "fingerprint", "full")
    rows = blocks.select("block_id", "fingerprint").join(own, "block_id", "left").join(known, "fingerprint", "left")
    origin = (
        F.when(F.col("_own").isNotNull(), "block_correction").when(F.col("_global").isNotNull(), "global_correction")
        .when(F.col("_memory").isNotNull(), "memory").otherwise("model")
    )
    return rows.select("block_id", origin.alias("origin"), F.coalesce("_own", "_global", "_memory").alias("text"))


def current_blocks(pages: DataFrame, blocks: DataFrame, states: DataFrame, *, block_id: int | None = None, path: str | None = None) -> DataFrame:
    """Translatable blocks of pages' current versions with the state of their translation, in order of path and place; of one block or one
    page if given."""
    some = blocks.where(F.col("translatable") & (F.lit(True) if block_id is None else F.col("block_id") == block_id))
    of = pages if path is None else pages.where(F.col("path") == path)
    rows = some.join(of.select("page_id", "path", F.col("current_version").alias("version")), ["page_id", "version"])
    return rows.join(states.select("block_id", "status", "current_revision_id"), "block_id", "left").select("path", "ordinal", "block_id", "fingerprint", "status", "current_revision_id").orderBy("path", "ordinal")


def correction_history(blocks: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrections that concern each block, newest first: its own and the global ones of its fingerprint.
    Two equi-joins instead of a join on either."""
    cols = ["target_id", "id", "scope", "text", "at"]
    own = blocks.select(F.col("block_id").alias("target_id")).join(corrections.where(F.col("scope") == "block"), F.col("target_id") == F.col("block_id")).select(*cols)
    shared = blocks.select(F.col("block_id").alias("target_id"), "fingerprint").join(corrections.where(F.col("scope") == "global").drop("block_id"), "fingerprint").select(*cols)
    w = Window.partitionBy("target_id").orderBy(F.col("at").desc(), F.col("id").desc())
    return own.unionByName(shared).withColumn("place", F.row_number().over(w))


def next_status(current: Column, source: Column) -> Column:
    """A manual revision makes manually_corrected; a machine's keeps review_required."""
    return F.when(source == "manual", "manually_corrected").when(current == "review_required", "review_required").otherwise("ai_translated")


def publish_revisions(incoming: DataFrame, blocks: DataFrame, pages: DataFrame, translations: DataFrame) -> DataFrame:
    """Each incoming revision (block_id, fingerprint, source, ...) with outcome and new_status. It is stale
    unless its block belongs to the page's current version and still has that fingerprint."""
    now = blocks.select("block_id", F.col("fingerprint").alias("_now"), F.col("version").alias("_version"), "page_id").join(
        pages.select("page_id", F.col("current_version").alias("_current")), "page_id"
    )
    rows = incoming.join(now.select("block_id", "_now", (F.col("_version") == F.col("_current")).alias("_is_current")), "block_id", "left").join(
        translations.select("block_id", F.col("status").alias("_status")), "block_id", "left"
    )
    fresh = F.coalesce(F.col("_is_current") & (F.col("_now") == F.col("fingerprint")), F.lit(False))
    return rows.select(
        *incoming.columns, F.when(fresh, "published").otherwise("stale").alias("outcome"), F.when(fresh, next_status(F.col("_status"), F.col("source"))).otherwise(F.col("_status")).alias("new_status")
    )


def mark_failed(translations: DataFrame, failures: DataFrame) -> DataFrame:
    """States after failures (block_id, fingerprint, error, and whether the text was too large): failed or
    oversized where there is no revision yet, else unchanged with the error; a failure of another fingerprint
    than the block's (`fingerprint` of translations) is stale and changes nothing."""
    rows = translations.join(failures.select("block_id", F.col("fingerprint").alias("_failed"), F.col("error").alias("_error"), "oversized"), "block_id", "left")
    counts = F.coalesce(F.col("_failed") == F.col("fingerprint"), F.lit(False))
    status = F.when(counts & F.col("current_revision_id").isNull(), F.when(F.col("oversized"), "oversized").otherwise("failed")).otherwise(F.col("status"))
    return rows.select("block_id", status.alias("status"), "current_revision_id", F.when(counts, F.col("_error")).alias("error"))


def record_corrections(incoming: DataFrame, blocks: DataFrame) -> DataFrame:
    """block_id, correction_id, status, reason after corrections (correction_id, block_id, fingerprint, scope): each
    makes a manual revision of its block, if the block still has that fingerprint; a global one is kept
    without its block. Of several corrections of a block the last id counts."""
    rows = incoming.join(blocks.select("block_id", F.col("fingerprint").alias("_now")), "block_id", "left")
    fresh = F.coalesce(F.col("_now") == F.col("fingerprint"), F.lit(False))
    kept = rows.where(fresh).groupBy("block_id").agg(F.max(F.struct("correction_id", "scope")).alias("_c"))
    return kept.select(
        "block_id", F.col("_c.correction_id").alias("correction_id"), F.when(F.col("_c.scope") == "block", F.col("block_id")).alias("correction_block_id"),
        F.lit("manually_corrected").alias("status"), F.lit(None).cast("string").alias("reason"),
    )


def call_audit(calls: DataFrame) -> DataFrame:
    """calls (job_id, call, provider, error, request) as they are logged: a sequence number within the job, the hash of
    the request, and the message cut to 2,000 characters."""
    order = Window.partitionBy("job_id").orderBy("call")
    return calls.select(
        "job_id", "call", F.row_number().over(order).alias("sequence"), F.when(F.col("error").isNull(), "succeeded").otherwise("failed").alias("status"),
        F.sha2("request", 256).alias("request_hash"), F.left("error", F.lit(2000)).alias("message"),
    )


def seeded(blocks: DataFrame, known: DataFrame) -> DataFrame:
    """Revisions for blocks whose text has a known translation (source_text, translated_text), by exact match."""
    by_text = known.groupBy("source_text").agg(F.min("translated_text").alias("translated_text"))
    return blocks.where("translatable").join(by_text, "source_text").select("block_id", "translated_text")


def return_path(value: Column, fallback: str = "/admin") -> Column:
    """Where to go after a correction: a page or the review list, with its query but without a fragment; else
    the fallback."""
    shape = r"^(/docs/[^?#\s]*|/admin/review)(\?[^#\s]*)?(?:#.*)?$"
    ok = value.rlike(shape) & ~value.rlike(r"^[^?#]*/\.{1,2}(?:[/?#]|$)")
    return F.when(F.coalesce(ok, F.lit(False)), F.concat(F.regexp_extract(value, shape, 1), F.regexp_extract(value, shape, 2))).otherwise(F.lit(fallback))


def backfill(blocks: DataFrame, translations: DataFrame) -> DataFrame:
    """Pending states for translatable blocks that have none."""
    new = blocks.where("translatable").join(translations.select("block_id"), "block_id", "left_anti")
    return new.select("block_id", "fingerprint", F.lit("pending").alias("status"))


def retry_plan(calls: DataFrame, attempts: int = 3) -> DataFrame:
    """job_id, call, provider, wait_s, action after each failed model call: the primary provider is tried up
    to `attempts` times on transient errors, a configuration error ends the job, and all else goes to the
    secondary provider once."""
    w = Window.partitionBy("job_id").orderBy("call")
    tries = F.count_if(F.col("provider") == "primary").over(w.rowsBetween(Window.unboundedPreceding, 0))
    action = (
        F.when(F.col("error").isNull(), "done").when(F.col("error") == "configuration", "fail").when(F.col("provider") == "secondary", "fail")
        .when(F.col("error").isin("timeout", "rate_limited", "server_error") & (tries < attempts), "retry").otherwise("secondary")
    )
    wait = F.when(action == "retry", F.greatest(tries, F.least(F.coalesce("retry_after_s", F.lit(0)), F.lit(30))))
    return calls.select("job_id", "call", "provider", action.alias("action"), wait.cast("long").alias("wait_s"))
