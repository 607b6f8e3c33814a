"""Discovery upserts, version decisions of fetched pages, and inheritance of translation states."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import page_fingerprint
from .diff import diff_blocks


def upsert_discovered(pages: DataFrame, found: DataFrame, now: datetime) -> DataFrame:
    """pages after a discovery: found URLs are inserted or updated and no longer missing."""
    new = found.select("canonical_url", F.col("path").alias("_path")).dropDuplicates(["canonical_url"])
    joined = pages.join(new, "canonical_url", "full")
    seen = F.col("_path").isNotNull()
    return joined.select(
        "canonical_url", F.coalesce("_path", "path").alias("path"), F.when(seen, F.lit(now)).otherwise(F.col("last_discovered_at")).alias("last_discovered_at"),
        F.when(~seen, F.col("missing_since")).alias("missing_since"),
    )


def mark_missing(pages: DataFrame, started: datetime, now: datetime) -> DataFrame:
    """Pages that a complete discovery, begun at `started`, hasn't seen get a marker unless they have one."""
    unseen = F.col("missing_since").isNull() & (F.col("last_discovered_at").isNull() | (F.col("last_discovered_at") < F.lit(started)))
    return pages.withColumn("missing_since", F.when(unseen, F.lit(now)).otherwise(F.col("missing_since")))


def latest_status(events: DataFrame) -> DataFrame:
    """page_id, status after its last fetch: active after ok or not_modified, gone after 404 or 410, blocked by robots."""
    last = events.groupBy("page_id").agg(F.max_by("result", F.struct("at", "event_id")).alias("result"))
    status = F.when(F.col("result").isin("ok", "not_modified"), "active").when(F.col("result") == "gone", "gone").when(F.col("result") == "blocked", "blocked").otherwise("active")
    return last.select("page_id", status.alias("status"))


def version_decisions(fetches: DataFrame) -> DataFrame:
    """fetches (page_id, at, fetch_id, fingerprint) with decision and version. In time order of a page: the
    fingerprint before it is unchanged; one seen earlier restores that version; a new one is published
    as the next version."""
    by_time = Window.partitionBy("page_id").orderBy("at", "fetch_id")
    first = F.row_number().over(Window.partitionBy("page_id", "fingerprint").orderBy("at", "fetch_id")) == 1
    marked = fetches.withColumns({"_first": first, "_same": F.lag("fingerprint").over(by_time).eqNullSafe(F.col("fingerprint"))})
    counted = marked.withColumn("_count", F.sum(F.col("_first").cast("int")).over(by_time))
    version = F.first(F.when(F.col("_first"), F.col("_count")), ignorenulls=True).over(
        Window.partitionBy("page_id", "fingerprint").orderBy("at", "fetch_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    decision = F.when(F.col("_first"), "published").when(F.col("_same"), "unchanged").otherwise("restored")
    return counted.select("page_id", "at", "fetch_id", "fingerprint", decision.alias("decision"), version.cast("long").alias("version"))


def current_versions(decided: DataFrame) -> DataFrame:
    """page_id, version that the page points to after its last fetch."""
    return decided.groupBy("page_id").agg(F.max_by("version", F.struct("at", "fetch_id")).alias("version"))


def inherit_states(current: DataFrame, previous: DataFrame, translations: DataFrame) -> DataFrame:
    """New states of current blocks (block_id, previous_id or null, fingerprint). No previous block: pending.
    A changed source makes review_required after manual work, else pending; an unchanged one keeps its
    state. The current revision is inherited in both cases."""
    old = previous.select(F.col("block_id").alias("previous_id"), F.col("fingerprint").alias("_old")).join(
        translations.select(F.col("block_id").alias("previous_id"), F.col("status").alias("_status"), F.col("current_revision_id")), "previous_id", "left"
    )
    rows = current.join(old, "previous_id", "left")
    changed = F.col("_old") != F.col("fingerprint")
    manual = F.col("_status").isin("manually_corrected", "review_required")
    status = F.when(F.col("_old").isNull(), "pending").when(changed & manual, "review_required").when(changed, "pending").otherwise(F.coalesce("_status", F.lit("pending")))
    reason = F.when(changed & manual, "source_changed_after_manual_correction")
    return rows.select("block_id", status.alias("status"), reason.alias("reason"), "current_revision_id")


def translation_jobs(candidates: DataFrame, priority: int) -> DataFrame:
    key = F.concat_ws(":", F.lit("translate"), F.col("block_id").cast("string"), "fingerprint")
    return candidates.select("block_id", key.alias("dedupe_key"), F.lit(priority).alias("priority"))


def publish_decisions(fetched: DataFrame, versions: DataFrame) -> DataFrame:
    """page_id, decision, version of fetched pages (blocks). versions: page_id, version, fingerprint, current. A page
    like its current version is unchanged, one like an older version restores that, any other is published
    as the next."""
    now = fetched.groupBy("page_id").agg(page_fingerprint("ordinal", "block_type", "fingerprint").alias("_now"))
    rows = now.join(versions, "page_id", "left")
    same = F.col("fingerprint") == F.col("_now")
    by_page = rows.groupBy("page_id").agg(
        F.bool_or(same & F.col("current")).alias("_same"), F.max(F.when(same, F.col("version"))).alias("_old"), F.max("version").alias("_last")
    )
    decision = F.when(F.col("_same"), "unchanged").when(F.col("_old").isNotNull(), "restored").otherwise("published")
    version = F.coalesce("_old", F.coalesce("_last", F.lit(0)) + 1)
    return by_page.select("page_id", decision.alias("decision"), version.cast("long").alias("version"))


def paired_blocks(every: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """The new blocks of diff_blocks(old, new, every=True), each with the id of the old block that it comes from, if any."""
    place = Window.partitionBy("page_id").orderBy("ordinal")
    index = lambda df, name: df.withColumn(name, F.row_number().over(place) - 1)
    now = index(new, "current_index").select("page_id", "current_index", "block_id", "fingerprint", "translatable")
    before = index(old, "previous_index").select("page_id", "previous_index", F.col("block_id").alias("previous_id"))
    return every.where(F.col("current_index").isNotNull()).join(now, ["page_id", "current_index"]).join(before, ["page_id", "previous_index"], "left")


def publish_pages(fetched: DataFrame, versions: DataFrame, previous: DataFrame, translations: DataFrame, priority: int = 10) -> dict[str, DataFrame]:
    """What publishing fetched pages writes: `decisions`, and for published pages the `changes` of their blocks, the
    `states` that their blocks inherit and the translation `jobs` for what is new or changed. Blocks have
    block_id, page_id, ordinal, block_type, fingerprint, translatable; previous holds those of the current versions."""
    decisions = publish_decisions(fetched, versions)
    published = decisions.where(F.col("decision") == "published").select("page_id")
    new, old = fetched.join(published, "page_id", "left_semi"), previous.join(published, "page_id", "left_semi")
    every = diff_blocks(old, new, every=True)
    pairs = paired_blocks(every, old, new)
    current = pairs.where("translatable").select("block_id", "previous_id", "fingerprint")
    candidates = pairs.where("candidate").select("block_id", "fingerprint")
    return {
        "decisions": decisions, "changes": every.where(F.col("kind") != "same"), "states": inherit_states(current, old, translations),
        "jobs": translation_jobs(candidates, priority),
    }


def latest_rows(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The row of each key written last: what a table of single-key upserts holds."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), at).alias("_r")).select(*keys, "_r.*")


def ensure_pages(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """pages (canonical_url, path) with those wanted inserted, or their path updated."""
    new = wanted.groupBy("canonical_url").agg(F.max("path").alias("_path"))
    return pages.join(new, "canonical_url", "full").select("canonical_url", F.coalesce("_path", "path").alias("path"))


def refresh_list(pages: DataFrame) -> DataFrame:
    """Active pages in order of their ids."""
    return pages.where(F.col("status") == "active").select("page_id", "path").orderBy("page_id")


def page_snapshots(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """page_id, path and the blocks of each page's current version in order, as one array."""
    own = blocks.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "block_type", "fingerprint"))).alias("blocks"))
    return pages.select("page_id", "path").join(own, "page_id", "left")


def fetch_log(fetches: DataFrame, keep_days: int = 7) -> DataFrame:
    """The log of fetches, with the time until which the body of a failed one is kept."""
    failed = ~F.col("result").isin("ok", "not_modified")
    return fetches.withColumn("expires_at", F.when(failed, F.col("at") + F.make_dt_interval(days=F.lit(keep_days))))
