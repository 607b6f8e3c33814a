"""Reader pages, summaries, review queue and block context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRANSLATED = ("ai_translated", "manually_corrected")
REVIEW_ORDER = ("review_required", "failed", "pending", "ai_translated", "manually_corrected", "oversized")


def with_translation(blocks: DataFrame, translations: DataFrame, revisions: DataFrame) -> DataFrame:
    """Blocks with status, current revision and its text; blocks without a state are kept."""
    current = revisions.select(F.col("revision_id").alias("current_revision_id"), "translated_text")
    return blocks.join(translations.select("block_id", "status", "current_revision_id"), "block_id", "left").join(current, "current_revision_id", "left")


def reader_page(pages: DataFrame, blocks: DataFrame, translations: DataFrame, revisions: DataFrame, path: str) -> DataFrame:
    """Blocks of the active page at `path` in order, each with its translation and the whole revision
    history, newest first, flagged where current. Histories are gathered before the join, so blocks
    aren't multiplied."""
    page = pages.where((F.col("path") == path) & (F.col("status") == "active")).select("page_id", "path", "title")
    rows = with_translation(page.join(blocks, "page_id"), translations, revisions)
    wanted = revisions.join(rows.select("block_id", "current_revision_id"), "block_id")
    history = wanted.groupBy("block_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "revision_id", "source", (F.col("revision_id") == F.col("current_revision_id")).alias("current"))), asc=False).alias("history")
    )
    return rows.join(history, "block_id", "left").select("page_id", "path", "title", "block_id", "ordinal", "block_type", "source_text", "status", "translated_text", "history")


def summarize(blocks: DataFrame, translations: DataFrame) -> DataFrame:
    """Counts of each page: all blocks, and by state the translatable ones (no state: pending)."""
    rows = blocks.join(translations.select("block_id", "status"), "block_id", "left").withColumn("status", F.coalesce("status", F.lit("pending")))
    count = lambda *s: F.count_if(F.col("translatable") & F.col("status").isin(*s))
    return rows.groupBy("page_id").agg(
        F.count("*").alias("blocks"), F.count_if("translatable").alias("translatable"), count(*TRANSLATED).alias("translated"), count("pending").alias("pending"),
        count("failed").alias("failed"), count("review_required").alias("review_required"),
    )


def review_items(pages: DataFrame, blocks: DataFrame, translations: DataFrame, limit: int = 50) -> DataFrame:
    """Translatable blocks by urgency of their state, then newest, path and place. Pages of any status."""
    limit = min(100, max(1, int(limit)))
    status = F.coalesce("status", F.lit("pending"))
    rank = F.coalesce(*[F.when(status == s, F.lit(i)) for i, s in enumerate(REVIEW_ORDER)], F.lit(len(REVIEW_ORDER)))
    rows = blocks.where("translatable").join(pages.select("page_id", "path"), "page_id").join(translations, "block_id", "left")
    keys = [F.col("urgency"), F.col("revision").desc_nulls_last(), F.col("path"), F.col("ordinal"), F.col("block_id")]
    top = rows.select("block_id", "path", "ordinal", status.alias("status"), rank.alias("urgency"), F.col("current_revision_id").alias("revision")).orderBy(*keys).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*keys)))


def block_context(blocks: DataFrame) -> DataFrame:
    """Each block with the source text of the nearest blocks before and after it."""
    w = Window.partitionBy("page_id").orderBy("ordinal")
    return blocks.select("block_id", "page_id", "ordinal", F.lag("source_text").over(w).alias("previous_text"), F.lead("source_text").over(w).alias("next_text"))


def display_text(source: Column, translated: Column, language: str) -> Column:
    """The translation where there is one, else the source."""
    return F.coalesce(F.nullif(translated, F.lit("")), source) if language != "source" else source


def status_label(status: Column) -> Column:
    labels = {"pending": "Pending", "ai_translated": "Translated", "manually_corrected": "Corrected", "review_required": "Needs review", "failed": "Failed", "oversized": "Too large"}
    return F.coalesce(*[F.when(status == k, F.lit(v)) for k, v in labels.items()], F.lit("Pending"))


def contents(blocks: DataFrame, pages: DataFrame, deepest: int = 6) -> DataFrame:
    """Headings of each page in order, without a first block that repeats the title."""
    rows = blocks.where(F.col("block_type") == "heading").join(pages.select("page_id", "title"), "page_id")
    return rows.where(~((F.col("ordinal") == 0) & (F.col("source_text") == F.col("title")))).select("page_id", "ordinal", "source_text", F.least(F.col("depth"), F.lit(deepest)).alias("depth"))
