"""Ranked bilingual search with the best match of each page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import candidate_limit, contains_folded, like_pattern, looks_like_identifier, normalize_query


def best_match(query: str) -> Column:
    """struct(score, kind, snippet) of a row: identifier 120, title 100, path 90, translation 80, source 70.
    An identifier is looked for in the source text as it is written; the rest ignores case."""
    hit = lambda score, kind, text: F.struct(F.lit(score).alias("score"), F.lit(kind).alias("kind"), F.col(text).alias("snippet"))
    identifier = F.contains("source_text", F.lit(query)) if looks_like_identifier(query) else F.lit(False)
    return (
        F.when(identifier, hit(120, "identifier", "source_text")).when(contains_folded("title", query), hit(100, "title", "title"))
        .when(contains_folded("path", query), hit(90, "path", "path")).when(contains_folded("translated_text", query), hit(80, "translation", "translated_text"))
        .otherwise(hit(70, "source", "source_text"))
    )


def search_rows(pages: DataFrame, blocks: DataFrame, translations: DataFrame, revisions: DataFrame) -> DataFrame:
    """What is searched: each block of an active page with the page's path and title and its current translation."""
    # translations meet their texts before the blocks, so that the blocks' texts are shuffled once less
    current = translations.select("block_id", "current_revision_id").join(revisions.select(F.col("revision_id").alias("current_revision_id"), "translated_text"), "current_revision_id", "left")
    return (
        pages.where(F.col("status") == "active").select("page_id", "path", "title")
        .join(blocks.select("page_id", "block_id", "ordinal", "source_text").join(current, "block_id", "left"), "page_id")
    )


def ranked(rows: DataFrame, query: str, limit: int, *, whole: bool = False) -> DataFrame:
    """The best `limit` pages of search_rows() for a normal query; see search(). With `whole` each matching row is a candidate, however many there are."""
    most = candidate_limit(limit) if query else 0
    pattern = like_pattern(query)
    by = [F.col(c).ilike(pattern) for c in ("title", "path", "translated_text")]
    kind = F.when(by[0], 0).when(by[1], 1).when(by[2], 2).otherwise(3)
    found = rows.where(by[0] | by[1] | by[2] | F.col("source_text").ilike(pattern)).withColumn("_kind", kind)
    keys = ["_kind", "path", "ordinal", "block_id"]
    candidates = found if whole and most else found.orderBy(*keys).limit(most)
    scored = candidates.withColumn("_best", best_match(query))
    first = Window.partitionBy("page_id").orderBy(F.col("_best.score").desc(), *keys)
    best = scored.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    order = [F.col("_best.score").desc(), F.coalesce("title", "path"), F.col("page_id")]
    top = best.orderBy(*order).limit(max(limit, 0)).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return top.select("rank", "page_id", "path", "title", "_best.kind", "_best.score", "_best.snippet")


def search(pages: DataFrame, blocks: DataFrame, translations: DataFrame, revisions: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """rank, page_id, path, title, kind, score, snippet of the best `limit` pages.

    Candidates are the first candidate_limit(limit) matching block rows by kind of match, path and
    place; of a page's candidates the first of the best score stays. Ties end with the id."""
    return ranked(search_rows(pages, blocks, translations, revisions), normalize_query(query), limit)
