"""Queries of the parts of operators that work on rows as they come: fetch results, prompts, settlements, session deletes, listings, snapshots, and
restored model outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import url as U
from ..operators import budget, glossary, ops, protection, publish, translation
from ..sources import adapters as A
from .more_queries import _events, _pick, _sessions
from .queries import TERMS, query


@query
def fetch_results(spark: SparkSession, d: str) -> DataFrame:
    """Each document as the text form of a page, and as its HTML form, with statuses and types by number."""
    i, body = F.col("doc_id"), F.col("text")
    text = F.struct(_pick(i, (200, 200, 404, 406, 304, 410, 200, 503)).alias("status"), _pick(i, ("Text/Plain; charset=utf-8", "text/markdown", "text/html")).alias("content_type"), body.alias("body"))
    html = F.struct(_pick(i, (200, 200, 404, 500, 200)).alias("status"), _pick(i, ("text/html; charset=utf-8", "application/xhtml+xml", "image/png", None)).alias("content_type"), F.when(F.pmod(i, F.lit(13)) == 0, " \n").otherwise(body).alias("body"))
    return A.table(spark, d, "documents").select("doc_id", U.fetch_result(text, html).alias("r")).select("doc_id", "r.*")


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "region").select((F.col("r_regionkey") + 1).alias("version"), F.concat("r_name", F.lit(": {{sourceText}}")).alias("template"), (F.col("r_regionkey") == 2).alias("active"))


@query
def prompt_active(spark: SparkSession, d: str) -> DataFrame:
    return glossary.active_prompt(_prompts(spark, d)).select("version", "template")


@query
def prompt_creation(spark: SparkSession, d: str) -> DataFrame:
    """A prompt from each nation's name; every third lacks the mark for the text."""
    mark = F.when(F.pmod("n_nationkey", F.lit(3)) == 2, "text").otherwise("{{sourceText}}")
    new = A.table(spark, d, "nation").select(F.col("n_nationkey").alias("number"), F.concat("n_name", F.lit(" "), mark).alias("template"))
    return glossary.create_prompt(_prompts(spark, d), new)


@query
def budget_settlements(spark: SparkSession, d: str) -> DataFrame:
    number, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("long")
    reports = _events(spark, d).select(
        F.when(F.pmod(number, F.lit(19)) == 0, -number - 1).otherwise(number).alias("reservation_id"), F.when(F.pmod(number, F.lit(5)) > 0, F.when(F.pmod(number, F.lit(23)) == 1, F.lit(-1)).otherwise(k)).alias("reported_input"), F.col("user_id").alias("reported_output")
    )
    return budget.settle(A.token_ledger(spark, d), reports)


@query
def sessions_deleted(spark: SparkSession, d: str) -> DataFrame:
    """Sessions after single deletes (purchases), all of some users, and all others of some users."""
    kind = F.when(F.pmod("user_id", F.lit(10)) == 0, "user").when((F.pmod("user_id", F.lit(10)) == 1) & (F.pmod("event_id", F.lit(50)) == 7), "others").when(F.col("event_type") == "purchase", "session")
    deletes = _events(spark, d).select(kind.alias("kind"), F.col("event_id").alias("session_id"), "user_id").where(F.col("kind").isNotNull())
    return ops.sessions_after(_sessions(spark, d), deletes).select("session_id", "user_id")


@query
def current_block_list(spark: SparkSession, d: str) -> DataFrame:
    pages = A.source_pages(spark, d).withColumn("current_version", F.when(F.pmod("page_id", F.lit(5)) == 0, 2).otherwise(1))
    return translation.current_blocks(pages, A.content_blocks(spark, d).withColumn("version", F.lit(1)), A.block_translations(spark, d))


@query
def snapshots(spark: SparkSession, d: str) -> DataFrame:
    blocks = F.col("blocks")
    shown = F.array_join(F.transform(blocks, lambda b: F.concat_ws(":", b["ordinal"].cast("string"), b["block_type"], b["fingerprint"])), ",")
    return publish.page_snapshots(A.source_pages(spark, d), A.content_blocks(spark, d)).select("page_id", "path", F.sha2(shown, 256).alias("snapshot"), F.coalesce(F.size("blocks"), F.lit(0)).cast("long").alias("n_blocks"))


@query
def restored_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Answers for protected blocks: every fifth as it should be; the others lack a placeholder, repeat one, have two in the wrong order, or an unknown one."""
    blocks = A.content_blocks(spark, d).where("translatable")
    rows = protection.protect_blocks(blocks, TERMS).select("block_id", "protected.*")
    name = lambda i: F.coalesce(F.get("tokens", F.lit(i))["placeholder"], F.lit("⟦none⟧"))
    swapped = F.replace(F.replace(F.replace("text", name(0), F.lit("⟦x⟧")), name(1), name(0)), F.lit("⟦x⟧"), name(1))
    kind = F.pmod("block_id", F.lit(5))
    answer = (
        F.when((kind == 1) & (F.size("tokens") > 0), F.concat(F.lit("a "), F.replace("text", name(0), F.lit("")))).when((kind == 2) & (F.size("tokens") > 0), F.concat("text", name(0)))
        .when((kind == 3) & (F.size("tokens") > 1), swapped).when(kind == 4, F.concat("text", F.lit("⟦P9999⟧"))).otherwise(F.col("text"))
    )
    checked = protection.validate_output(F.to_json(F.struct(answer.alias("translatedText"))), F.col("tokens"), 1 << 20)
    return rows.select("block_id", checked.alias("r")).select("block_id", "r.text", "r.error")
