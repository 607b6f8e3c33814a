"""Corpus tables built from the plain tables: pages, blocks, translations, revisions, jobs, ledger, glossary.

Each function takes (spark, folder) and returns a DataFrame; the same rules in SQL are in
plans/corpus_sql.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SITE
from ..functions.text import block_fingerprint


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))


def source_pages(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, path, canonical_url, title, status."""
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    path = F.concat_ws("/", F.lit(SITE.root), "lang", "source", F.col("doc_id").cast("string"))
    return _lines(spark, folder).join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("page_id"), path.alias("path"), F.concat(F.lit(SITE.origin), path).alias("canonical_url"),
        F.get("lines", F.lit(0)).alias("title"), F.when(F.col("toxic") == 1, "blocked").otherwise("active").alias("status"),
    )


def content_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """block_id, page_id, ordinal, block_type, source_text, translatable, depth, payload, fingerprint. Every fifth line is a heading."""
    kind = F.when(F.pmod("ordinal", F.lit(5)) == 0, "heading").when(F.contains("source_text", F.lit(" | ")), "code").otherwise("paragraph")
    return (
        _lines(spark, folder).select(F.col("doc_id").alias("page_id"), F.posexplode("lines").alias("ordinal", "source_text"))
        .withColumn("block_type", kind)
        .select(
            (F.col("page_id") * 100000 + F.col("ordinal")).alias("block_id"), "page_id", "ordinal", "block_type", "source_text",
            (F.col("block_type") != "code").alias("translatable"), F.when(F.col("ordinal") == 0, 1).otherwise(2).alias("depth"),
            F.when(F.col("block_type") == "heading", F.when(F.col("ordinal") == 0, '{"depth":1}').otherwise('{"depth":2}'))
            .when(F.col("block_type") == "code", '{"language":""}').otherwise('{"protectedTokens":[]}').alias("payload"),
        )
        .withColumn("fingerprint", block_fingerprint("block_type", "source_text", "payload"))
    )


def block_translations(spark: SparkSession, folder: str) -> DataFrame:
    """block_id, status, current_revision_id: the state of each labelled page's translatable blocks."""
    status = F.when(F.col("toxic") == 1, "review_required").when(F.col("quality") == 1, "ai_translated").otherwise("failed")
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("page_id"), status.alias("status"))
    latest = translation_revisions(spark, folder).groupBy("block_id").agg(F.max("revision_id").alias("current_revision_id"))
    blocks = content_blocks(spark, folder).where("translatable").select("block_id", "page_id")
    return blocks.join(labels, "page_id").join(latest, "block_id", "left").select("block_id", "status", "current_revision_id")


def translation_revisions(spark: SparkSession, folder: str) -> DataFrame:
    """revision_id, block_id, turn, source, translated_text: each conversation is a history of the
    block after its page's heading."""
    source = F.when(F.col("role") == "user", "manual").when(F.col("role") == "assistant", "ai").otherwise("ai_memory")
    return table(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("revision_id"), (F.col("conv_id") * 100000 + 1).alias("block_id"), "turn",
        source.alias("source"), F.col("text").alias("translated_text"),
    )


def job_log(spark: SparkSession, folder: str) -> DataFrame:
    """Enqueue requests and job states from the events: job_id, dedupe_key, queue, type, status, priority,
    attempts, run_at, lease_until, message."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("job_id"), F.concat(F.lit("page:"), F.col("user_id")).alias("dedupe_key"),
        F.when(kind.isin("click", "view"), "ingestion").otherwise("translation").alias("queue"), kind.alias("type"),
        F.when(kind == "error", "failed").when(kind == "purchase", "succeeded").when(kind == "signup", "running").otherwise("queued").alias("status"),
        k.alias("priority"), F.pmod("event_id", F.lit(5)).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"), F.col("ts").alias("run_at"),
        (F.col("ts") + F.expr("INTERVAL 3 MINUTES")).alias("lease_until"), F.col("props").alias("message"),
    )


def token_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Reservations from the events: reservation_id, at, usage_date, tokens, status, input_tokens, output_tokens."""
    kind = F.col("event_type")
    tokens = F.floor("value").cast("long") + 1
    return table(spark, folder, "events").select(
        F.col("event_id").alias("reservation_id"), F.col("ts").alias("at"), F.to_date(F.col("ts") + F.expr("INTERVAL 8 HOURS")).alias("usage_date"),
        tokens.alias("tokens"), F.when(kind == "purchase", "settled").when(kind == "error", "released").when(kind == "signup", "request_started").otherwise("reserved").alias("status"),
        F.when(F.pmod("event_id", F.lit(7)) != 0, F.floor(tokens / 2)).cast("long").alias("input_tokens"), F.pmod("event_id", F.lit(300)).cast("long").alias("output_tokens"),
    )


def glossary_terms(spark: SparkSession, folder: str) -> DataFrame:
    """version, term_id, source_term, normalized_term: a glossary version for each part size."""
    return table(spark, folder, "part").select(
        F.col("p_size").cast("int").alias("version"), F.col("p_partkey").alias("term_id"), F.col("p_name").alias("source_term"), F.lower("p_name").alias("normalized_term"),
    )


def glossary_versions(spark: SparkSession, folder: str) -> DataFrame:
    """version, active: the newest is active, and one version has no terms."""
    sizes = table(spark, folder, "part").select(F.col("p_size").cast("int").alias("version")).distinct()
    empty = sizes.agg((F.max("version") + 1).alias("version"))
    newest = sizes.agg(F.max("version").alias("newest"))
    return sizes.union(empty).crossJoin(F.broadcast(newest)).select("version", (F.col("version") == F.col("newest")).alias("active"))
