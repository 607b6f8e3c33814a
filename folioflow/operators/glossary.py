"""Glossary versions: validation, activation, browsing and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def active_terms(versions: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms of the active version by normalized form."""
    return terms.join(F.broadcast(versions.where("active").limit(1).select("version")), "version", "left_semi").orderBy("normalized_term", "term_id")


def newest(versions: DataFrame, limit: int = 20) -> DataFrame:
    return versions.orderBy(F.col("version").desc()).limit(min(50, max(1, int(limit))))


def differences(versions: DataFrame, terms: DataFrame, limit: int = 20) -> DataFrame:
    """version, added, removed: terms of each of the newest versions that the active one lacks, and the
    reverse. If the active version isn't among the newest, all terms count as added."""
    top = newest(versions, limit)
    own = terms.join(top.select("version"), "version", "left_semi").select("version", "normalized_term").distinct()
    base = own.join(top.where("active").select("version"), "version", "left_semi").select("normalized_term")
    only = own.join(base, "normalized_term", "left_anti").groupBy("version").agg(F.count("*").alias("added"))
    shared = own.join(base, "normalized_term", "left_semi").groupBy("version").agg(F.count("*").alias("shared"))
    total = base.agg(F.count("*").alias("base"))
    joined = top.join(only, "version", "left").join(shared, "version", "left").crossJoin(F.broadcast(total))
    return joined.select("version", "active", F.coalesce("added", F.lit(0)).alias("added"), (F.col("base") - F.coalesce("shared", F.lit(0))).alias("removed"))


def validate(terms: DataFrame) -> DataFrame:
    """Trimmed terms with an error: not printable ASCII, or a duplicate without regard to case."""
    clean = terms.withColumn("source_term", F.trim("source_term")).withColumn("normalized_term", F.lower("source_term"))
    repeated = F.count("*").over(Window.partitionBy("version", "normalized_term")) > 1
    error = F.when(~F.col("source_term").rlike(r"^[\x20-\x7e]+$"), "not_ascii").when(repeated, "duplicate_term")
    return clean.withColumn("error", error)


def activate(versions: DataFrame) -> DataFrame:
    """Add a version after the newest and make it the only active one."""
    added = versions.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version")).withColumn("active", F.lit(True))
    return versions.withColumn("active", F.lit(False)).unionByName(added)


def active_prompt(prompts: DataFrame) -> DataFrame:
    """The active prompt version; the newest, should there be several."""
    return prompts.where("active").orderBy(F.col("version").desc()).limit(1)


def create_prompt(prompts: DataFrame, new: DataFrame) -> DataFrame:
    """prompts (version, template, active, any more) with those of `new` (number, template, any more) added in order of their numbers, each as the version
    after the newest; the last one is the only active version. A template must hold the mark {{sourceText}}; others aren't added."""
    good = new.where(F.contains("template", F.lit("{{sourceText}}")))
    newest = prompts.agg(F.coalesce(F.max("version"), F.lit(0)).alias("_newest"))
    place = F.row_number().over(Window.orderBy("number"))  # prompts are written by hand
    added = good.crossJoin(F.broadcast(newest)).withColumn("version", F.col("_newest") + place)
    last = added.agg(F.max("version").alias("_last"))
    every = prompts.unionByName(added.withColumn("active", F.lit(False)).select(*prompts.columns)).crossJoin(F.broadcast(last))
    return every.withColumn("active", F.when(F.col("_last").isNull(), F.col("active")).otherwise(F.col("version") == F.col("_last"))).drop("_last")
