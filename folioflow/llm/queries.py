"""Queries over the driver's tables, one for each operator, with production parameters.

Each query applies its operator to its whole table and derives the digest columns that are
reported; the operators themselves keep their own general results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ball_kmeans import ball_kmeans
from .common import remainder
from .decontamination import benchmark_matches, contamination
from .hilbert_sharding import shard
from .html_extraction import extract
from .license_scan import license_scan
from .lm_scoring import lm_scores
from .quality_rules import quality_rules
from .simhash import near_duplicates
from .source_mixing import language_rate, mix
from .spelling import spelling_groups
from .toxicity import score as toxicity_score
from .toxicity import train as toxicity_train
from .tree_search import nearest_neighbours
from .warc import captures

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = toxicity_train(docs.where(~held_out), table(spark, sf_dir, "labels"))
    out = toxicity_score(docs.select("doc_id", "text"), model)
    return out.select(
        "doc_id", held_out.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.3).cast("int").alias("predicted"),
        F.col("_worst").alias("worst_word"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_scores(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 10) != 0)
    return out.withColumns({"base_score": F.round("base_score", 6), "score": F.round("score", 6)})


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan(table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda x: x["start"])
    joined = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    base, more = F.transform("places", lambda x: x["label"]), F.transform("detections", lambda x: x["label"])
    weight = lambda c: F.coalesce(F.array_max(F.transform(c, lambda x: x["weight"])), F.lit(0.0))
    return out.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(F.concat(base, more)).alias("labels"),
        F.greatest(weight("places"), weight("detections")).alias("score"),
    )


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op7_warc_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = captures(table(spark, sf_dir, "pages"))
    seen = lambda name: F.coalesce(F.col(f"original.{name}"), F.col(f"response.{name}")).alias(name)
    return out.select(
        F.col("page_id").cast("long").alias("page_id"), seen("payload_bytes"), seen("payload_digest"),
        F.col("response.type").alias("record_type"), F.col("original_page_id").cast("long").alias("refers_to"),
    )


def op8_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"), base_rate=language_rate(F.col("lang")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans(table(spark, sf_dir, "embeddings"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 20 == 0))


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_rules": op2_quality_rules,
    "op3_simhash": op3_simhash,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_license_scan": op5_license_scan,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_warc_assembly": op7_warc_assembly,
    "op8_hilbert_sharding": op8_hilbert_sharding,
    "op9_html_extraction": op9_html_extraction,
    "op10_source_mixing": op10_source_mixing,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_nearest_neighbours": op13_nearest_neighbours,
}
