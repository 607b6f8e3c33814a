"""A corpus pipeline of five stages over the table `documents`.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as
Parquet and read again before the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import remainder, stored
from folioflow.llm.decontamination import decontaminate
from folioflow.llm.hilbert_sharding import shard
from folioflow.llm.simhash import deduplicate
from folioflow.llm.source_mixing import language_rate, mixed
from folioflow.llm.toxicity import train, without_toxic

#: No DuckDB equivalent: the first stage trains a model. The stages are tested against brute force.
ORACLE_SQL = None

TOXIC_FROM = 0.3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below TOXIC_FROM."""
    model = train(docs.where(remainder(F.col("doc_id"), 4) != 2), _table(spark, sf_dir, "labels"))
    return without_toxic(docs, model, toxic_from=TOXIC_FROM)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by the copies that meet the sources' target weights."""
    return mixed(docs, base_rate=language_rate(F.col("lang")))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every copy in eight shards along a Hilbert curve."""
    return shard(docs)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mixing),
    ("hilbert_sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
