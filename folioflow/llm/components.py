"""Connected components of a graph held in DataFrames, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _stars(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Joins each edge with the smallest vertex next to its u. `least` is checkpointed, so that both
    sides have an exchange of their own and Spark can split the partition of a vertex with many edges."""
    return edges.join(checkpointed(least).withColumnRenamed("u", "_u"), F.col("u") == F.col("_u"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _stars(both, least).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = _stars(down, down.groupBy("u").agg(F.min("v").alias("m")))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(u, v) -> (u, v): each vertex with an edge, but the smallest of its component, with that
    smallest vertex. The links stay distributed; a round's result is checkpointed, and the rounds
    end when a round changes nothing (their number grows with the logarithm of the vertices)."""
    clean = lambda e: checkpointed(e.where(F.col("u") != F.col("v")).distinct())
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = clean(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    before = state(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        now = clean(_small(clean(_large(now))))
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now
