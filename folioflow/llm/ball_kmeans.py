"""Ball k-means over whole numbers, exact and the same on any number of machines.

A cluster is a ball: its centroid, and the largest distance of its members. Another centroid can take
a member only if it is nearer than twice that radius, so only such neighbours count; a member closer to its
centroid than half the way to the nearest neighbour lies in the stable core and stays without any comparison; the
others lie in annuli, cut at half the way to each neighbour, and are compared with the neighbours inside
their annulus only. All comparisons are between whole numbers, so the bounds decide exactly as full
comparisons would.

The balls are formed by each task from the members that it holds: a part of a cluster has a radius of its
own, never larger than the cluster's, so its neighbours are at most the cluster's. A round reads the
stored vectors with the cluster they are in, writes them with the next one, and sums each cluster's
components by Spark's own aggregation. The driver holds the centroids only (clusters x dimensions). A
round's table is deleted when the next one is written.

Defined results: vectors that are null, of another length or with null or non-finite components are left
out; a null vec_id orders as an empty text; rows that are repeated are vectors of their own. With fewer vectors
than clusters there are as many clusters as vectors; an empty table gives an empty result. A component that
is 2**27 or more after scaling stops the job with an error, since its distances needn't fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_path, small_batches, write_table

LIMIT = 1 << 27


def quantised(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 256) -> DataFrame:
    """vec_id and v, the components as whole numbers, of the vectors that are kept."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    fits = lambda x: F.when(F.abs(x) < LIMIT, x.cast("int")).otherwise(F.raise_error(F.lit("a component is too large")).cast("int"))
    vector = F.col(vector_col)
    kept = vectors.where(vector.isNotNull() & (F.size(vector) == dims)).where(F.forall(vector, finite))
    whole: Column = F.transform(vector, lambda x: fits(F.floor(F.lit(scale) * x.cast("double"))))
    return kept.select(F.col(id_col).alias("vec_id"), whole.alias("v"))


def square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a from the row or vector b, exactly."""
    return np.square(a - b).sum(axis=1, dtype=np.int64)


def next_clusters(x: np.ndarray, own: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number) and its square distance of each row of x; `own` is the cluster that each row is in."""
    apart = np.stack([square_distances(centroids, c) for c in centroids])
    half = (apart + 3) // 4  # a centroid can be as near as d2 only if its half-way square is at most d2
    cluster, least = own.copy(), np.zeros(len(x), dtype=np.int64)
    for i in np.unique(own):
        rows = np.flatnonzero(own == i)
        d2 = square_distances(x[rows], centroids[i])
        order = np.argsort(-d2, kind="stable")  # farthest first, so each annulus and what lies beyond it is a prefix
        rows, d2 = rows[order], d2[order]
        best, at = d2.copy(), np.full(len(rows), i)
        neighbours = np.flatnonzero(half[i] <= d2[0])
        for j in neighbours[np.argsort(half[i][neighbours], kind="stable")]:
            if j == i:
                continue
            n = int(np.searchsorted(-d2, -half[i][j], side="right"))
            other = square_distances(x[rows[:n]], centroids[j])
            better = (other < best[:n]) | ((other == best[:n]) & (j < at[:n]))
            best[:n][better], at[:n][better] = other[better], j
        cluster[rows], least[rows] = at, best
    return cluster, least


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """rows (vec_id, v, cluster) with their next cluster and its square distance."""
    schema = rows.select("vec_id", "v", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).schema
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
            own = batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
            cluster, least = next_clusters(x, own, centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cluster.astype(np.int32)), pa.array(least)], names=["vec_id", "v", "cluster", "distance"])

    return small_batches(rows).mapInArrow(run, schema)


def cluster_sums(rows: DataFrame, dims: int) -> DataFrame:
    """cluster, n, and `sums` of the components: a row for each cluster that a task holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
            own = batch.column("cluster").to_numpy(zero_copy_only=False)
            for i in np.unique(own).tolist():
                part = x[own == i]
                counts[i] = counts.get(i, 0) + len(part)
                sums[i] = sums.get(i, 0) + part.sum(axis=0)
        held = sorted(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([counts[i] for i in held], pa.int64()), pa.array([sums[i] for i in held], pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return small_batches(rows.select("v", "cluster")).mapInArrow(run, "cluster int, n long, sums array<long>")


def moved_centroids(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floor of each cluster's mean; those of empty clusters as they were."""
    parts = cluster_sums(rows, centroids.shape[1]).select("cluster", "n", F.posexplode("sums").alias("i", "s"))
    out = centroids.copy()
    for row in parts.groupBy("cluster", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():  # clusters x dimensions
        out[row["cluster"], row["i"]] = row["s"] // row["n"]
    return out


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of "seed:vec_id"."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["v"] for r in rows.orderBy(name, "v").limit(k).select("v").collect()], dtype=np.int64)


def ball_kmeans(vectors: DataFrame, *, k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, **options) -> DataFrame:
    """vec_id, cluster, distance (squared), and of its cluster the inertia and the centroid's SHA-256, and the whole inertia."""
    spark = vectors.sparkSession
    rows, path = write_table(quantised(vectors, dims=dims, **options).withColumn("cluster", F.lit(0)), "ball")
    centroids = first_centroids(rows, k, seed)
    empty = not len(centroids)
    for last in [False] * rounds + [True]:
        if empty:
            break
        before = path
        rows, path = write_table(assigned(rows, centroids), "ball")
        drop_path(spark, before)
        if not last:
            centroids = moved_centroids(rows, centroids)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    if empty:
        rows = rows.withColumn("distance", F.lit(None).cast("long"))
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # one row a cluster
    own = F.element_at(F.array(*[F.struct(F.lit(sums.get(i, 0)).cast("long").alias("s"), F.lit(name).alias("name")) for i, name in enumerate(names)] or [F.struct(F.lit(0).cast("long").alias("s"), F.lit("").alias("name"))]), F.col("cluster") + 1)
    return rows.select("vec_id", "cluster", "distance", own["s"].alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), own["name"].alias("centroid_sha256"))
