"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint has a bit set if it is set in over half the shingles' XXH64 hashes. Distinct
fingerprints at `radius` or fewer differing bits are linked. Cut into m blocks of bits, such a
pair agrees in m - radius blocks at least, so each choice of that many blocks is a table whose
buckets hold every linked pair; no pair is missed. m is chosen from the number of distinct
fingerprints, so that buckets stay short.

Buckets are compared bit-sliced: the members' bits are turned into planes (one word holds a bit of
64 members), each plane's differences are added into carry-save counters for all lanes at once, and
blocks of lanes are left as soon as all of them exceed the radius. A bucket above `chunk` members is
split by hash into chunks, and each pair of chunks is a group of its own, so that no group grows
with the data. Groups give a star for each local component (links between members of a component
are not written out pair by pair), and the stars are joined into components by rounds of DataFrame
joins. A fingerprint that very many documents share is a hot key of the last join, from fingerprints back to
documents; both of its sides are stored tables, so Spark's adaptive execution splits it.

Defined results: null and wordless texts have fingerprint 0 and are linked to each other; exact
copies share a fingerprint; repeated rows are members like any other; a component whose doc_ids are
all null has a null component_id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_place, lower_words, small_batches, stored, text_chunks
from .components import connected_components

BITS = 64
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    words = lower_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        starts = np.concatenate([[0], ends[:-1]])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts[: 1 - shingle].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], dtype=np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """The documents with a column _fp (any of that name is replaced), the fingerprint as a signed long."""
    docs = docs.drop("_fp")
    schema = docs.limit(0).withColumn("_fp", F.lit(0).cast("long")).schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch, text_col):
                fps = np.array([fingerprint(t, shingle, seed) for t in texts], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fps)], names=[*part.schema.names, "_fp"])

    return small_batches(docs).mapInArrow(add, schema)


def bit_planes(values: np.ndarray) -> np.ndarray:
    """uint64 values -> [64, words]: word w of plane b holds bit b of values 64w to 64w + 63."""
    padded = np.zeros(-(-len(values) // 64) * 64, dtype=np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


class _Counters:
    """Carry-save counters of differing bits, one for every lane of the words added to."""

    def __init__(self, words: int, radius: int):
        self.radius, self.width = radius, max(1, radius.bit_length())
        self.sums = [np.zeros(words, dtype=np.uint64) for _ in range(self.width)]
        self.over = np.zeros(words, dtype=np.uint64)

    def add(self, plane: np.ndarray) -> None:
        carry = plane
        for i in range(self.width):
            self.sums[i], carry = self.sums[i] ^ carry, self.sums[i] & carry
        self.over |= carry

    def exceeded(self) -> np.ndarray:
        """Lanes whose count is above the radius."""
        above, equal = self.over.copy(), ~np.zeros_like(self.over)
        for i in range(self.width - 1, -1, -1):
            if self.radius >> i & 1:
                equal &= self.sums[i]
            else:
                above |= equal & self.sums[i]
                equal &= ~self.sums[i]
        return above

    def keep(self, alive: np.ndarray) -> None:
        self.sums, self.over = [s[alive] for s in self.sums], self.over[alive]


def lanes_within(planes: np.ndarray, radius: int, queries: np.ndarray | None = None) -> np.ndarray:
    """[queries, words] of lane bits: which lanes differ from each query in `radius` bits or fewer.
    Without queries the planes hold differences already, and the result has one row."""
    n_words = planes.shape[1]
    rows = 1 if queries is None else len(queries)
    row = np.repeat(np.arange(rows), n_words)
    word = np.tile(np.arange(n_words), rows)
    counters = _Counters(len(row), radius)
    for b in range(BITS):
        plane = planes[b][word]
        if queries is not None:
            plane = plane ^ (((queries >> np.uint64(b)) & np.uint64(1)) * ALL)[row]
        counters.add(plane)
        if b % 6 == 5 and b < BITS - 1:
            alive = counters.exceeded() != ALL
            if not alive.any():
                return np.zeros((rows, n_words), dtype=np.uint64)
            if alive.mean() < 0.7:
                counters.keep(alive)
                row, word = row[alive], word[alive]
    out = np.zeros((rows, n_words), dtype=np.uint64)
    out[row, word] = ~counters.exceeded()
    return out


def _lane_bits(words: np.ndarray, n: int) -> np.ndarray:
    flat = np.ascontiguousarray(words)
    return np.unpackbits(flat.view(np.uint8).reshape(len(flat), -1), axis=1, bitorder="little")[:, :n].astype(bool)


def local_stars(members: np.ndarray, radius: int, tile: int = 256) -> list[tuple[int, int]]:
    """(member, smallest member of its component) within one group of distinct fingerprints."""
    members = np.unique(members)
    n, planes = len(members), bit_planes(members)
    near = np.concatenate([_lane_bits(lanes_within(planes, radius, members[a : a + tile]), n) for a in range(0, n, tile)])
    labels = np.arange(n)
    while True:
        least = np.where(near, labels[None, :], n).min(axis=1)
        least = least[least]
        if (least == labels).all():
            break
        labels = least
    moved = np.flatnonzero(labels != np.arange(n))
    return list(zip(members[moved].tolist(), members[labels[moved]].tolist(), strict=True))


def small_links(groups: list[np.ndarray], radius: int) -> list[tuple[int, int]]:
    """Links in groups of a few members: every pair of all the groups is a lane of one comparison."""
    left, right = [], []
    for size in {len(g) for g in groups}:
        same = np.stack([g for g in groups if len(g) == size])
        i, j = np.triu_indices(size, 1)
        left.append(same[:, i].ravel())
        right.append(same[:, j].ravel())
    if not left:
        return []
    a, b = np.concatenate(left), np.concatenate(right)
    hits = _lane_bits(lanes_within(bit_planes(a ^ b), radius), len(a))[0]
    return list(zip(a[hits].tolist(), b[hits].tolist(), strict=True))


def block_masks(blocks: int, radius: int) -> list[int]:
    """Masks of all choices of blocks - radius blocks of the 64 bits."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, *, radius: int = 4, chunk: int = 2048, blocks: int | None = None, broadcast_rows: int = 100_000) -> DataFrame:
    """Stars (u, v) that connect every two of the distinct fingerprints _fp at `radius` bits or fewer."""
    spark = distinct.sparkSession
    if blocks is None:
        n = distinct.count()
        blocks = radius + (2 if n < 1 << 25 else 3 if n < 1 << 31 else 4)
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("_fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(block_masks(blocks, radius))]))
    rows = distinct.select("_fp", keys.alias("b")).select("_fp", "b.t", "b.k")
    large = stored(rows.groupBy("t", "k").count().where(F.col("count") > chunk).select(F.col("t").alias("_t"), F.col("k").alias("_k"), "count"), "buckets")
    if large.count() <= broadcast_rows:
        large = F.broadcast(large)
    parts = F.coalesce(F.ceil(F.col("count") / chunk), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("_fp"), parts).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(F.col("own"), j).alias("a"), F.greatest(F.col("own"), j).alias("b"))
    )
    placed = (
        rows.join(large, (F.col("t") == F.col("_t")) & (F.col("k") == F.col("_k")), "left")
        .withColumn("parts", parts).withColumn("own", own).select("_fp", "t", "k", F.explode(pairs).alias("p"))
    )
    groups = placed.groupBy("t", "k", "p").agg(F.collect_list("_fp").alias("members")).where(F.size("members") > 1).select("members")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            found, small = [], []
            for members in np.split(values, ends[:-1]):
                if len(members) <= 8:
                    small.append(members)
                else:
                    found += local_stars(members, radius)
            found += small_links(small, radius)
            flat = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["u", "v"])

    return groups.mapInArrow(compare, spark.createDataFrame([], "u long, v long").schema)


def components(with_fp: DataFrame, *, id_col: str = "doc_id", radius: int = 4, **options) -> DataFrame:
    """_fp of every distinct fingerprint -> component (its smallest fingerprint) and component_id (its
    smallest document id). with_fp should be stored: it is read twice."""
    distinct = stored(with_fp.groupBy("_fp").agg(F.min(id_col).alias("_least")), "fingerprints")
    joined = connected_components(links(distinct, radius=radius, **options))
    labelled = distinct.join(joined, F.col("_fp") == F.col("u"), "left").select("_fp", "_least", F.coalesce("v", "_fp").alias("component"))
    labelled = stored(labelled, "labels")
    least = stored(labelled.groupBy("component").agg(F.min("_least").alias("component_id")), "least")
    return stored(labelled.join(least, "component").select("_fp", "component", "component_id"), "components")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    rows = stored(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", "_fp"), "simhash")
    found = components(rows, **options).withColumnRenamed("_fp", "_found")
    return rows.join(found, F.col("_fp") == F.col("_found")).select(
        "doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1_000_000, **options) -> DataFrame:
    """One document of every component: the one with the smallest id (of repeated rows, the first).
    Same columns as docs."""
    held, name = by_place(docs)
    rows = stored(fingerprints(held, name[text_col]).withColumn("_row", F.monotonically_increasing_id()), "simhash-docs")
    found = components(rows, id_col=name[id_col], **options).select(F.col("_fp").alias("_found"), "component")
    slim = rows.select("_row", F.col(name[id_col]).alias("_id"), "_fp").join(found, F.col("_fp") == F.col("_found"))
    order = F.struct(F.col("_id").isNull(), "_id", "_row")
    stay = stored(slim.groupBy("component").agg(F.min(order)["_row"].alias("_row")).select("_row"), "stay")
    gone = rows.select("_row").join(stay, "_row", "left_anti")
    gone = stored(gone, "gone")
    if gone.count() <= broadcast_rows:
        gone = F.broadcast(gone)
    return rows.join(gone, "_row", "left_anti").select(*held.columns).toDF(*docs.columns)
