"""Nearest neighbours by largest inner product through a hierarchical k-means tree.

Largest inner product becomes least distance by one more component: with M the largest norm, a vector x
gets sqrt(M^2 - |x|^2) and a query 0. On a bounded sample (`sample_rows` vectors, those of smallest hash) the driver
splits nodes by k-means until a leaf would hold about `leaf_rows` of all vectors. Every vector of the table then
goes down the tree to a leaf, and the index is stored: blocks of vectors, ordered by leaf and id, cut by range so that a
leaf of any size lies in as many blocks as it needs.

A query visits leaves best bin first: a priority queue holds the nodes seen so far, the nearest one is taken out, and
either its children go in or, at a leaf, the leaf is visited. How many leaves are visited is calibrated: for `calibrate`
queries (those of smallest hash) the true neighbours among all rows are found by brute force; the number of
visits is widened from one leaf until the wanted share of them lies in visited leaves. Visits and index blocks are
joined by leaf and scored block by block; a task keeps a query's k best only, and these are
merged in order of the query, so neither a leaf nor a query is gathered whole.

Block scores come from matrix products, whose last digits depend on the block. What can be among a query's k best is
scored again as a plain sum of products, the same wherever a vector lies, so equal vectors have equal scores
and ties end with the smaller id.

Defined results: vectors that are null, zero, hold null or non-finite components or have another length than most
(ties: the shorter) take no part, nor do rows with a null id. Rows with a query's own id are no candidates of it. An id carried by several
rows is searched once, with the smallest of its vectors; as a candidate each row counts, so it may be listed more than once. An empty
table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored

FOUND = "query_id long, ids array<long>, scores array<double>"


@dataclass
class Tree:
    """Nodes by number, the root first. A node's children follow each other; a leaf has none, and a number of its own."""

    centers: np.ndarray
    first_child: np.ndarray
    children: np.ndarray
    leaf: np.ndarray
    largest: float

    @property
    def n_leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def descend(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of x (augmented)."""
        at = np.zeros(len(x), dtype=np.int64)
        while len(open_ := np.flatnonzero(self.children[at] > 0)):
            for node in np.unique(at[open_]):
                rows = open_[at[open_] == node]
                first, n = self.first_child[node], self.children[node]
                at[rows] = first + nearest(x[rows], self.centers[first : first + n])
        return self.leaf[at]

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """The first `most` leaves, best bin first; `query` is augmented."""
        gap = np.square(self.centers - query).sum(axis=1)
        queue, out = [(float(gap[0]), 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            n, first = int(self.children[node]), int(self.first_child[node])
            if not n:
                out.append(int(self.leaf[node]))
            for child in range(first, first + n):
                heapq.heappush(queue, (float(gap[child]), child))
        return out


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin(np.square(centers).sum(axis=1)[None, :] - 2 * (x @ centers.T), axis=1)


def augmented(x: np.ndarray, largest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(largest**2 - np.square(x).sum(axis=1), 0))
    return np.column_stack([x, rest])


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centers of up to k groups, started far apart, each with a row."""
    centers = [x[rng.integers(len(x))]]
    gap = np.square(x - centers[0]).sum(axis=1)
    while len(centers) < k and gap.sum() > 0:
        centers.append(x[rng.choice(len(x), p=gap / gap.sum())])
        gap = np.minimum(gap, np.square(x - centers[-1]).sum(axis=1))
    now = np.array(centers)
    for _ in range(rounds):
        own = nearest(x, now)
        now = np.array([x[own == i].mean(axis=0) for i in range(len(now)) if (own == i).any()])
    return now


def grow(sample: np.ndarray, largest: float, most: float, *, branch: int = 8, rounds: int = 8, seed: int = 7) -> Tree:
    """A tree over the sample (augmented); a node is split while it holds more than `most` sampled rows. Equal
    vectors can't be split and stay one leaf."""
    rng = np.random.default_rng(seed)
    centers, first, children, leaf = [sample.mean(axis=0)], [0], [0], [-1]
    todo, leaves = [(0, np.arange(len(sample)))], 0
    while todo:
        node, rows = todo.pop()
        own = sample[rows]
        split = k_means(own, min(branch, max(2, int(len(rows) // most))), rounds, rng) if len(rows) > most else centers[:1]
        parts = nearest(own, np.asarray(split)) if len(split) > 1 else np.zeros(len(rows), dtype=np.int64)
        if len(np.unique(parts)) < 2:
            leaf[node], leaves = leaves, leaves + 1
            continue
        first[node], children[node] = len(centers), len(split)
        for i, center in enumerate(split):
            todo.append((len(centers), rows[parts == i]))
            centers.append(center)
            first.append(0), children.append(0), leaf.append(-1)
    return Tree(np.array(centers), np.array(first), np.array(children), np.array(leaf), largest)


def plain_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products over the last axis, summed in one order whatever the shapes."""
    return np.multiply(queries, vectors).sum(axis=-1)


def best_in_block(qids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, spare: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query id, id and plain score of what can be among each query's k best in a block."""
    about = queries @ vectors.T
    about[qids[:, None] == ids[None, :]] = -np.inf
    width = min(len(ids), k + spare)
    if width == len(ids):
        at = np.tile(np.arange(width), (len(qids), 1))
    else:
        at = np.argpartition(-about, width - 1, axis=1)[:, :width]
    near = np.take_along_axis(about, at, axis=1)
    scores = plain_scores(queries[:, None, :], vectors[at])
    out = [(np.repeat(qids, width), ids[at].ravel(), scores.ravel(), near.ravel() > -np.inf)]
    if width < len(ids):
        # where the k-th and the last of the chosen differ by rounding only, all that may tie with it is scored
        ranked = -np.sort(-near, axis=1)
        room = 1e-12 * np.linalg.norm(queries, axis=1) * np.linalg.norm(vectors, axis=1).max()
        for row in np.flatnonzero(ranked[:, k - 1] - ranked[:, -1] <= room):
            more = np.flatnonzero(about[row] >= ranked[row, k - 1] - room[row])
            more = np.setdiff1d(more, at[row])
            out.append((np.full(len(more), qids[row]), ids[more], plain_scores(queries[row], vectors[more]), about[row, more] > -np.inf))
    qid, vid, score, real = (np.concatenate(x) for x in zip(*out, strict=True))
    return qid[real], vid[real], score[real]


def top_places(qid: np.ndarray, vid: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Where the k best rows of each query are, by query, score downwards and id."""
    order = np.lexsort((vid, -score, qid))
    start = _starts(qid[order])
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[place < k]


def top_rows(qid: np.ndarray, vid: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    at = top_places(qid, vid, score, k)
    return qid[at], vid[at], score[at]


def _starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)


def _lists(qid: np.ndarray, vid: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    """A row for each query, from rows ordered by query."""
    start = _starts(qid)
    offsets = pa.array(np.append(start, len(qid)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(qid[start]), pa.ListArray.from_arrays(offsets, pa.array(vid)), pa.ListArray.from_arrays(offsets, pa.array(score))], names=["query_id", "ids", "scores"])


class _Best:
    """The k best of each query that a task has seen. Above `most` rows what is held goes out."""

    def __init__(self, k: int, most: int = 400_000):
        self.k, self.most, self.parts, self.n, self.base = k, most, [], 0, 0

    def add(self, *part: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(part)
        self.n += len(part[0])
        if self.n > self.most + self.base:
            held = top_rows(*(np.concatenate(x) for x in zip(*self.parts, strict=True)), self.k)
            self.parts, self.n, self.base = [held], len(held[0]), len(held[0])
            if self.n > self.most:
                yield from self.end()

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            held = top_rows(*(np.concatenate(x) for x in zip(*self.parts, strict=True)), self.k)
            cuts = np.searchsorted(held[0], np.unique(held[0])[::20_000])
            for a, b in zip(cuts, np.append(cuts[1:], len(held[0])), strict=True):
                yield _lists(*(x[a:b] for x in held))
        self.parts, self.n, self.base = [], 0, 0


def _matrix_of(values: pa.Array, dims: int) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype("float64").reshape(-1, dims)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int | None = None) -> tuple[DataFrame, int]:
    """vec_id and v of the vectors that take part, and their length (dims, or else the commonest)."""
    v = F.col(vector_col)
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.forall("v", number) & F.exists("v", lambda x: x != 0))
    if dims is not None:
        return rows.where(F.size("v") == dims), dims
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dims = size["d"] if size else 0
    return rows.where(F.size("v") == dims), dims


def _packed(rows: DataFrame, most: int) -> DataFrame:
    """Blocks (leaf, ids, vs) of up to `most` rows (leaf, salt, id, v) of one leaf. Rows are dealt by leaf and salt and read
    in that order, with one block open at a time."""

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        leaf, ids, vs = (pa.concat_arrays([p.column(name) for p in parts]) for name in ("leaf", "id", "v"))
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        return pa.RecordBatch.from_arrays([leaf.slice(0, 1), one(ids), one(vs.flatten())], names=["leaf", "ids", "vs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, leaf = 0, None
        for batch in batches:
            own = batch.column("leaf").to_numpy(zero_copy_only=False)
            cuts = _starts(own)
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(own)], strict=len(cuts) > 0):
                if held and leaf != own[a]:
                    yield block(held)
                    held, n = [], 0
                leaf = own[a]
                while a < b:
                    take = min(b - a, most - n)
                    held.append(batch.slice(a, take))
                    a, n = a + take, n + take
                    if n == most:
                        yield block(held)
                        held, n = [], 0
        if held:
            yield block(held)

    dealt = rows.repartition("leaf", "salt").sortWithinPartitions("leaf", "salt")
    kind = rows.schema["v"].dataType.elementType.simpleString()
    return small_batches(dealt).mapInArrow(run, f"leaf int, ids array<long>, vs array<{kind}>")


def _salted(leaf: np.ndarray, salts: np.ndarray, ids: pa.Array, v: pa.Array) -> pa.RecordBatch:
    """Rows with a salt below their leaf's number of salts, from the id."""
    mixed = ids.to_numpy(zero_copy_only=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
    salt = (mixed % salts[leaf].astype(np.uint64)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), pa.array(salt), ids, v], names=["leaf", "salt", "id", "v"])


def _merged(parts: DataFrame, k: int) -> DataFrame:
    """The k best of each query from rows (query_id, ids, scores): read in order of the query, with one query open at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            counts = batch.column("ids").value_lengths().to_numpy(zero_copy_only=False)
            now = (np.repeat(batch.column("query_id").to_numpy(zero_copy_only=False), counts), batch.column("ids").flatten().to_numpy(zero_copy_only=False), batch.column("scores").flatten().to_numpy(zero_copy_only=False))
            if rest is not None:
                now = tuple(np.concatenate(x) for x in zip(rest, now, strict=True))
            if not len(now[0]):
                continue
            held = top_rows(*now, k)
            last = int(np.searchsorted(held[0], held[0][-1]))
            if last:
                yield _lists(*(x[:last] for x in held))
            rest = tuple(x[last:] for x in held)
        if rest is not None and len(rest[0]):
            yield _lists(*rest)

    dealt = parts.repartition("query_id").sortWithinPartitions("query_id")
    return small_batches(dealt).mapInArrow(run, FOUND)


def _smallest(rows: DataFrame, most: int) -> tuple[np.ndarray, DataFrame]:
    picked = rows.orderBy(F.xxhash64("vec_id", F.lit(13)), "vec_id", "v").limit(most).select("vec_id", "v").toArrow()  # `most` rows
    return picked.column("vec_id").to_numpy(), picked.column("v").combine_chunks()


@dataclass
class Index:
    blocks: DataFrame
    tree: Tree
    dims: int


def build(vectors: DataFrame, *, sample_rows: int = 50_000, leaf_rows: int = 256, block_rows: int = 1024, branch: int = 8, **columns) -> Index | None:
    """The tree, fitted on a sample, and all vectors in blocks by leaf; None without vectors."""
    rows, dims = usable(vectors, **columns)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n, largest = rows.agg(F.count("*"), F.max(norm)).first()
    if not n:
        return None
    _, picked = _smallest(rows, sample_rows)
    sample = augmented(_matrix_of(picked.flatten(), dims), largest)
    tree = grow(sample, largest, max(16.0, leaf_rows * len(sample) / n), branch=branch)
    share = np.bincount(tree.descend(sample), minlength=tree.n_leaves) / len(sample)
    salts = np.ceil(np.maximum(share * n / (4 * block_rows), 1)).astype(np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = tree.descend(augmented(_matrix_of(batch.column("v").flatten(), dims), tree.largest))
            yield _salted(leaves, salts, batch.column("vec_id"), batch.column("v"))

    kind = rows.schema["v"].dataType.elementType.simpleString()
    placed = small_batches(rows).mapInArrow(place, f"leaf int, salt int, id long, v array<{kind}>")
    return Index(stored(_packed(placed, block_rows), "index"), tree, dims)


def _of(batch: pa.RecordBatch, row: int, ids: str, vectors: str, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors (as doubles) of one block."""
    return batch.column(ids)[row].values.to_numpy(zero_copy_only=False), _matrix_of(batch.column(vectors)[row].values, dims)


def true_neighbours(index: Index, qids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """query_id, id, leaf of the k nearest of a few queries among all rows, by brute force."""
    dims = index.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, dtype=t) for t in ("int64", "int64", "float64", "int32")]
        for batch in batches:
            for row in range(batch.num_rows):
                found = best_in_block(qids, queries, *_of(batch, row, "ids", "vs", dims), k)
                leaf = np.full(len(found[0]), batch.column("leaf")[row].as_py(), dtype=np.int32)
                held = [np.concatenate(x) for x in zip(held, [*found, leaf], strict=True)]
                at = top_places(*held[:3], k)
                held = [x[at] for x in held]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["query_id", "id", "score", "leaf"])

    found = small_batches(index.blocks).mapInArrow(run, "query_id long, id long, score double, leaf int")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("_place", place).where(F.col("_place") <= k).select("query_id", "id", "leaf")


def calibrated_visits(index: Index, queries: DataFrame, k: int, recall: float, most: int) -> tuple[int, float]:
    """Leaves to visit so that `recall` of the true neighbours of `most` queries lies in them, and the share that then does."""
    qids, picked = _smallest(queries, most)
    if not len(qids):
        return 1, 1.0
    x = _matrix_of(picked.flatten(), index.dims)
    truth = true_neighbours(index, qids, x, k).collect()  # k rows for each of `most` queries
    place = {}
    for qid, query in zip(qids.tolist(), x, strict=True):
        for i, leaf in enumerate(index.tree.visits(np.append(query, 0.0), index.tree.n_leaves)):
            place[qid, leaf] = i
    needed = np.sort([place[r["query_id"], r["leaf"]] for r in truth])
    visits, share = 0, 0.0
    while share < recall and visits < index.tree.n_leaves and len(needed):
        visits += 1
        share = float(np.searchsorted(needed, visits) / len(needed))
    return max(visits, 1), share


def search(index: Index, queries: DataFrame, visits: int, *, k: int = 20, block_rows: int = 1024) -> DataFrame:
    """query_id, ids, scores: of each query (vec_id, v) its k best rows in the leaves that it visits."""
    tree, dims = index.tree, index.dims
    kind = queries.schema["v"].dataType.elementType.simpleString()

    salts = np.full(tree.n_leaves, -(-queries.count() * visits // (4 * block_rows * tree.n_leaves)) or 1)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix_of(batch.column("v").flatten(), dims)
            for a in range(0, len(x), 1000):
                leaves = [tree.visits(np.append(q, 0.0), visits) for q in x[a : a + 1000]]
                rows = pa.array(np.repeat(np.arange(a, a + len(leaves)), [len(v) for v in leaves]))
                yield _salted(np.concatenate(leaves).astype(np.int64), salts, batch.column("vec_id").take(rows), batch.column("v").take(rows))

    wanted = small_batches(queries).mapInArrow(visit, f"leaf int, salt int, id long, v array<{kind}>")
    blocks = stored(_packed(wanted, block_rows), "visits").select(F.col("leaf").alias("_leaf"), F.col("ids").alias("qids"), F.col("vs").alias("qs"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for batch in batches:
            for row in range(batch.num_rows):
                found = best_in_block(*_of(batch, row, "qids", "qs", dims), *_of(batch, row, "ids", "vs", dims), k)
                yield from best.add(*top_rows(*found, k))
        yield from best.end()

    met = index.blocks.join(blocks, F.col("leaf") == F.col("_leaf")).select("ids", "vs", "qids", "qs")
    return _merged(stored(small_batches(met).mapInArrow(score, FOUND), "found"), k)


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, *, k: int = 20, recall: float = 0.95, calibrate: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """query_id, rank, vec_id, score: of each query row its k nearest rows found, nearest first."""
    spark, columns = vectors.sparkSession, {"id_col": id_col, "vector_col": vector_col}
    index = build(vectors, **columns, **options)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    wanted = stored(usable(queries, **columns, dims=index.dims)[0].groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    visits, _ = calibrated_visits(index, wanted, k, recall, calibrate)
    found = search(index, wanted, visits, k=k).select("query_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("i", "x"))
    return found.select("query_id", (F.col("i") + 1).alias("rank"), F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
