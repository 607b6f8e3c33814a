"""Language-model scores from a weighted backoff automaton of smoothed n-grams.

States are the n-grams seen in training, as contexts, and the root. A word leaves its state by an arc if
the longer n-gram was seen; otherwise the state's failure arc, of weight log10(k / (c(h) + k)), leads to
the next shorter context. An arc carries log10((c(hw) + k p(w|h')) / (c(h) + k)), p(w|h') being the same
word's probability from the shorter context, so the probabilities of each state sum to one. The root is a
unigram state with absolute discounting, whose freed mass is the probability of the one unknown type.

The model is as large as the corpus and is never in one place:

1. Documents are read once into blocks of about `block_bytes`, stored as token streams. Blocks are cut
   from the input as it lies, so repeated rows spread like any others; a longer text is a block of its own.
2. A block asks for the counts of its own distinct n-grams (`key_bits` bits of a hash, delta coded), dealt
   by hash range to parts, of which there are as many as blocks. A part adds up what blocks have seen and
   answers each. Only pairs with n-grams in common are exchanged, and none sends to more than `most_parts`
   parts: beyond that number the requests of a group of blocks are first merged, level by level, and the
   answers go back the same way. Rows, bytes and the size of each task's group thus stay in proportion.
3. With the answers a block builds the part of the automaton that its texts can reach (states, arcs,
   failure arcs, weights) and traverses its texts left to right, carrying the state. Long texts are cut
   into runs that begin order - 1 words earlier, which is all that a state remembers, so that all runs of a
   block step together.

Two n-grams share a number with a chance of (distinct n-grams) / 2**key_bits: 2e-5 for 5e9 of them.

Defined results: null and empty texts consist of the end token. Without training documents N and V
are 0, all tokens are unknown and all scores 0. Repeated rows count and score as rows of their own;
other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import brief_shuffles, lower_words, small_batches, stored, text_chunks

BEGIN, END = b" begin", b" end"  # no word holds a space
MOST_TASKS = 50_000
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
BLOCK = "block long, doc_ids array<bigint>, train array<boolean>, lengths array<int>, train_tokens long, words binary, stream binary"


class Smoothing(NamedTuple):
    discount: float = 0.7
    strength: float = 100.0


def _mix(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from its context's hash and its last word's."""
    x = (context * np.uint64(0x9E3779B97F4A7C15)) ^ (word + np.uint64(0x632BE59BD9B4E019))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of uint64 as byte planes, compressed."""
    parts = [struct.pack("<I", len(arrays))]
    for a in arrays:
        parts += [struct.pack("<Q", len(a)), np.ascontiguousarray(a.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    (n,), at, out = struct.unpack_from("<I", raw), 4, []
    for _ in range(n):
        (m,) = struct.unpack_from("<Q", raw, at)
        planes = np.frombuffer(raw, dtype=np.uint8, count=8 * m, offset=at + 8).reshape(8, m)
        out.append(np.ascontiguousarray(planes.T).view(np.uint64).ravel())
        at += 8 + 8 * m
    return out


class Request(NamedTuple):
    """Distinct n-grams of each order, sorted, and how often training texts have them."""

    keys: list[np.ndarray]
    seen: list[np.ndarray]

    def packed(self) -> bytes:
        return pack([x for k, n in zip(self.keys, self.seen, strict=True) for x in (np.diff(k, prepend=np.uint64(0)), n)])

    @classmethod
    def unpacked(cls, data: bytes) -> Request:
        fields = unpack(data)
        return cls([np.cumsum(x, dtype=np.uint64) for x in fields[::2]], fields[1::2])

    def split(self, part: int, fan: int, level: int, key_bits: int) -> Iterator[tuple[int, Request]]:
        """The non-empty pieces for the `fan` parts of the next level below a part of this one."""
        whole = fan ** (level + 1)
        limits = np.array([((part * fan + i) << key_bits) // whole for i in range(1, fan)], dtype=np.uint64)
        bounds = [np.concatenate([[0], np.searchsorted(k, limits), [len(k)]]).astype(np.int64) for k in self.keys]
        for i in range(fan):
            if any(b[i] < b[i + 1] for b in bounds):
                cut = lambda arrays, i=i: [x[b[i] : b[i + 1]] for x, b in zip(arrays, bounds, strict=True)]
                yield part * fan + i, Request(cut(self.keys), cut(self.seen))


def merged(requests: list[Request]) -> tuple[Request, list[list[np.ndarray]]]:
    """The sum of some requests, and where each one's n-grams are in it, by order."""
    keys, seen, places = [], [], [[] for _ in requests]
    for k in range(len(requests[0].keys)):
        distinct, index = np.unique(np.concatenate([r.keys[k] for r in requests]), return_inverse=True)
        total = np.bincount(index, weights=np.concatenate([r.seen[k] for r in requests]).astype(np.float64), minlength=len(distinct))
        keys.append(distinct)
        seen.append(np.rint(total).astype(np.uint64))
        for place, part in zip(places, np.split(index, np.cumsum([len(r.keys[k]) for r in requests])[:-1]), strict=True):
            place.append(part)
    return Request(keys, seen), places


class Block:
    """Token stream of a block of texts (begin, words, end of each) and its distinct n-grams by order."""

    def __init__(self, words: np.ndarray, stream: np.ndarray, lengths: np.ndarray, train: np.ndarray, order: int, key_bits: int):
        self.lengths = lengths.astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)[: len(lengths)]
        place = np.arange(len(stream)) - np.repeat(self.begin, self.lengths)
        used = np.repeat(train, self.lengths)
        shift = np.uint64(64 - key_bits)
        self.keys = [words]
        self.index = [stream.astype(np.int64)]  # of the n-gram that ends at each position; -1 before there is one
        gram = word = words[stream] if len(stream) else words[:0]
        for k in range(2, order + 1):
            whole = place >= k - 1
            longer = np.zeros_like(word)
            longer[1:] = _mix(gram[:-1], word[1:])
            gram = longer
            keys, index = np.unique(gram[whole] >> shift, return_inverse=True)
            at = np.full(len(stream), -1, dtype=np.int64)
            at[whole] = index
            self.keys.append(keys)
            self.index.append(at)
        self.seen = [np.bincount(at[used & (at >= 0)], minlength=len(keys)).astype(np.uint64) for at, keys in zip(self.index, self.keys, strict=True)]


def read_block(texts: list[str | None], key_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, stream, lengths): hashes of the distinct words, sorted; each token's place in them."""
    numbers: dict[bytes, int] = {}
    streams = []
    for text in texts:
        some = [BEGIN, *lower_words(text), END]
        streams.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in some), dtype=np.int64, count=len(some)))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) >> (64 - key_bits) for w in numbers), dtype=np.uint64, count=len(numbers))
    words, place = np.unique(hashes, return_inverse=True)
    stream = place[np.concatenate(streams)] if streams else np.empty(0, dtype=np.int64)
    return words, stream, np.array([len(s) for s in streams], dtype=np.int64)


class Automaton:
    """The states that a block's texts can reach. State 0 is the root; the k-gram g is state first[k] + g.
    Arcs are numbered like the n-grams they complete: the arc of order k and number g leaves the state of
    g's first k - 1 words by its last word, and exists if g was seen."""

    def __init__(self, block: Block, totals: list[np.ndarray], n: int, v: int, smoothing: Smoothing):
        d, strength = smoothing
        order = len(totals)
        self.first = [0, 1]
        for t in totals[:-1]:
            self.first.append(self.first[-1] + len(t))
        states = self.first[order] if order > 1 else 1
        self.failure = np.zeros(states, dtype=np.int64)
        self.failure_weight = np.zeros(states)
        self.seen = [t > 0 for t in totals]
        count = totals[0].astype(np.float64)
        p = np.where(count > 0, count - d, d * v) / n if n else np.ones(len(count))
        self.arc_weight = [np.log10(np.maximum(p, 1e-300))]
        self.arc_target = [np.where(self.seen[0], 1 + np.arange(len(count)), 0) if order > 1 else np.zeros(len(count), dtype=np.int64)]
        for k in range(2, order + 1):
            at = np.flatnonzero(block.index[k - 1] >= 0)
            gram = block.index[k - 1][at]
            context, shorter = np.empty((2, len(totals[k - 1])), dtype=np.int64)
            context[gram], shorter[gram] = block.index[k - 2][at - 1], block.index[k - 2][at]
            c, of_context = totals[k - 1].astype(np.float64), totals[k - 2][context].astype(np.float64)
            p = (c + strength * p[shorter]) / (of_context + strength)
            self.arc_weight.append(np.log10(np.maximum(p, 1e-300)))
            if k < order:
                self.arc_target.append(self.first[k] + np.arange(len(c)))
                self.failure[self.first[k] : self.first[k + 1]] = self.first[k - 1] + shorter
            else:
                self.arc_target.append(self.first[k - 1] + shorter)
        for k in range(1, order):
            c = totals[k - 1].astype(np.float64)
            self.failure_weight[self.first[k] : self.first[k] + len(c)] = np.log10(strength / (c + strength))

    def traverse(self, block: Block, run: int = 512) -> np.ndarray:
        """Log10 probability of each text: the weights along its path."""
        order, out = len(self.arc_weight), np.zeros(len(block.lengths))
        pieces = np.maximum(1, -(-(block.lengths - 1) // run))
        text = np.repeat(np.arange(len(pieces)), pieces)
        number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = block.begin[text]
        start = begin + 1 + number * run  # the first token whose weight counts
        end = np.minimum(start + run, begin + block.lengths[text])
        at = np.maximum(start - (order - 1), begin + 1) if order > 1 else start
        # at the begin of a text the state is that of the begin mark, else the root: order - 1 words say all
        mark = block.index[0][begin] if len(begin) else begin
        state = np.where((at == begin + 1) & (order > 1) & self.seen[0][mark], 1 + mark, 0)
        total = np.zeros(len(text))
        live = np.arange(len(text))
        while len(live):
            here, now = at[live], state[live]
            weight, left = np.zeros(len(live)), np.ones(len(live), dtype=bool)
            for k in range(order, 0, -1):  # arcs of the longest states first; who finds none takes the failure arc
                mine = np.flatnonzero(left & (now >= self.first[k - 1])) if k > 1 else np.flatnonzero(left)
                arc = block.index[k - 1][here[mine]]
                found = self.seen[k - 1][arc] & (arc >= 0) if k > 1 else np.ones(len(mine), dtype=bool)
                go, fail = mine[found], mine[~found]
                weight[go] += self.arc_weight[k - 1][arc[found]]
                weight[fail] += self.failure_weight[now[fail]]
                now[fail] = self.failure[now[fail]]
                now[go] = self.arc_target[k - 1][arc[found]]
                left[go] = False
            total[live] += np.where(here >= start[live], weight, 0.0)
            state[live] = now
            at[live] += 1
            live = live[at[live] < end[live]]
        np.add.at(out, text, total)
        return out


def score_block(block: Block, totals: list[np.ndarray], n: int, v: int, smoothing: Smoothing) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known tokens, base score, score) of each text."""
    token = np.ones(block.lengths.sum(), dtype=bool)
    token[block.begin] = False  # begin is a state, not a token
    count = totals[0][block.index[0]].astype(np.float64)
    base = np.log10((count + 0.1) / (n + 0.1 * (v + 1)))
    total = lambda x: np.add.reduceat(np.where(token, x, 0.0), block.begin) if len(block.begin) else np.empty(0)
    return total((count > 0).astype(np.float64)).astype(np.int64), total(base), Automaton(block, totals, n, v, smoothing).traverse(block)


def blocks_of(docs: DataFrame, block_bytes: int, key_bits: int) -> DataFrame:
    """BLOCK rows of docs (doc_id, text, train)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, size = 0, [], 0
        where = TaskContext.get().partitionId() << 32

        def done() -> pa.RecordBatch:
            ids, texts, train = (list(x) for x in zip(*rows, strict=True))
            words, stream, lengths = read_block(texts, key_bits)
            return pa.RecordBatch.from_pydict(
                {
                    "block": [where + number], "doc_ids": [ids], "train": [train], "lengths": pa.array([lengths.astype(np.int32)]),
                    "train_tokens": [int((lengths - 1)[np.array(train, dtype=bool)].sum())],
                    "words": [pack([np.diff(words, prepend=np.uint64(0))])], "stream": [zstandard.ZstdCompressor(level=3).compress(stream.astype(np.uint32).tobytes())],
                },
                schema=pa.schema(
                    [
                        ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())),
                        ("train_tokens", pa.int64()), ("words", pa.binary()), ("stream", pa.binary()),
                    ]
                ),
            )

        for batch in batches:
            for part, texts in text_chunks(batch, "text", block_bytes):
                more = sum(map(len, (t or "" for t in texts)))
                if rows and size + more > block_bytes:
                    yield done()
                    number, rows, size = number + 1, [], 0
                rows += zip(part.column("doc_id").to_pylist(), texts, part.column("train").to_pylist(), strict=True)
                size += more
        if rows:
            yield done()

    return small_batches(docs).select("doc_id", "text", "train").mapInArrow(cut, BLOCK)


def lm_scores(
    docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", order: int = 3, smoothing: Smoothing | None = None,
    block_bytes: int = 6_000_000, key_bits: int = 48, most_parts: int = 4096,
) -> DataFrame:
    """RESULT for each document; `train` tells which documents the model learns from."""
    smoothing = smoothing or Smoothing()
    mark = xxhash.xxh64_intdigest(BEGIN) >> (64 - key_bits)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    blocks = stored(blocks_of(slim, block_bytes, key_bits), "lm-blocks")
    n_blocks, n = blocks.agg(F.count("*"), F.coalesce(F.sum("train_tokens"), F.lit(0))).first()
    depth, fan = 1, max(1, n_blocks)
    while fan > most_parts:
        depth += 1
        fan = int(np.ceil(n_blocks ** (1 / depth)))

    def opened(row: dict) -> Block:
        words = np.cumsum(unpack(row["words"])[0], dtype=np.uint64)
        stream = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["stream"]), dtype=np.uint32)
        return Block(words, stream, np.array(row["lengths"], dtype=np.int64), np.array(row["train"], dtype=bool), order, key_bits)

    def asking(part: int, level: int, unit: int, request: Request) -> pa.RecordBatch:
        out = [(p, unit, r.packed()) for p, r in request.split(part, fan, level, key_bits)]
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())],
            names=["part", "unit", "asked"],
        )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = opened(row)
                yield asking(0, 0, row["block"], Request(block.keys, block.seen))

    def merging(level: int):
        def merge(key: tuple, table: pa.Table) -> pa.Table:
            whole, _ = merged([Request.unpacked(x) for x in table.column("asked").to_pylist()])
            return pa.Table.from_batches([asking(key[0].as_py(), level, key[1].as_py(), whole)])

        return merge

    def replying(units: list[int], parts: list[int], totals: list[list[np.ndarray]], v: int = 0) -> pa.Table:
        return pa.table(
            {
                "part": pa.array(parts, pa.int64()), "unit": pa.array(units, pa.int64()), "reply": pa.array([pack(x) for x in totals], pa.binary()),
                "v": pa.array([v] + [0] * (len(units) - 1), pa.int64()),
            }
        )

    def answer(table: pa.Table) -> pa.Table:
        whole, places = merged([Request.unpacked(x) for x in table.column("asked").to_pylist()])
        v = int(((whole.seen[0] > 0) & (whole.keys[0] != mark)).sum())
        return replying(table.column("unit").to_pylist(), table.column("part").to_pylist(), [[t[p] for t, p in zip(whole.seen, at, strict=True)] for at in places], v)

    def gathered(table: pa.Table) -> list[np.ndarray]:
        replies = [unpack(x) for x in table.sort_by("part").column("reply").to_pylist()]
        return [np.concatenate([r[k] for r in replies]) for k in range(order)]

    def give_back(below: pa.Table, replies: pa.Table) -> pa.Table:
        totals = gathered(replies)
        _, places = merged([Request.unpacked(x) for x in below.column("asked").to_pylist()])
        return replying(below.column("unit").to_pylist(), below.column("part").to_pylist(), [[t[p] for t, p in zip(totals, at, strict=True)] for at in places])

    request_type, reply_type = "part long, unit long, asked binary", "part long, unit long, reply binary, v long"
    levels = [blocks.mapInArrow(ask, request_type)]
    units = n_blocks
    for level in range(1, depth):
        units = max(1, -(-units // fan))
        held = stored(levels[-1], "lm-asked").withColumn("group", F.pmod(F.xxhash64("unit"), F.lit(units)))
        levels[-1] = held
        levels.append(held.groupBy("part", "group").applyInArrow(merging(level), request_type))
    # parts are numbered, so that tasks get equal numbers of them, which a hash wouldn't give
    tasks = min(max(1, n_blocks), MOST_TASKS)
    last = levels[-1].withColumn("task", F.pmod("part", F.lit(tasks)).cast("int")).repartitionById(tasks, F.col("task"))
    with brief_shuffles(docs.sparkSession):  # the requests are the largest part of what is exchanged
        replies = stored(last.groupBy("task", "part").applyInArrow(answer, reply_type), "lm-replies")
    v = replies.agg(F.coalesce(F.sum("v"), F.lit(0))).first()[0]
    for held in reversed(levels[:-1]):
        above = replies.select(F.expr(f"part div {fan}").alias("_part"), F.col("unit").alias("_group"), "part", "reply")
        replies = held.groupBy("part", "group").cogroup(above.groupBy("_part", "_group")).applyInArrow(give_back, reply_type)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        block = opened(row)
        known, base, total = score_block(block, gathered(right), n, v, smoothing)
        return pa.table(
            {
                "doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array([not x for x in row["train"]]), "n_tokens": pa.array(block.lengths - 1),
                "n_known": pa.array(known), "train_tokens": pa.array([n] * len(known), pa.int64()), "base_score": pa.array(base), "score": pa.array(total),
            }
        )

    return blocks.groupBy("block").cogroup(replies.withColumnRenamed("unit", "block").groupBy("block")).applyInArrow(score, RESULT)
