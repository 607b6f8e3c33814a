"""Benchmark decontamination with suffix arrays over shards of the training documents.

Documents are taken in shards of about 4 MB of text, each in one task. A shard's suffix array holds the positions at which a benchmark
window can begin: those whose first words also begin some window. Every other suffix sorts away
from all queries, so leaving it out changes no search. The suffixes are sorted by their next
`window` words and every benchmark window is binary-searched in them, which gives all its places;
matches of neighbouring windows on one diagonal join into the longest verbatim matches. A document
lies wholly in its shard, so nothing is shuffled and hot passages are spread over all tasks.

A benchmark of more than `block_bytes` of text is taken in blocks, dealt by a hash of the item (a longer
item is a block of its own). Each block is a pass over the documents that ends with a stored table, so the
driver and each task hold the windows of one block at a time, as arrays of 40 bytes a word; time grows with
the number of blocks. An ordinary benchmark is a single block and nothing is stored.

Defined results: null or wordless texts have no words, no hits and aren't contaminated; wordless
items never occur; an item with a null id is searched for but not listed. Repeated documents are
judged alike, repeated items once. Other columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, by_place, small_batches, stored, text_chunks

SPAN = "struct<item_id:string,item_word:bigint,doc_word:bigint,n_words:bigint>"
_BASE = 254  # digits 1..254: no byte is 0 (numpy strips it) or 255 (above every digit)
_PREFIX = 3
#: Text of a shard.
SHARD_BYTES = 4_000_000


def _keys(ids: np.ndarray) -> np.ndarray:
    """Rows of word ids as byte strings that sort like the rows."""
    digits = np.stack([ids // (_BASE * _BASE) % _BASE, ids // _BASE % _BASE, ids % _BASE], axis=-1) + 1
    return np.ascontiguousarray(digits.astype(np.uint8).reshape(len(ids), -1)).view(f"S{3 * ids.shape[1]}").ravel()


class Windows:
    """The benchmark's windows: vocabulary, window keys, and the word prefixes they begin with."""

    def __init__(self, items: list[tuple[Any, str | None]], window: int):
        self.window, self.vocabulary = window, {}
        self.names, item, at, length, low = [], [], [], [], []
        prefixes: dict[int, list[np.ndarray]] = {k: [] for k in range(1, _PREFIX + 1)}
        for name, text in sorted(set(items), key=str):
            words = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in alnum_words(text)], dtype=np.int64)
            if not len(words):
                continue
            own = np.lib.stride_tricks.sliding_window_view(words, min(window, len(words)))
            item.append(np.full(len(own), len(self.names)))
            self.names.append(None if name is None else str(name))
            at.append(np.arange(len(own)))
            length.append(np.full(len(own), own.shape[1]))
            low.append(_keys(own).astype(f"S{3 * window + 1}"))
            k = min(_PREFIX, own.shape[1])
            prefixes[k].append(self._codes(*own[:, :k].T))
        self.item, self.at, self.length = (np.concatenate([np.empty(0, dtype=np.int64), *x]) for x in (item, at, length))
        self.low = np.concatenate([np.empty(0, dtype=f"S{3 * window + 1}"), *low])
        self.high = np.char.add(self.low, b"\xff").astype(f"S{3 * window + 1}")
        self.prefixes = {k: np.unique(np.concatenate(v)) for k, v in prefixes.items() if v}

    @staticmethod
    def _codes(*columns: np.ndarray) -> np.ndarray:
        """One number for each word prefix; a clash would only add positions to the suffix array."""
        out = np.zeros(len(columns[0]), dtype=np.int64)
        for c in columns:
            out = (out << 21) ^ c
        return out

    def _starts(self, ids: np.ndarray) -> np.ndarray:
        """Positions whose next words begin some window."""
        found = [np.empty(0, dtype=np.int64)]
        for k, known in self.prefixes.items():
            if len(ids) < k:
                continue
            n = len(ids) - k + 1
            whole = np.ones(n, dtype=bool)
            for j in range(k):
                whole &= ids[j : n + j] > 0
            at = np.flatnonzero(whole)
            code = self._codes(*[ids[at + j].astype(np.int64) for j in range(k)])
            slot = np.minimum(np.searchsorted(known, code), len(known) - 1)
            found.append(at[known[slot] == code])
        return np.unique(np.concatenate(found))

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, window number) of every occurrence in a shard."""
        starts = self._starts(ids)
        if not len(starts) or not len(self.low):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        padded = np.concatenate([ids, np.zeros(self.window, dtype=ids.dtype)]).astype(np.int64)
        keys = _keys(padded[starts[:, None] + np.arange(self.window)]).astype(self.low.dtype)
        order = np.argsort(keys, kind="stable")
        suffixes = keys[order]
        low, high = np.searchsorted(suffixes, self.low), np.searchsorted(suffixes, self.high)
        n = high - low
        which = np.repeat(np.arange(len(n)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return starts[order[low[which] + inside]], which

    def match(self, texts: list[str | None]) -> Iterator[tuple[int, list[dict]]]:
        """For each text its number of words and its longest verbatim matches."""
        get = self.vocabulary.get
        parts, counts = [], []
        for text in texts:
            words = alnum_words(text)
            counts.append(len(words))
            parts.append(np.array([get(w, 0) for w in words] + [0], dtype=np.int32))
        ids = np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)
        begin = np.concatenate([[0], np.cumsum([c + 1 for c in counts])])
        place, which = self.search(ids)
        spans: dict[int, list[dict]] = {}
        if len(place):
            doc = np.searchsorted(begin, place, side="right") - 1
            item, at, length = self.item[which], self.at[which], self.length[which]
            order = np.lexsort((place, place - at, item, doc))
            doc, item, at, length, place = (x[order] for x in (doc, item, at, length, place))
            new = np.ones(len(doc), dtype=bool)
            new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1) | (at[1:] != at[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(doc)) - 1
            for i, j in zip(first.tolist(), last.tolist(), strict=True):
                spans.setdefault(int(doc[i]), []).append(
                    {"item_id": self.names[item[i]], "item_word": int(at[i]), "doc_word": int(place[i] - begin[doc[i]]), "n_words": int(place[j] + length[j] - place[i])}
                )
        for i, n in enumerate(counts):
            yield n, spans.get(i, [])


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[list[tuple], bool]]:
    """The benchmark's rows in blocks of about block_bytes of text, and whether there are more than one."""
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield [(r["id"], r["text"]) for r in part.distinct().collect()], n > 1


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", window: int = 13, block_bytes: int = 8_000_000, carry: tuple[str, ...] = (),
) -> DataFrame:
    """id, n_words and `matches`, an array of SPAN: the longest verbatim matches of `window` words or
    more (of the whole item, if that is shorter) with their places. Columns in `carry` pass through."""
    kept = list(dict.fromkeys([id_col, text_col, *carry]))
    out = docs.select(*kept, F.lit(0).cast("long").alias("_n_words"), F.array().cast(f"array<{SPAN}>").alias("_matches"))
    for block, many in _blocks(benchmark, item_id_col, item_text_col, block_bytes):
        out = _searched(out, text_col, Windows(block, window))
        if many:
            out = stored(out, "benchmark-pass")
    return out.select(*dict.fromkeys([id_col, *carry]), F.col("_n_words").alias("n_words"), F.col("_matches").alias("matches"))


def _searched(docs: DataFrame, text_col: str, windows: Windows) -> DataFrame:
    """docs with the windows' matches added to _matches, and with _n_words."""
    schema = docs.schema

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch, text_col, SHARD_BYTES):
                counts, spans = zip(*windows.match(texts), strict=True)
                before = part.column("_matches").to_pylist()
                columns = {name: part.column(name) for name in part.schema.names}
                columns["_n_words"] = pa.array(counts, pa.int64())
                columns["_matches"] = pa.array([a + b for a, b in zip(before, spans, strict=True)], part.schema.field("_matches").type)
                yield pa.RecordBatch.from_pydict(columns)

    return small_batches(docs).mapInArrow(search, schema)


def contamination(matched: DataFrame, *, percent: int = 5) -> DataFrame:
    """Adds n_hit (words inside a match), items (distinct ids, sorted) and contaminated: hit words are
    at least `percent` of all."""
    ends = F.transform("matches", lambda m: F.struct(m["doc_word"].alias("a"), (m["doc_word"] + m["n_words"]).alias("b")))
    union = F.aggregate(
        F.sort_array(ends), F.struct(F.lit(0).cast("long").alias("reach"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(
            F.greatest(s["reach"], x["b"]).alias("reach"), (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["reach"]))).alias("n")
        ),
        lambda s: s["n"],
    )
    items = F.sort_array(F.array_distinct(F.filter(F.transform("matches", lambda m: m["item_id"]), lambda x: x.isNotNull())))
    return matched.withColumns({"n_hit": union, "items": items}).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", percent: int = 5, **options: Any) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    held, name = by_place(docs)
    matched = benchmark_matches(held, benchmark, id_col=held.columns[0], text_col=name[text_col], carry=tuple(held.columns), **options)
    return contamination(matched, percent=percent).where(~F.col("contaminated")).select(*held.columns).toDF(*docs.columns)
