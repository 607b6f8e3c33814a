"""Glossary terms in texts, by one automaton for all terms.

The terms become an Aho-Corasick automaton, which reads a text once whatever the number of terms. It is
built on the driver and broadcast; `part_chars` bounds the characters of the terms in one automaton, and so its size.

A larger glossary is joined to the texts instead, so that no task holds it and each text is read once however many terms there are.
A place that cuts no word has all words of its term as whole words; so each term is joined by its longest word to the texts that
have this word, and a text is searched for the terms that it met. Many terms with the same longest word meet all texts with
that word. Terms without any word character, such as signs, have no such word: they make automata of part_chars
characters, one pass each. The choice among all places follows in the end, so the result doesn't depend on the way.

Terms are trimmed and lower-cased; a place counts if neither end cuts a word. Of the places that touch no locked span, the
leftmost are chosen, then the longest, none over another (see protection.term_spans(), the plain model).
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored
from .protection import PROTECTED, inside_word, protected_batch, same_length_lower, span_lists

_WORDS = re.compile(r"\w+")
PLACES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _automaton(terms: list[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for term in terms:
        found.add_word(term)
    found.make_automaton()
    return found


def automaton(terms: list[str]) -> bytes:
    """The pickled automaton of normal terms."""
    return pickle.dumps(_automaton(terms))


def _pairs(found: list[tuple[int, int]]) -> list[dict[str, int]]:
    return [{"start": a, "end": b} for a, b in found]


@lru_cache(maxsize=2)
def _loaded(data: bytes) -> ahocorasick.Automaton:
    return pickle.loads(data)


def places(text: str, found: ahocorasick.Automaton) -> list[tuple[int, int]]:
    """Places of all terms of the automaton that cut no word."""
    if not len(found):
        return []
    ends = ((end - n + 1, end + 1) for end, n in found.iter(same_length_lower(text)))
    return [(a, b) for a, b in ends if not inside_word(text, a, b)]


def _met_places(text: str, terms: list[str]) -> list[tuple[int, int]]:
    """places() of the terms that a text has met: few are searched for one by one, which takes less than an automaton."""
    if len(terms) > 32:
        return places(text, _automaton(terms))
    low, out = same_length_lower(text), []
    for term in terms:
        start = low.find(term)
        while start >= 0:
            if not inside_word(text, start, start + len(term)):
                out.append((start, start + len(term)))
            start = low.find(term, start + 1)
    return out


def _place_lists(found: list[list[tuple[int, int]]]) -> pa.Array:
    flat = [place for one in found for place in one]
    structs = pa.StructArray.from_arrays([pa.array([a for a, _ in flat], pa.int32()), pa.array([b for _, b in flat], pa.int32())], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, found))], pa.int32()), structs)


def chosen(found: list[tuple[int, int]], locked: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Leftmost, then longest places that touch neither each other nor the locked spans (in order, apart)."""
    starts, out, at = [a for a, _ in locked], [], 0
    for start, end in sorted(set(found), key=lambda s: (s[0], -s[1])):
        if start < at:
            continue
        i = bisect_left(starts, end)
        if i and locked[i - 1][1] > start:
            continue
        out.append((start, end))
        at = end
    return out


def normal_terms(terms: DataFrame) -> DataFrame:
    """Distinct normal forms of the column `term`; none empty."""
    return terms.select(F.lower(F.btrim("term", F.lit(" \t\n\r\x0b\x0c"))).alias("term")).where(F.length("term") > 0).distinct()


def longest_word(term: str) -> str | None:
    """The first longest run of word characters; None without any."""
    return max(_WORDS.findall(term), key=len, default=None)


def _split(known: DataFrame, part_chars: int) -> list[DataFrame]:
    """Terms in parts of about part_chars characters, by hash."""
    parts = -(-(known.agg(F.sum(F.length("term"))).first()[0] or 0) // part_chars)
    return [known.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == k) for k in range(parts)]


def _broadcast(spark: SparkSession, part: DataFrame) -> Broadcast:
    return spark.sparkContext.broadcast(automaton([r["term"] for r in part.collect()]))  # about part_chars characters


def _met(blocks: DataFrame, anchored: DataFrame, text_col: str) -> DataFrame:
    """block_id, terms: of anchored terms (term, word), those whose word a block has."""
    least = anchored.agg(F.min(F.length("word"))).first()[0] or 0  # no shorter word can be met

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list({w for w in _WORDS.findall(same_length_lower(t)) if len(w) >= least}) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["block_id", "words"])

    id_type = blocks.schema["block_id"].dataType.simpleString()
    there = blocks.select("block_id", text_col).mapInArrow(words, f"block_id {id_type}, words array<string>").select("block_id", F.explode("words").alias("word"))
    return there.join(anchored, "word").groupBy("block_id").agg(F.collect_set("term").alias("terms"))


def _with_places(blocks: DataFrame, known: DataFrame, text_col: str, part_chars: int) -> DataFrame:
    """with_places() of a glossary of several parts."""

    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("term"), pa.array([longest_word(t) for t in batch.column("term").to_pylist()], pa.string())], names=["term", "word"])

    terms = stored(known.mapInArrow(anchor, "term string, word string"), "terms")
    met = _met(blocks, terms.where(F.col("word").isNotNull()), text_col).withColumnRenamed("block_id", "_block")
    nothing = F.array().cast("array<struct<start:int,end:int>>")
    joined = blocks.join(met, F.col("block_id").eqNullSafe(F.col("_block")), "left").select(*blocks.columns, nothing.alias("places"), "terms")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            now = [_met_places(text, own) if text and own else [] for text, own in zip(batch.column(text_col).to_pylist(), batch.column("terms").to_pylist(), strict=True)]
            arrays = [_place_lists(now) if name == "places" else batch.column(name) for name in batch.schema.names if name != "terms"]
            yield pa.RecordBatch.from_arrays(arrays, names=[n for n in batch.schema.names if n != "terms"])

    out = joined.mapInArrow(search, joined.drop("terms").schema)
    for part in _split(terms.where(F.col("word").isNull()).select("term"), part_chars):
        held = _broadcast(blocks.sparkSession, part)

        def add(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            found = _loaded(held.value)
            for batch in batches:
                texts, before = batch.column(text_col).to_pylist(), batch.column("places").to_pylist()
                now = [[*old, *_pairs(places(text, found))] if text else old for text, old in zip(texts, before, strict=True)]
                at = batch.schema.get_field_index("places")
                yield batch.set_column(at, "places", pa.array(now, PLACES))

        out = stored(out.mapInArrow(add, out.schema), "places")
    return out


def _with_places_at_once(blocks: DataFrame, known: DataFrame, text_col: str) -> DataFrame:
    """with_places() by one automaton."""
    held = _broadcast(blocks.sparkSession, known)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _loaded(held.value)
        for batch in batches:
            now = [_pairs(places(text, found)) if text else [] for text in batch.column(text_col).to_pylist()]
            yield batch.append_column("places", pa.array(now, PLACES))

    schema = blocks.withColumn("places", F.array().cast("array<struct<start:int,end:int>>")).schema
    return blocks.mapInArrow(search, schema)


def _known(terms: DataFrame, part_chars: int) -> tuple[DataFrame, bool]:
    """The normal terms, stored, and whether they fit one automaton."""
    known = stored(normal_terms(terms), "terms")
    return known, (known.agg(F.sum(F.length("term"))).first()[0] or 0) <= part_chars


def with_places(blocks: DataFrame, terms: DataFrame, *, text_col: str = "source_text", part_chars: int = 4_000_000) -> DataFrame:
    """blocks with `places`, of all terms (column `term`) in the text."""
    known, one = _known(terms, part_chars)
    return _with_places_at_once(blocks, known, text_col) if one else _with_places(blocks, known, text_col, part_chars)


def protect_with_terms(blocks: DataFrame, terms: DataFrame, spans: Column | None = None, *, part_chars: int = 4_000_000) -> DataFrame:
    """block_id and `protected`, as of protection.protect_blocks(), for a glossary of any size. blocks: block_id,
    block_type, source_text; spans: the parser's spans of a block, an array of struct(start, end). A glossary of one part is
    looked for where its terms are protected, in one pass."""
    own = F.array() if spans is None else F.coalesce(spans, F.array())
    rows = blocks.select("block_id", "block_type", "source_text", own.cast("array<struct<start:int,end:int>>").alias("spans"))
    known, one = _known(terms, part_chars)
    if one:
        held = _broadcast(blocks.sparkSession, known)

        def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = _loaded(held.value)
            for batch in batches:
                yield protected_batch(batch, lambda _, text, locked: chosen(places(text, found), locked))

        return rows.mapInArrow(at_once, f"block_id long, protected {PROTECTED}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = span_lists(batch.column("places"))
            yield protected_batch(batch, lambda i, _, locked, there=there: chosen(there[i], locked))

    return _with_places(rows, known, "source_text", part_chars).mapInArrow(run, f"block_id long, protected {PROTECTED}")
