"""Search over a stored trigram index, so that a query reads what may match and not the whole corpus.

The index is four Parquet tables under one folder:

    entries   the rows of search_rows(), in folders by `part`, a range of pages
    pages     posting lists of titles and paths: the pages whose text holds a trigram
    blocks    posting lists of sources and translations: the pages that have such a block
    settings  one row: number of buckets, pages in a run, pages in a part, schema of entries

A posting list is a table row (trigram, run, n, ids): the ascending page ids, within one run of
`run_pages` ids, whose text holds the trigram. So no list is longer than a run, however common the trigram is. Lists are written in
ascending order with Parquet's delta encoding and lie in folders by `bucket`, the hash of the trigram; a query reads the
buckets of its trigrams only.

A query reads the lengths of its trigrams' lists first, takes the `most_lists` rarest, and intersects
them run by run, the shortest list first. Pages that are left are candidates; their entries are read
from their parts only, and the same patterns as in search() are applied to them, so results are the same.

Defined results: a query of one or two code points has no trigram and reads all entries; null texts
have no trigrams. Case is folded by lower(), as ILIKE folds it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from ..functions.text import normalize_query
from ..storage import bucket, stored
from .search import ranked

#: Written with delta encoding for ascending numbers instead of a dictionary.
_ENCODING = {"parquet.writer.version": "v2", "parquet.enable.dictionary#ids.list.element": "false"}


LISTS = "trigram string, run long, n int, ids array<long>, bucket int"
PART = StructType().add("trigram", "string").add("run", "long").add("ids", ArrayType(LongType(), containsNull=False))
#: Characters that a task takes at once, but for a single longer text.
BATCH_CHARS = 1 << 22


def query_trigrams(query: str) -> list[str]:
    low = normalize_query(query).lower()
    return sorted({low[i : i + 3] for i in range(len(low) - 2)})


def _lists_of(pages: np.ndarray, texts: list[str], run_pages: int) -> Iterator[pa.RecordBatch]:
    """trigram, run, ids: the pages of some texts, of three characters or more, that hold each trigram, each once and ascending."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = np.unique(points)
    ids, page = np.unique(pages, return_inverse=True)
    n, base = len(ids), len(letters)
    if len(texts) > 1 and (base**3 * n >= 1 << 63 or len(points) > BATCH_CHARS):
        half = len(texts) // 2
        yield from _lists_of(pages[:half], texts[:half], run_pages)
        yield from _lists_of(pages[half:], texts[half:], run_pages)
        return
    place = np.zeros(int(letters[-1]) + 1, np.int64)
    place[letters] = np.arange(base)
    p = place[points]
    sizes = np.array([len(t) for t in texts])
    whole = np.ones(len(p) - 2, bool)  # places of trigrams that lie in one text
    ends = np.cumsum(sizes)[:-1]
    whole[ends - 2] = whole[ends - 1] = False
    pairs = ((p[:-2] * base + p[1:-1]) * base + p[2:]) * n + np.repeat(page, sizes)[:-2]
    trigram, at = np.divmod(np.unique(pairs[whole]), n)
    run = ids[at] // run_pages
    starts = np.flatnonzero(np.concatenate([[True], (trigram[1:] != trigram[:-1]) | (run[1:] != run[:-1])]))
    codes = trigram[starts]
    of = [chr(c) for c in letters.tolist()]
    names = [of[a] + of[b] + of[c] for a, b, c in zip((codes // base**2).tolist(), (codes // base % base).tolist(), (codes % base).tolist(), strict=True)]
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)), pa.int32()), pa.array(ids[at], pa.int64()))
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(run[starts], pa.int64()), lists], names=PART.names)


def _postings(texts: DataFrame, run_pages: int, buckets: int) -> DataFrame:
    """texts (page_id, text) -> trigram, run, n, ids, bucket. A batch of rows gives each of its trigrams once for a run, with all of its pages;
    what is shuffled and merged are these lists and not single trigrams."""

    def lists_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _lists_of(batch.column("page_id").to_numpy(zero_copy_only=False), batch.column("text").to_pylist(), run_pages)

    low = texts.select(F.col("page_id").cast("long").alias("page_id"), F.lower("text").alias("text")).where(F.length("text") >= 3)
    parts = low.mapInArrow(lists_of, PART)
    lists = parts.groupBy("trigram", "run").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))  # run_pages ids at most
    return lists.select("trigram", "run", F.size("ids").alias("n"), "ids", bucket("trigram", buckets).alias("bucket"))


@dataclass(frozen=True)
class SearchIndex:
    spark: SparkSession
    path: str
    buckets: int
    run_pages: int
    part_pages: int
    entry_schema: str

    def table(self, name: str) -> DataFrame:
        schema = StructType.fromJson(json.loads(self.entry_schema)) if name == "entries" else LISTS
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")


def write_index(rows: DataFrame, path: str, *, buckets: int = 64, run_pages: int = 4096, most_parts: int = 4096) -> SearchIndex:
    """Write the index of search_rows() to a folder."""
    spark = rows.sparkSession
    least, most = rows.agg(F.min("page_id"), F.max("page_id")).first()
    runs = (most // run_pages - least // run_pages + 1) if most is not None else 1
    part_pages = run_pages * -(-runs // most_parts)
    entries = rows.withColumn("part", F.floor(F.col("page_id") / part_pages))
    entries.repartition("part", bucket("page_id", 4)).sortWithinPartitions("part", "page_id").write.partitionBy("part").parquet(f"{path}/entries")
    # the tables of lists are made from what is stored, so both read the same rows
    held = spark.read.schema(entries.schema).parquet(f"{path}/entries")
    by_page = held.select("page_id", "title", "path").distinct()
    texts = {
        "pages": by_page.select("page_id", F.explode(F.array("title", "path")).alias("text")),
        "blocks": held.select("page_id", F.explode(F.array("source_text", "translated_text")).alias("text")),
    }
    for name, one in texts.items():
        lists = _postings(one, run_pages, buckets)
        dealt = lists.repartition("bucket", bucket("run", 8)).sortWithinPartitions("bucket", "trigram", "run")
        dealt.write.options(**_ENCODING).partitionBy("bucket").parquet(f"{path}/{name}")
    settings = spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(run_pages).alias("run_pages"), F.lit(part_pages).cast("long").alias("part_pages"), F.lit(entries.schema.json()).alias("entry_schema"))
    settings.write.parquet(f"{path}/settings")  # last: an index without it isn't whole
    return SearchIndex(spark, path, buckets, run_pages, part_pages, entries.schema.json())


def open_index(spark: SparkSession, path: str) -> SearchIndex:
    row = spark.read.parquet(f"{path}/settings").first()
    return SearchIndex(spark, path, row["buckets"], row["run_pages"], row["part_pages"], row["entry_schema"])


def _lists(index: SearchIndex, name: str, trigrams: list[str]) -> DataFrame:
    """The lists of some trigrams: the filter on buckets chooses folders, the one on trigrams is pushed to the scan."""
    rows = index.spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in trigrams])).alias("t")).select(bucket("t", index.buckets).alias("b"))
    buckets = sorted({r["b"] for r in rows.collect()})  # one row a trigram of the query
    return index.table(name).where(F.col("bucket").isin(buckets) & F.col("trigram").isin(trigrams))


def _shared(lists: Column) -> Column:
    """What all of an array of lists (n, ids) have in common, from the shortest list on."""
    ordered = F.array_sort(lists)
    rest = F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0)))
    return F.aggregate(rest, ordered[0]["ids"], lambda now, x: F.array_intersect(now, x["ids"]))


def candidate_pages(index: SearchIndex, name: str, query: str, *, most_lists: int = 6) -> DataFrame | None:
    """page_id of the pages whose texts in the table `name` hold the query's rarest trigrams; None if it has no trigram."""
    trigrams = query_trigrams(query)
    if not trigrams:
        return None
    lists = _lists(index, name, trigrams)
    sizes = {r["trigram"]: r["n"] for r in lists.groupBy("trigram").agg(F.sum("n").alias("n")).collect()}  # lengths only; one row a trigram
    if len(sizes) < len(trigrams):
        return index.spark.createDataFrame([], "page_id long")
    rarest = sorted(sizes, key=lambda t: (sizes[t], t))[:most_lists]
    met = _lists(index, name, rarest).groupBy("run").agg(F.collect_list(F.struct("n", "trigram", "ids")).alias("lists"))  # most_lists lists of a run at most
    return met.where(F.size("lists") == len(rarest)).select(F.explode(_shared(F.col("lists"))).alias("page_id"))


def candidate_entries(index: SearchIndex, query: str, **options) -> DataFrame:
    """Entries of the candidate pages; only the parts that hold one are read."""
    entries = index.table("entries")
    found = [candidate_pages(index, name, query, **options) for name in ("pages", "blocks")]
    if found[0] is None:
        return entries.drop("part")
    pages = stored(found[0].union(found[1]).distinct().withColumn("part", F.floor(F.col("page_id") / index.part_pages)), "candidates")
    parts = [r["part"] for r in pages.select("part").distinct().collect()]  # as many as the index has parts at most
    return entries.where(F.col("part").isin(parts)).join(pages, ["part", "page_id"], "left_semi").drop("part")


def search_index(index: SearchIndex, query: str, limit: int = 20, *, whole: bool = False, **options) -> DataFrame:
    """The rows of search(), from the index; with `whole` the best of all matching rows, without search()'s limit on candidates."""
    return ranked(candidate_entries(index, query, **options), normalize_query(query), limit, whole=whole)
