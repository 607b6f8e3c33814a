"""Tables that are updated by key, kept as Parquet in folders by the hash of the key.

A change reads and rewrites the buckets of its own keys; all other files stay as they are. Buckets are written with
Spark's dynamic partition overwrite: new files are staged beside the table and put in place when
all tasks have ended, so a lost executor costs a retry of its tasks only. A change that is broken
off while buckets are put in place leaves each bucket either old or new; upserts say what a row is to become,
so the same change is simply applied again.

Keys are unique in the table and a null key is a key like any other. Of several changes of one key within a call, the
last by `order` counts; rows of a tie must be equal. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..storage import bucket, stored

BUCKET = "bucket"
#: Takes old(name), new(name), whether there is an old row and whether there is a change; gives the new values.
Merge = Callable[[Callable[[str], Column], Callable[[str], Column], Column, Column], dict[str, Column]]


@dataclass(frozen=True)
class KeyedTable:
    spark: SparkSession
    path: str
    key: str
    schema: StructType
    buckets: int = 64

    def _stored(self) -> DataFrame:
        schema = StructType([*self.schema.fields, StructField(BUCKET, IntegerType())])
        return self.spark.read.schema(schema).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def lookup(self, keys: list) -> DataFrame:
        """Rows of a few keys; only their buckets are read."""
        wanted = self.spark.createDataFrame([(k,) for k in keys], StructType([StructField("k", self.schema[self.key].dataType)]))
        numbers = [r[0] for r in wanted.select(bucket("k", self.buckets)).distinct().collect()]
        return self._stored().where(F.col(BUCKET).isin(numbers) & F.col(self.key).isin(keys)).drop(BUCKET)

    def replace(self, rows: DataFrame) -> None:
        """Write the buckets that occur in `rows` anew: `rows` must be all that is to be in them."""
        dealt = rows.repartition(BUCKET, F.pmod(F.xxhash64(self.key, F.lit(1)), F.lit(4))).sortWithinPartitions(BUCKET, self.key)
        dealt.select(*self.schema.names, BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def _in(self, numbers: list[int]) -> DataFrame:
        return self._stored().where(F.col(BUCKET).isin(numbers))

    def upsert(self, changes: DataFrame, merge: Merge, order: list[str] | None = None) -> list[int]:
        """Apply changes, rows with the key and any other columns. merge(old, new, is_old, is_new) gives the values of a row:
        old(name) and new(name) are its columns before and in the change, is_old and is_new whether there is such a row. Returns the
        buckets written."""
        others = [c for c in changes.columns if c != self.key]
        last = changes
        if order:
            last = changes.groupBy(self.key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_r")).select(self.key, "_r.*")
        else:
            last = changes.dropDuplicates([self.key])
        new = stored(last.select(F.col(self.key).alias("_key"), F.struct(*[F.col(c) for c in changes.columns]).alias("_new"), bucket(self.key, self.buckets).alias("_bucket")), "changes")
        numbers = sorted(r["_bucket"] for r in new.select("_bucket").distinct().collect())  # the number of buckets at most
        if not numbers:
            return []
        old = self._in(numbers).select(BUCKET, F.struct(*self.schema.names).alias("_old"))
        met = old.join(new, (F.col(BUCKET) == F.col("_bucket")) & F.col(f"_old.{self.key}").eqNullSafe(F.col("_key")), "full")
        values = merge(lambda c: F.col(f"_old.{c}"), lambda c: F.col(f"_new.{c}"), F.col("_old").isNotNull(), F.col("_new").isNotNull())
        rest = {c: F.col(f"_old.{c}") for c in self.schema.names if c != self.key}
        key = F.when(F.col("_old").isNotNull(), F.col(f"_old.{self.key}")).otherwise(F.col("_key")).alias(self.key)
        columns = {**rest, **values}
        types = {f.name: f.dataType for f in self.schema.fields}
        out = met.select(*[key if c == self.key else columns[c].cast(types[c]).alias(c) for c in self.schema.names], F.coalesce(BUCKET, "_bucket").alias(BUCKET))
        self.replace(out)
        return numbers

    def update(self, where: Column, values: dict[str, Column]) -> list[int]:
        """Set columns of the rows for which `where` holds; only buckets with such a row are written. The search for them reads
        the columns of the condition."""
        numbers = sorted(r[BUCKET] for r in self._stored().where(where).select(BUCKET).distinct().collect())  # the number of buckets at most
        if numbers:
            changed = {c: F.when(where, v).otherwise(F.col(c)).cast(self.schema[c].dataType) for c, v in values.items()}
            self.replace(self._in(numbers).withColumns(changed))
        return numbers


def create(rows: DataFrame, path: str, key: str, *, buckets: int = 64) -> KeyedTable:
    """Write rows, one a key, as a new table. A key that is null in the schema of rows may be null."""
    table = KeyedTable(rows.sparkSession, path, key, StructType([StructField(f.name, f.dataType) for f in rows.schema.fields]), buckets)
    table.replace(rows.withColumn(BUCKET, bucket(key, buckets)))
    return table


# Changes of the page table (canonical_url, path, last_discovered_at, missing_since)


def _path(old: Callable[[str], Column], new: Callable[[str], Column], has: Column) -> Column:
    return F.when(has, new("path")).otherwise(old("path"))


def discovered(table: KeyedTable, found: DataFrame, now: datetime) -> list[int]:
    """Pages found by a discovery (canonical_url, path): inserted or updated, and no longer missing. Of several rows of a
    page the largest path counts."""

    def merge(old, new, was, has):
        return {"path": _path(old, new, has), "last_discovered_at": F.when(has, F.lit(now)).otherwise(old("last_discovered_at")), "missing_since": F.when(~has, old("missing_since"))}

    return table.upsert(found.select("canonical_url", "path"), merge, order=["path"])


def wanted(table: KeyedTable, pages: DataFrame) -> list[int]:
    """Pages asked for (canonical_url, path): inserted, or their path updated; the largest path of a page counts."""
    return table.upsert(pages.select("canonical_url", "path"), lambda old, new, was, has: {"path": _path(old, new, has)}, order=["path"])


def missing(table: KeyedTable, started: datetime, now: datetime) -> list[int]:
    """Mark pages that a complete discovery, begun at `started`, hasn't seen, unless they are marked."""
    unseen = F.col("missing_since").isNull() & (F.col("last_discovered_at").isNull() | (F.col("last_discovered_at") < F.lit(started)))
    return table.update(unseen, {"missing_since": F.lit(now)})


def latest(table: KeyedTable, rows: DataFrame, at: str) -> list[int]:
    """Single-key upserts: each key holds the row written last by `at`, those stored before included."""
    names = [c for c in table.schema.names if c != table.key]

    def merge(old, new, was, has):
        newer = has & (~was | (new(at) >= old(at)))
        return {c: F.when(newer, new(c)).otherwise(old(c)) for c in names}

    return table.upsert(rows.select(*table.schema.names), merge, order=[at])
