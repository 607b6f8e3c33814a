"""Bodies of fetches, kept once by content hash until the last fetch that needs them expires.

Two Parquet tables, both in folders by expiry day:

    refs     which fetch has which body: fetch_id, hash, expires_at
    bodies   hash, body, bytes

A body is written into the folder of the latest expiry among the fetches that bring it, unless a folder of that day or a
later one holds it already. So every live reference finds its body in a folder that expires no earlier than the reference, references of many fetches share one
copy, and expiry deletes whole folders: no file of a living folder is read or written for it. A body that is
brought again later is copied once for each later day on which it is brought.

Writing is staged by Spark's commit protocol, bodies before references; a write that is broken off and done again leaves at most a second
copy of a body, which readers pass over. One writer at a time.

Defined results: a null body is an empty one; fetches that expired before `now` are not written; a fetch id written
twice with the same body counts once.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import delete, names, stored

DAY = "day"


@dataclass(frozen=True)
class PayloadStore:
    spark: SparkSession
    path: str

    def refs(self) -> DataFrame:
        return self.spark.read.schema(f"fetch_id long, hash string, expires_at timestamp, {DAY} date").parquet(f"{self.path}/refs") if self._days("refs") else self.spark.createDataFrame([], f"fetch_id long, hash string, expires_at timestamp, {DAY} date")

    def bodies(self) -> DataFrame:
        schema = f"hash string, body binary, bytes long, {DAY} date"
        return self.spark.read.schema(schema).parquet(f"{self.path}/bodies") if self._days("bodies") else self.spark.createDataFrame([], schema)

    def _days(self, table: str) -> list[str]:
        return [n.removeprefix(f"{DAY}=") for n in names(self.spark, f"{self.path}/{table}") if n.startswith(f"{DAY}=")]

    def write(self, fetches: DataFrame, now: datetime) -> None:
        """fetches: fetch_id, body (binary), expires_at. Bodies that the store lacks are written, and all references."""
        body = F.coalesce("body", F.lit(b""))
        rows = fetches.where(F.col("expires_at") > F.lit(now)).select("fetch_id", body.alias("body"), F.sha2(body, 256).alias("hash"), F.col("expires_at").cast("timestamp").alias("expires_at"))
        rows = stored(rows.withColumn(DAY, F.to_date("expires_at")), "payloads")
        wanted = rows.groupBy("hash").agg(F.max(DAY).alias(DAY))
        # hash and day only: the bodies that are there already aren't read
        held = self.bodies().groupBy("hash").agg(F.max(DAY).alias("_held"))
        new = wanted.join(held, "hash", "left").where(F.col("_held").isNull() | (F.col("_held") < F.col(DAY))).select("hash", DAY)
        # of equal bodies, one row: the one with the smallest id on the latest day, found without moving bodies
        carriers = rows.join(new, ["hash", DAY]).groupBy("hash").agg(F.min("fetch_id").alias("_carrier"))
        chosen = rows.join(carriers.select(F.col("hash").alias("_hash"), "_carrier"), (F.col("hash") == F.col("_hash")) & (F.col("fetch_id") == F.col("_carrier"))).join(new, ["hash", DAY], "left_semi")
        bodies = chosen.select("hash", "body", F.octet_length("body").cast("long").alias("bytes"), DAY).dropDuplicates(["hash"])
        bodies.write.mode("append").partitionBy(DAY).parquet(f"{self.path}/bodies")
        rows.select("fetch_id", "hash", "expires_at", DAY).write.mode("append").partitionBy(DAY).parquet(f"{self.path}/refs")

    def expire(self, now: datetime) -> list[str]:
        """Delete the folders of the days before `now`'s; nothing else is touched. Returns the days."""
        gone = sorted({d for t in ("refs", "bodies") for d in self._days(t) if d < f"{now:%Y-%m-%d}"})
        for day in gone:
            for table in ("refs", "bodies"):  # references first: what is left always has its body
                delete(self.spark, f"{self.path}/{table}/{DAY}={day}")
        return gone

    def read(self, now: datetime) -> DataFrame:
        """fetch_id, hash, body, bytes of the fetches that haven't expired."""
        live = self.refs().where(F.col("expires_at") > F.lit(now)).select("fetch_id", "hash", "expires_at", F.col(DAY).alias("_day")).distinct()
        copies = self.bodies().groupBy("hash").agg(F.max(DAY).alias("_last"))
        last = live.join(copies, "hash").select("fetch_id", "hash", F.col("_last").alias(DAY))
        return last.join(self.bodies().dropDuplicates(["hash", DAY]), ["hash", DAY]).select("fetch_id", "hash", "body", "bytes")
