"""Tables in the folder that driver and executors share, and cutting lineage with them."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a temporary folder serves a single
    machine (tests); on a cluster that is an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="folioflow-"))
    return named or context.getCheckpointDir()


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, kind: str = "table") -> DataFrame:
    """Cut the lineage with a table written to the shared folder, and read it back."""
    path = new_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _folder(spark, path)
    return system.exists(place)


def rename(spark: SparkSession, path: str, to: str) -> bool:
    """Whether `path` has become `to`; it doesn't where `to` exists."""
    place, system = _folder(spark, path)
    target, _ = _folder(spark, to)
    return not system.exists(target) and system.rename(place, target)


def delete(spark: SparkSession, path: str) -> bool:
    place, system = _folder(spark, path)
    return system.delete(place, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it doesn't exist."""
    place, system = _folder(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []


def bucket(key: Iterable[Column | str] | Column | str, buckets: int) -> Column:
    """The number of a key's bucket, 0 to buckets - 1."""
    columns = [key] if isinstance(key, (str, Column)) else list(key)
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")
