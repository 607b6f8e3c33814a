"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import string
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regex of what separates plain words (space and tab to carriage return).
GAP = r"[\x20\x09-\x0D]+"
#: Java regex of what separates alphanumeric words; every non-ASCII character belongs to a word.
NON_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

LOWER_BYTES = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
#: A-Z become a-z, every other ASCII byte but 0-9 and a-z becomes a space.
ALNUM_BYTES = bytes(
    b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else ord(chr(b).lower()) if chr(b).isupper() else 0x20
    for b in range(256)
)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, unlike lower()."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def remainder(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % k, F.lit(-1))


def plain_words(text: str | None) -> list[bytes]:
    """Words without lower-casing; bytes.split() splits at the six characters of GAP."""
    return text.encode("utf-8", "replace").split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(LOWER_BYTES).split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(ALNUM_BYTES).split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir. Where it
    is unset, a temporary folder serves a single machine (tests); on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    now = spark.sparkContext.getCheckpointDir()
    if now is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="folioflow-"))
        now = spark.sparkContext.getCheckpointDir()
    return now


BATCH_BYTES = 4 << 20
#: Folders of tables written in this session; see release().
_WRITTEN: list[str] = []


def new_path(spark: SparkSession, kind: str) -> str:
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables that operators have written so far, and say how many. Results are lazy
    and read such tables, so call this only when those that are still needed have been written out."""
    jvm, n = spark.sparkContext._jvm, 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def write_table(df: DataFrame, kind: str = "table") -> tuple[DataFrame, str]:
    """Cut the lineage with a table written to the shared folder; the table as read back, and its path."""
    path = new_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, kind: str = "table") -> DataFrame:
    return write_table(df, kind)[0]


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """For an action that writes a table: Spark deletes the files of its shuffles when it has ended, not when the driver happens to
    collect its garbage. The session's setting is put back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table of write_table() that nothing reads any more."""
    _WRITTEN.remove(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder; for small tables of iterations."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small_batches(df: DataFrame) -> DataFrame:
    """df, with Arrow batches of at most BATCH_BYTES in this session unless it has a bound of its own: the default
    of 64 MB is held several times over by the JVM and by each Python worker. Sizes of batches change no result."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in conf.getAll:
        conf.set(name, BATCH_BYTES)
    return df


def by_place(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows with columns named by their place, so that none clashes with an operator's own, and the
    new name of each column."""
    names = [f"_c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names, strict=True))


def text_chunks(batch: pa.RecordBatch, column: str, most: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of a batch of about `most` bytes of text, one row at least, each with its texts; no text is cut,
    and only one slice at a time is held as Python strings."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype("int64")
    ends = sizes.cumsum()
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = min(batch.num_rows, int(ends.searchsorted(before + most)) + 1)
        part = batch.slice(start, end - start)
        yield part, part.column(column).to_pylist()
        start = end
