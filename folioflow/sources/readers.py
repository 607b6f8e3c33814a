"""Stored text resources as DataFrames: plain or gzipped files, with limits on what they hold."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESOURCE = "path string, body string, error string"


def unpacked(content: bytes, most: int) -> tuple[bytes | None, str | None]:
    """The content, gunzipped if it is gzip; or an error code if it is damaged or holds more than `most` bytes.
    No more than that is ever unpacked."""
    if content[:2] != b"\x1f\x8b":
        return (content, None) if len(content) <= most else (None, "body_too_large")
    out, rest = b"", content
    while rest:
        d = zlib.decompressobj(wbits=31)
        try:
            out += d.decompress(rest, most + 1 - len(out))
        except zlib.error:
            return None, "invalid_gzip"
        if len(out) > most:
            return None, "body_too_large"
        if not d.eof:
            return None, "invalid_gzip"
        rest = d.unused_data
    return out, None


def text_resources(spark: SparkSession, path: str, *, most_bytes: int = 8 << 20, gzip: bool = True) -> DataFrame:
    """RESOURCE rows, one for each file under `path`. A file over `most_bytes`, packed or unpacked, or one that isn't UTF-8,
    has an error and no body. Files too large even packed aren't read, empty ones are passed over. With gzip off
    a packed file is no text."""
    return _resources(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), most_bytes, gzip)


def text_resource_stream(spark: SparkSession, path: str, *, most_bytes: int = 8 << 20, gzip: bool = True, files_at_once: int = 1000, bytes_at_once: int | None = None) -> DataFrame:
    """The rows of text_resources() as a stream over a growing folder: Spark's file source keeps which files it has given, and a micro-batch
    takes files_at_once files, or bytes_at_once bytes, at most. It is Spark's own source, so it reads every store that Spark reads."""
    limit = ("maxFilesPerTrigger", files_at_once) if bytes_at_once is None else ("maxBytesPerTrigger", bytes_at_once)
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option(*limit).load(path)
    return _resources(files, most_bytes, gzip)


def _resources(files: DataFrame, most_bytes: int, gzip: bool) -> DataFrame:
    small = files.where(F.col("length") <= most_bytes).select("path", "content")
    large = files.where(F.col("length") > most_bytes).select("path", F.lit(None).cast("string").alias("body"), F.lit("body_too_large").alias("error"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                content = batch.column("content")[i].as_py()
                body, error = unpacked(content, most_bytes) if gzip else (content, None)
                try:
                    text = None if body is None else body.decode("utf-8-sig")
                except UnicodeDecodeError:
                    text, error = None, "not_text"
                yield pa.RecordBatch.from_pydict(
                    {"path": [batch.column("path")[i].as_py()], "body": pa.array([text], pa.string()), "error": pa.array([error], pa.string())}
                )

    return small.mapInArrow(read, RESOURCE).unionByName(large)


def bounded(bodies: DataFrame, column: str = "body", most_bytes: int = 8 << 20) -> DataFrame:
    """Rows with `error`: body_too_large over most_bytes, whose body is then null."""
    over = F.octet_length(column) > most_bytes
    return bodies.withColumns({"error": F.when(over, "body_too_large"), column: F.when(~F.coalesce(over, F.lit(False)), F.col(column))})
