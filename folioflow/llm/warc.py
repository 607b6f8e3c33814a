"""WARC archives: write captures as records, read archives back, and assemble transactions.

A capture is three records: a request, a response (or a revisit of an identical payload), and
metadata. Request and metadata name their response in WARC-Concurrent-To. Archives are written by
Spark's text writer, a record for each row with the record end as separator, so any file system
Spark knows will do; reading takes the files as they are and walks them by Content-Length. The
records are then brought together by transaction, the identifier that they are concurrent to, into one
nested row per capture.

Of equal payloads (SHA-256) of `min_revisit_bytes` or more, the smallest page_id is the response and
the rest revisit it without carrying the payload. A payload is shuffled once, after equal ones have been
folded in each task, however many pages have it; revisits are worked out on rows without payloads.
Archives are cut by size: records of up to 256 KB, 16 MB and more are written apart, with so many to a file
that none exceeds `file_bytes` (a larger record is a file of its own), as a file is one row when read.
They are read as streams, one record at a time in memory.

Defined results: null html is an empty payload; null page_ids come after all others, rows with the same
page_id in order of their urls; rows equal in id, url and payload are captures of their own, numbered; a
null url is left out of the record. An empty table gives an empty result. The folder of the archives stays
(a temporary one until common.release()).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, small_batches

CRLF = "\r\n"
RECORD_END = CRLF + CRLF
HTTP_OK = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
NO_TOP = 1 << 62
#: Payload sizes (below each) whose captures are written to files of their own.
SIZES = (1 << 18, 1 << 24, NO_TOP)
RECORD = (
    "archive string, offset long, type string, record_id string, concurrent_to string, refers_to string, target_uri string, "
    "headers map<string,string>, block_bytes long, payload binary, payload_bytes long, payload_digest string"
)


def _line(name: str, value: Column | str) -> Column:
    value = F.lit(value) if isinstance(value, str) else value
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def _record_id(kind: str, *of: Column) -> Column:
    """An identifier made from what tells one capture from all others."""
    said = [F.coalesce(c.cast("string"), F.lit("\0")) for c in of]
    h = F.sha2(F.concat_ws("\x01", F.lit(kind), *said), 256)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(
        F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">")
    )


def _record(kind: Column | str, record_id: Column, block: Column, lines: list[Column], content_type: str, date: str) -> Column:
    return F.concat(
        F.lit("WARC/1.1" + CRLF), _line("WARC-Type", kind), _line("WARC-Record-ID", record_id), _line("WARC-Date", date), *lines,
        _line("Content-Type", content_type), _line("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF), block,
    )


def captured(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 100,
) -> DataFrame:
    """A row for each page: page_id, url, digest, copy (number among equal rows), html (null in revisits), and for
    revisits first_id and first_url of the page that has the payload."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.translate(F.col(url_col).cast("string"), "\r\n", "").alias("url"), html.alias("html"),
        F.octet_length(html).alias("bytes"), F.sha2(html, 256).alias("digest"),
    )
    large = F.col("bytes") >= min_revisit_bytes
    own = F.when(~large, F.col("html")).alias("html")
    numbered = rows.groupBy("page_id", "url", "digest", own).agg(F.count("*").alias("n")).withColumn(
        "copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    ).drop("n")
    key = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"), F.col("url").alias("url"))
    payloads = rows.where(large).groupBy("digest").agg(F.min(key).alias("first"), F.first("html").alias("html"))
    none = F.lit(None).cast("string")
    responses = payloads.select(
        F.col("first.id").alias("page_id"), F.col("first.url").alias("url"), "digest", F.lit(0).cast("long").alias("copy"), "html", none.alias("first_url"),
        F.col("first.id").alias("first_id"), F.lit(False).alias("revisit"),
    )
    small = numbered.where(F.col("html").isNotNull()).select(
        "page_id", "url", "digest", "copy", "html", none.alias("first_url"), F.col("page_id").alias("first_id"), F.lit(False).alias("revisit")
    )
    firsts = rows.where(large).groupBy(F.col("digest").alias("_digest")).agg(F.min(key).alias("first"))
    is_first = F.col("page_id").eqNullSafe(F.col("first.id")) & F.col("url").eqNullSafe(F.col("first.url")) & (F.col("copy") == 0)
    revisits = numbered.where(F.col("html").isNull()).join(firsts, F.col("digest") == F.col("_digest")).where(~is_first).select(
        "page_id", "url", "digest", "copy", none.alias("html"), F.col("first.url").alias("first_url"), F.col("first.id").alias("first_id"), F.lit(True).alias("revisit")
    )
    return responses.unionByName(small).unionByName(revisits)


def capture_records(pages: DataFrame, *, date: str = "2024-01-01T00:00:00Z", **options) -> DataFrame:
    """Columns `value`, the text of every record (three for each page), and `bytes`, the payload's length."""
    rows = captured(pages, **options)
    who = (F.col("page_id"), F.col("url"), F.col("digest"), F.col("copy"))
    response, target = _record_id("response", *who), _line("WARC-Target-URI", F.col("url"))
    host = F.coalesce(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract("url", r"^[a-z]+://[^/?#]+(/[^#]*)", 1), F.lit("/"))
    request = _record(
        "request", _record_id("request", *who), F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1" + CRLF + "Host: "), host, F.lit(RECORD_END)),
        [_line("WARC-Concurrent-To", response), target], "application/http; msgtype=request", date,
    )
    answer = _record(
        F.when(F.col("revisit"), "revisit").otherwise("response"), response, F.concat(F.lit(HTTP_OK), F.coalesce("html", F.lit(""))),
        [
            target, _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
            F.when(
                F.col("revisit"),
                F.concat(
                    _line("WARC-Refers-To", _record_id("response", F.col("first_id"), F.col("first_url"), F.col("digest"), F.lit(0))),
                    _line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                ),
            ).otherwise(F.lit("")),
        ],
        "application/http; msgtype=response", date,
    )
    about = F.concat(_line("pageId", F.coalesce(F.col("page_id").cast("string"), F.lit(""))), _line("fetchStatus", "200"))
    metadata = _record(
        "metadata", _record_id("metadata", *who), about, [_line("WARC-Concurrent-To", response), target], "application/warc-fields", date,
    )
    size = F.coalesce(F.octet_length("html"), F.lit(0)).alias("bytes")
    return rows.select(F.explode(F.array(request, answer, metadata)).alias("value"), size)


def write_archives(pages: DataFrame, path: str, *, file_bytes: int = 1 << 30, html_col: str = "html", **options) -> str:
    """Write the captures of all pages as gzipped archives under `path`."""
    records = capture_records(pages, html_col=html_col, **options)
    largest = pages.agg(F.max(F.octet_length(html_col))).first()[0] or 0
    below = 0
    for top in SIZES:
        if not below or largest >= below:
            some = records if not below and largest < top else records.where((F.col("bytes") >= below) & (F.col("bytes") < top))
            # beside a payload of its size a capture has records of a few KB; three records are one capture
            n = 3 * max(1, file_bytes // (top + (1 << 14))) if top < NO_TOP else 1
            some.select("value").write.mode("append").option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", n).text(path)
        below = top
    return path


class _Stream:
    """Bytes of an archive, plain or of any number of gzip members, unpacked as they are read."""

    def __init__(self, content: bytes, step: int = 1 << 20):
        self.raw, self.step, self.at, self.have = memoryview(content), step, 0, bytearray()
        self.zip = zlib.decompressobj(wbits=31) if content[:2] == b"\x1f\x8b" else None
        self.place = 0  # of the first byte in self.have

    def more(self) -> bool:
        if self.zip is None or (not self.zip.unconsumed_tail and self.at >= len(self.raw) and not self.zip.unused_data):
            part = bytes(self.raw[self.at : self.at + self.step]) if self.zip is None else b""
            self.at += len(part)
            self.have += part
            return bool(part)
        if self.zip.eof:  # the next member
            rest, self.zip = self.zip.unused_data, zlib.decompressobj(wbits=31)
        else:
            rest = self.zip.unconsumed_tail
        if not rest:
            rest = bytes(self.raw[self.at : self.at + self.step])
            self.at += len(rest)
        self.have += self.zip.decompress(rest, self.step)
        return bool(rest)

    def find(self, what: bytes) -> int:
        start = 0
        while (at := self.have.find(what, start)) < 0:
            start = max(0, len(self.have) - len(what))
            if not self.more():
                return -1
        return at

    def take(self, n: int) -> bytes:
        while len(self.have) < n and self.more():
            pass
        out = bytes(self.have[:n])
        del self.have[:n]
        self.place += len(out)
        return out


def _walk(stream: _Stream) -> Iterator[dict]:
    while True:
        while (gap := stream.take(2)) == b"\r\n":
            pass
        if not gap:
            return
        at = stream.place - 2
        end = stream.find(RECORD_END.encode())
        if end < 0 or not gap.startswith(b"WA"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {}
        for line in stream.take(end + 4).decode("utf-8", "replace").split(CRLF)[1:]:
            name, colon, value = line.partition(":")
            if colon:
                headers[name.strip().lower()] = value.strip()
        length = int(headers["content-length"])
        block = stream.take(length)
        if len(block) < length:
            raise ValueError(f"record at byte {at} is cut short")
        yield {"offset": at, "headers": headers, "block": block}


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under `path`, one row each. `payload` is the HTTP body, or the block
    of records that aren't HTTP; its length and SHA-256 are those of what was read."""
    schema = spark.createDataFrame([], RECORD).schema

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                name, rows, size = batch.column("path")[i].as_py(), [], 0
                for r in _walk(_Stream(batch.column("content")[i].as_py())):
                    h, block = r["headers"], r["block"]
                    http = h.get("content-type", "").startswith("application/http")
                    payload = block.partition(b"\r\n\r\n")[2] if http else block
                    rows.append(
                        {
                            "archive": name, "offset": r["offset"], "type": h.get("warc-type"), "record_id": h.get("warc-record-id"),
                            "concurrent_to": h.get("warc-concurrent-to"), "refers_to": h.get("warc-refers-to"), "target_uri": h.get("warc-target-uri"),
                            "headers": list(h.items()), "block_bytes": len(block), "payload": payload, "payload_bytes": len(payload),
                            "payload_digest": hashlib.sha256(payload).hexdigest(),
                        }
                    )
                    size += len(block)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return small_batches(files).mapInArrow(parse, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: page_id, target_uri, and the structs request, response and metadata, brought
    together by transaction (null where an archive lacks one; of records of one kind that claim the same
    transaction one is taken). `original` is the response that a revisit refers to, from which its payload's
    length and digest are taken; its fields are null in other rows."""
    kind = F.when(F.col("type") == "revisit", "response").otherwise(F.col("type"))
    page = F.nullif(F.regexp_extract(F.col("payload").cast("string"), r"(?m)^pageId: *([^\r\n]*)", 1), F.lit(""))
    fields = {
        "response": ("archive", "offset", "type", "record_id", "headers", "payload", "payload_bytes", "payload_digest"),
        "request": ("archive", "offset", "record_id", "headers", "payload"), "metadata": ("archive", "offset", "record_id", "headers", "payload"),
    }
    of = lambda k, c: F.first(F.when(kind == k, c), ignorenulls=True)
    one = records.groupBy(F.coalesce("concurrent_to", "record_id").alias("transaction")).agg(
        *[of(k, F.col(c)).alias(f"{k}_{c}") for k, some in fields.items() for c in some],
        of("response", F.col("refers_to")).alias("refers_to"), of("response", F.col("target_uri")).alias("target_uri"), of("metadata", page).alias("page_id"),
    ).where(F.col("response_record_id").isNotNull())
    whole = lambda k: F.when(F.col(f"{k}_record_id").isNotNull(), F.struct(*[F.col(f"{k}_{c}").alias(c) for c in fields[k]])).alias(k)
    originals = one.where(F.col("response_type") == "response").select(
        F.col("response_record_id").alias("_id"), F.col("response_payload_bytes").alias("_bytes"), F.col("response_payload_digest").alias("_payload"),
        F.col("page_id").alias("original_page_id"),
    )
    joined = one.join(originals, F.col("refers_to") == F.col("_id"), "left")
    original = F.struct(F.col("_id").alias("record_id"), F.col("_bytes").alias("payload_bytes"), F.col("_payload").alias("payload_digest"))
    # as plain structs these let unused fields, the payload above all, be pruned before the shuffle
    response = F.struct(*[F.col(f"response_{c}").alias(c) for c in fields["response"]]).alias("response")
    return joined.select("page_id", "target_uri", whole("request"), response, whole("metadata"), original.alias("original"), "original_page_id")


def captures(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the pages' archives (to a new folder in the shared one unless a path is given) and read
    them back as captures."""
    spark = pages.sparkSession
    return assemble(read_archives(spark, write_archives(pages, path or new_path(spark, "warc"), **options)))
