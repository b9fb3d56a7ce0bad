"""WARC archives with revisit records, written and read by Spark.

Headers are grouped by payload digest, one response per payload is chosen, and every other
record of that payload becomes a revisit of it with fresh headers and no payload. Records
are written by Spark's text writer, whose line separator is the two line ends that close a
WARC record, so no file is written outside Spark. An archive ends with the record that takes it
over ARCHIVE_BYTES; archives are read whole and parsed by Content-Length. A compressed archive is
one gzip member, as Spark's writer compresses files; uncompressed ones let a record be read alone.
"""

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

#: Bytes of an archive's records before compression; the last record may go beyond.
ARCHIVE_BYTES = 32 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8 bytes: the digest as a number to base 32, in the other alphabet."""
    hexed = F.sha1(payload.cast("binary"))
    # 15 hex digits are 12 letters; 64 bits are the most that a number here has.
    part = lambda at, n: F.lpad(F.conv(F.substring(hexed, at, n), 16, 32), n * 4 // 5, "0")
    return F.translate(F.concat(part(1, 15), part(16, 15), part(31, 10)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolved(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, payload_digest, refers_to and refers_url (null for responses).

    Of the pages with equal payloads of at least least bytes, that with the largest id is the
    response; rows that repeat its id are responses too, rows without an id revisit it. Null
    payloads are empty, pages without any id are all responses; other columns are not read.
    """
    text = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text.alias("payload"), F.octet_length(text).cast("long").alias("payload_bytes"), base32_sha1(text).alias("payload_digest"))
    originals = rows.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("original"), F.max_by("url", "page_id").alias("original_url"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # A table of its own: only then can the join split a payload that many pages have.
    originals = scratch.cut(originals, "originals")
    both = rows.join(originals, "payload_digest", "left")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original")) & (F.col("payload_bytes") >= least)
    return both.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", F.when(revisit, F.col("original")).alias("refers_to"), F.when(revisit, F.col("original_url")).alias("refers_url"))


def records(rows: DataFrame, date: str) -> DataFrame:
    """One string a WARC record, without the two line ends that close it."""
    safe = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\r", "%0D"), "\n", "%0A")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.coalesce(F.col("payload"), F.lit("")))
    revisit = F.col("payload").isNull()
    refers = F.concat(line("WARC-Profile", F.lit(_PROFILE)), line("WARC-Refers-To", name(F.col("refers_to"))), line("WARC-Refers-To-Target-URI", safe(F.col("refers_url"))), line("WARC-Refers-To-Date", F.lit(date)))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", safe(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, refers).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, block).alias("record"))


def write_archives(pages: DataFrame, out: str, archive_bytes: int = ARCHIVE_BYTES, compression: str = "gzip", date: str | None = None, **options) -> None:
    """Write pages as archives of about archive_bytes each to folders in out. date: of the records, as WARC wants it (unless given, now)."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            end = before + np.cumsum(pc.binary_length(batch.column(0)).to_numpy().astype(np.int64))
            # A record belongs to the archive in which it begins.
            number = np.append([before], end[:-1])[: len(end)] // archive_bytes
            before = int(end[-1]) if len(end) else before
            yield pa.RecordBatch.from_arrays([pa.array([f"{part:05d}-{n}" for n in number], pa.string()), batch.column(0)], names=["archive", "record"])

    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    dealt = records(resolved(pages, **options), date).mapInArrow(numbered, "archive string, record string")
    dealt.write.mode("overwrite").option("lineSep", "\r\n\r\n").option("compression", compression).partitionBy("archive").text(out)


READ = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, intact boolean, payload string"


def parsed(data: bytes) -> Iterator[tuple]:
    """READ's values of each record of an archive."""
    at = 0
    while data.startswith(b"WARC/", at):
        body = data.index(b"\r\n\r\n", at) + 4
        head = dict(x.split(": ", 1) for x in data[at : body - 4].decode().split("\r\n")[1:])
        end = body + int(head["Content-Length"])
        inner = data.index(b"\r\n\r\n", body) + 4
        size = int(re.search(rb"\r\nContent-Length: (\d+)", data[body:inner])[1])
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        page, refers = (int(m[1]) if (m := re.search(r":(-?\d+)>", head.get(k, ""))) else None for k in ("WARC-Record-ID", "WARC-Refers-To"))
        response = head["WARC-Type"] == "response"
        payload = data[inner:end] if response else None
        intact = base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest and len(payload) == size if response else inner == end
        yield page, head["WARC-Target-URI"], head["WARC-Type"], digest, size, refers, intact, payload.decode() if response else None
        at = end + 4
    if at != len(data):
        raise ValueError(f"no WARC record at byte {at} of {len(data)}")


def opened(data: pa.Buffer) -> bytes:
    """An archive's bytes; compressed ones begin as gzip does."""
    return zlib.decompress(data, 31) if bytes(data[:2]) == b"\x1f\x8b" else data.to_pybytes()


def read_archives(spark: SparkSession, out: str) -> DataFrame:
    """All records of the archives in a folder; intact: the payload has the length and digest that the headers name."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("intact", pa.bool_()), ("payload", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                rows = []
                for row in parsed(opened(value.as_buffer())):
                    rows.append(row)
                    if len(rows) == 200:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(out).select("content").mapInArrow(run, READ)


def archive_table(spark: SparkSession, pages: DataFrame, out: str | None = None, least: int = 0) -> DataFrame:
    """Write pages' archives (to out, else to the scratch folder) and read them back."""
    out = out or scratch.place(spark, "warc")
    write_archives(pages, out, least=least)
    return read_archives(spark, out)
