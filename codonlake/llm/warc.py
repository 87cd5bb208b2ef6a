"""WARC archives with repeated payloads resolved to revisit records.

Headers (page, digest, length) are shuffled by payload digest; of the pages
that share a long enough payload, the one with the largest page_id keeps it and
the others become revisits. The decision then meets the payloads in one shuffle
by page, and every partition writes gzip archives through Spark's text sink:
a record is a row, the record terminator is the sink's line separator, so a
lost task is simply written again. An archive is one gzip member; it ends after
so many records that those of the largest payload fit ARCHIVE_BYTES, as it is
read back as a whole.

Cases: null html is an empty payload; a null url is an empty target; rows with
equal page_id and payload share their decision; a null page_id is a key like
any other and loses ties; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

MIN_REVISIT_BYTES = 1000
ARCHIVE_BYTES = 256 << 20
SALTS = 16
END = "\r\n\r\n"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string"


def headers(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long"),
        F.coalesce(F.col("url"), F.lit("")).alias("url"),
        html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"),
        F.sha1(html.cast("binary")).alias("payload_digest"),
    )


def resolve_revisits(heads: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, payload_digest, refers_to) of all pages that revisit another."""
    long_ones = heads.filter(F.col("payload_bytes") >= min_bytes).select("page_id", "payload_digest").distinct()
    kept = long_ones.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # a payload may hold a third of all pages: its pages are dealt over SALTS tasks
    left = long_ones.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    right = kept.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = left.join(right, ["payload_digest", "salt"])
    return both.filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "payload_digest", "refers_to")


def _record_id(page_id, digest):
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), digest, F.lit(">"))


def archive_lines(pages: DataFrame, date: str | None = None, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """One WARC record per page in the column ``value``, without its terminator; dated now, or as given."""
    heads = headers(pages)
    revisits = resolve_revisits(heads, min_bytes).withColumnRenamed("page_id", "_page").withColumnRenamed("payload_digest", "_digest")
    same = heads.page_id.eqNullSafe(revisits["_page"]) & (heads.payload_digest == revisits["_digest"])
    rows = heads.join(revisits, same, "left")
    again = F.col("refers_to").isNotNull()
    nl = F.lit("\r\n")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("html")))
    revisit = F.concat(
        F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "),
        _record_id(F.col("refers_to"), F.col("payload_digest")),
        nl,
    )
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "),
        _record_id(F.col("page_id"), F.col("payload_digest")),
        F.lit("\r\nWARC-Date: "),
        F.lit(date) if date else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit("\r\nWARC-Target-URI: "),
        F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("payload_digest"),
        nl,
        F.when(again, revisit).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END),
    )
    return rows.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, records_per_archive: int = 1000, archive_bytes: int = ARCHIVE_BYTES, **how) -> None:
    """Write gzip archives below ``path``, of at most ``records_per_archive`` records and about ``archive_bytes``."""
    largest = pages.agg(F.max(F.octet_length("html") + F.coalesce(F.octet_length("url"), F.lit(0)))).first()[0] or 0
    most = max(1, min(records_per_archive, archive_bytes // (largest + 1000)))
    archive_lines(pages, **how).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def _records(data: bytes):
    """(WARC headers, HTTP headers, payload) of every record; lengths rule, not separators."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:stop].decode().split("\r\n")[1:])
        end = stop + 4 + int(head["Content-Length"])
        http, _, payload = data[stop + 4 : end].partition(b"\r\n\r\n")
        yield head, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload
        at = end + 4


def _parse(batches):
    import hashlib

    page = lambda urn: None if (x := re.match(r"<urn:page:(-?\d+|null):", urn)[1]) == "null" else int(x)
    names = [x.split()[0] for x in READ.split(", ")]
    for batch in batches:
        for data in batch.column("content").to_pylist():
            out = []
            for head, http, payload in _records(zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data):
                again = head["WARC-Type"] == "revisit"
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:") if again else hashlib.sha1(payload).hexdigest()
                size = int(http["Content-Length"]) if again else len(payload)
                refers = page(head["WARC-Refers-To"]) if again else None
                out.append((page(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], refers, head["WARC-Target-URI"], None if again else payload.decode()))
                if len(out) == 1000:
                    yield pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(names, zip(*out))}, schema=_SCHEMA)
                    out = []
            if out:
                yield pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(names, zip(*out))}, schema=_SCHEMA)


_SCHEMA = pa.schema([(n, {"long": pa.int64(), "string": pa.string()}[t]) for n, t in (x.split() for x in READ.split(", "))])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``; revisits have no html of their own."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parse, READ)


def roundtrip(pages: DataFrame, **how) -> DataFrame:
    """Write ``pages`` to fresh archives in the shared folder and read them back."""
    path = shared_dir(pages.sparkSession, "warc")
    write_archives(pages, path, **how)
    return read_archives(pages.sparkSession, path)
