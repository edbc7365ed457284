"""WARC archives with revisit records: digests decide which of equal payloads is stored, the others refer to it.

Headers (digest, id, url, size) are resolved by payload digest and give the revisit records; the other pages are written
where they are read, and Spark's text sink writes one WARC record a row: its line separator is the blank lines that end a record.  Reading parses whole gzip files
by Content-Length, a bounded number of records per file.
"""

from __future__ import annotations

import sys
import zlib

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayer.llm.shared import small_or_shuffled
from assayer.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_BYTES = 100
#: Records of a file at most, and bytes of their payloads before compression.
RECORDS_PER_FILE, FILE_BYTES = 20_000, 256 << 20
CREATED = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def headers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload (null: empty), payload_bytes and payload_digest (bare hex SHA-256 of the UTF-8 bytes)."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"),
                        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload.cast("binary"), 256).alias("payload_digest"))


def resolved(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """headers() and record_type, refers_to: of equal payloads of at least min_bytes the smallest page_id is the response
    and the others revisit it.  Rows that repeat that page_id are responses too; a null page_id never is the first.

    Only headers are shuffled: (page_id, url, size, digest) are written once, resolved by digest, and give the revisit
    records, which have no payload.  The pages that are no revisits pass through where they are, as long as the revisits'
    ids and digests are few enough to broadcast; beyond that the two meet in a shuffle.
    """
    narrow = written(pages.select("page_id", "url", "payload_bytes", "payload_digest"), "warc-headers")
    first = narrow.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"))
    again = narrow.join(first, "payload_digest").where(F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id")))
    again = written(again.select("page_id", "url", F.lit(None).cast("string").alias("payload"), "payload_bytes", "payload_digest",
                                 F.lit("revisit").alias("record_type"), F.col("first_id").alias("refers_to")), "warc-revisits")
    keys = again.select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest")).distinct()
    keys = small_or_shuffled(keys, again.count() * 5)  # an id and 64 digits take as much as five rows of two numbers
    kept = pages.join(keys, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left_anti")
    kept = kept.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return kept.unionByName(again)


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNull(), "").otherwise(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")))


def record(created: str = CREATED) -> Column:
    """A resolved row as WARC record text, without the two line ends that close it."""
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    response = F.col("record_type") == "response"
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"),
                     F.lit("\r\n\r\n"), F.when(response, F.col("payload")).otherwise(""))
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "%(?=0[AD])", "%25"), "\r", "%0D"), "\n", "%0A")
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\n"), _line("WARC-Record-ID", name(F.col("page_id"))),
        F.lit(f"WARC-Date: {created}\r\n"), _line("WARC-Target-URI", url), F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest"), F.lit("\r\n"),
        _line("WARC-Refers-To", name(F.col("refers_to"))), F.when(response, "").otherwise(f"WARC-Profile: {PROFILE}\r\n"),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def write_archives(rows: DataFrame, path: str, created: str = CREATED, records_per_file: int | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Write resolved rows as gzip-compressed WARC files through Spark's committer, so a task that runs again leaves one copy.

    A file holds at most RECORDS_PER_FILE records, and of records of the average stored size no more than file_bytes.
    """
    if records_per_file is None:
        stored = rows.agg(F.avg(F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0))).first()[0] or 0
        records_per_file = max(1, min(RECORDS_PER_FILE, int(file_bytes // (stored + 500))))
    (rows.select(record(created).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


def _records(content: bytes):
    """(header lines, block) of each record of a gzip-compressed file, read by Content-Length."""
    inflate, data, at = zlib.decompressobj(31), bytearray(), 0
    feed = memoryview(content)

    def more() -> bool:
        nonlocal feed
        if not feed:
            return False
        data.extend(inflate.decompress(feed[:1 << 18]))
        feed = feed[1 << 18:]
        if not feed:
            data.extend(inflate.flush())
        return True

    while True:
        while (end := data.find(b"\r\n\r\n", at)) < 0:
            if not more():
                return
        head = dict(line.split(b": ", 1) for line in bytes(data[at:end]).split(b"\r\n")[1:])
        size = int(head[b"Content-Length"])
        while len(data) < end + 4 + size + 4 and more():
            pass
        yield head, bytes(data[end + 4:end + 4 + size])
        at = end + 4 + size + 4
        if at > 1 << 22:
            del data[:at]
            at = 0


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest, payload_bytes (of the full payload) and payload (null for a
    revisit) of every record of the archives under path."""
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]

    def number(x: bytes | None):
        return int(x[len("<urn:page:"):-1]) if x else None

    def parse(batches):
        rows: list = []
        held = 0
        for batch in batches:
            for content in batch.column(0):
                for head, block in _records(content.as_buffer()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    url = head.get(b"WARC-Target-URI")
                    kind = head[b"WARC-Type"].decode()
                    rows.append((number(head.get(b"WARC-Record-ID")), url and url.decode().replace("%0D", "\r").replace("%0A", "\n").replace("%250", "%0"), kind, number(head.get(b"WARC-Refers-To")),
                                 head[b"WARC-Payload-Digest"].decode().partition(":")[2], int(http.rpartition(b": ")[2]), payload if kind == "response" else None))
                    held += len(block)
                    if held > 1 << 22:
                        yield _rows(rows, names)
                        rows, held = [], 0
        if rows:
            yield _rows(rows, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(parse, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def _rows(rows: list, names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write deduplicated archives of pages under path and read them back: one row per row of pages.

    Null payloads are empty; null urls and null ids leave their header out.  Repeated rows are all written.  An empty
    table gives no record.  Only the three columns are read, so further ones never clash.
    """
    write_archives(resolved(headers(pages, id_col, url_col, payload_col), min_bytes), path)
    return read_archives(pages.sparkSession, path)
