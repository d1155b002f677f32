"""WARC archives with revisit records: equal payloads are stored once.

Headers alone are shuffled by payload digest to find originals: of the records with one
digest the one with the largest id is the response and the others revisit it. A second
join by digest brings each page its decision; there, a table of originals with copies that
is small enough for Spark to broadcast spares shuffling payloads, else these move once.
Archives are written with fresh headers, one gzip stream a file (no member a record, so a
reader goes through a file from its start), and read back as a stream, record by record,
through Content-Length. Payloads shorter than ``min_bytes`` are always stored.

Cases: a null payload is empty; a null id is the smallest and writes no id header;
repeated rows of the response's id are responses, too; a line break in a URL is
percent-encoded; an empty table writes an archive without records; other columns
are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coderake.llm.common import PART_BYTES, saved, shared_dir

#: What ends every record.
RECORD_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, payload string"


def _base32(hexes: Column) -> Column:
    """Base32 of 40 hexadecimal digits: each five of them are four digits of base 32, in another alphabet."""
    groups = [F.lpad(F.conv(F.substring(hexes, at, 5), 16, 32), 4, "0") for at in range(1, 41, 5)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def described(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest (base32 SHA-1)."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), _base32(F.sha1(payload.cast("binary"))).alias("payload_digest"))


def originals(rows: DataFrame, min_bytes: int = 0) -> DataFrame:
    """payload_digest, original (largest id), copies, bytes: an aggregate, so that copies never gather in one task."""
    rows = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
    return rows.agg(F.max("page_id").alias("original"), F.count("*").alias("copies"), F.sum("payload_bytes").alias("bytes"))


def resolved(rows: DataFrame, copied: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds record_type and refers_to by a join with the originals that have copies."""
    rows = rows.join(copied.select("payload_digest", "original"), "payload_digest", "left")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original")) & (F.col("payload_bytes") >= min_bytes)
    return rows.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("original"))).drop("original")


def _urn(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), page_id.cast("string")))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))


def records(rows: DataFrame, date: str) -> DataFrame:
    """The text of each record without its end. rows: what resolved() gives, and payload (read only for responses)."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    kept = F.when(F.col("record_type") == "response", F.coalesce("payload", F.lit(""))).otherwise(F.lit(""))
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    block = F.concat(http, kept)
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    own = F.coalesce(_urn(F.col("page_id")), F.concat(F.lit("<urn:sha1:"), F.col("payload_digest"), F.lit(">")))
    is_revisit = F.col("record_type") == "revisit"
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", own),
        line("WARC-Date", F.lit(date)),
        optional("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(is_revisit, line("WARC-Profile", F.lit(REVISIT_PROFILE))).otherwise(F.lit("")),
        F.when(is_revisit, line("WARC-Refers-To", _urn(F.col("refers_to")))).otherwise(F.lit("")),
        optional("X-Page-Id", F.col("page_id").cast("string")),
        optional("X-Refers-To-Page-Id", F.col("refers_to").cast("string")),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, archive_mb: int = 16, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes compressed archives of about archive_mb of text under path. Only headers are shuffled to find copies;
    then each page's decision meets its payload once, by digest."""
    rows = described(pages, id_col, url_col, payload_col)
    first = saved(originals(rows.drop("payload"), min_bytes), "warc-originals")
    stored = first.agg(F.sum("bytes"), F.sum("copies")).first()
    mean = max(1, (stored[0] or 0) // max(1, stored[1] or 0))
    rows = resolved(rows, first.where("copies > 1"), min_bytes)
    # The tasks of the join write: the payloads are not dealt out once more.
    most = max(1, (archive_mb << 20) // mean)
    records(rows, date).write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def _parsed(stream):
    """Header and payload of each record of an open archive: no more than one record is in memory."""
    while stream.readline():
        head = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, value = line.decode().split(": ", 1)
            head[name] = value
        left, line = int(head["Content-Length"]), b""
        while line != b"\r\n":
            line = stream.readline()
            left -= len(line)
        yield head, stream.read(left)
        stream.read(len(RECORD_END))


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """RECORD rows of the archives under path; the digest and length of a response are those of the bytes found. A task
    holds a compressed file, one record of it, and rows with some PART_BYTES of payload."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to"] + ["payload"] * with_payload
    schema = ", ".join(x for x in RECORD.split(", ") if x.split()[0] in names)

    def read(batches):
        import gzip
        import io

        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}
        for batch in batches:
            for content in batch.column(0):
                rows, held = {n: [] for n in names}, 0

                def flush():
                    return pa.RecordBatch.from_arrays([pa.array(rows[n], kinds.get(n, pa.string())) for n in names], names=names)

                for head, payload in _parsed(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                    stored = head["WARC-Type"] == "response"
                    number = lambda name: int(head[name]) if name in head else None  # noqa: E731, B023
                    found = {"page_id": number("X-Page-Id"), "url": head.get("WARC-Target-URI"), "record_type": head["WARC-Type"], "refers_to": number("X-Refers-To-Page-Id")}
                    found["payload_digest"] = base64.b32encode(hashlib.sha1(payload).digest()).decode() if stored else head["WARC-Payload-Digest"].removeprefix("sha1:")
                    found["payload_bytes"] = len(payload) if stored else number("X-Payload-Length")
                    found["payload"] = payload.decode() if stored and with_payload else None
                    for n in names:
                        rows[n].append(found[n])
                    held += 200 + len(payload) * with_payload
                    if held >= PART_BYTES:
                        yield flush()
                        rows, held = {n: [] for n in names}, 0
                yield flush()

    return files.mapInArrow(read, schema)


def op9_warc_revisit(spark, sf_dir):
    path = f"{shared_dir(spark)}/coderake/warc-{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
         CAST(unhex(sha1(coalesce(html, ''))) AS BIT)::VARCHAR AS bits FROM pages
), d AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(16 * CAST(substr(bits, CAST(5 * i + 1 AS INT), 1) AS INT) + 8 * CAST(substr(bits, CAST(5 * i + 2 AS INT), 1) AS INT)
             + 4 * CAST(substr(bits, CAST(5 * i + 3 AS INT), 1) AS INT) + 2 * CAST(substr(bits, CAST(5 * i + 4 AS INT), 1) AS INT) + CAST(substr(bits, CAST(5 * i + 5 AS INT), 1) AS INT) AS INT), 1)), '') AS payload_digest
  FROM p
), g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM g
"""
