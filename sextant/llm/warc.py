"""WARC archives: writing, reading, and revisit resolution.

Headers (id, digest, length) are grouped by payload digest; of each digest that
occurs more than once the smallest id is the original, and the others become
revisit records that refer to it.  Payloads never move for that: only where too
many records are revisits to broadcast their ids do the rows shuffle by id.
Tasks write one archive each, a gzip member for each record, and list it in a
manifest; the archives that the manifest lists are what is read back.

Defined cases: a null html is an empty payload, a null url an empty target;
payloads under ``least`` bytes are all responses; repeated rows of one id and
payload are all responses if that id is the smallest; a row without an id is
never an original that others refer to; an empty table makes no archive;
further columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.base import join_sized, scratch, table, written
from sextant.llm.files import attempt_name, place

#: Payloads of fewer bytes are not worth a revisit record.
LEAST_BYTES = 100
#: Copies of each original in the join by digest, for digests that are everywhere.
SALT = 16
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def headers(pages: DataFrame, id_col: str = "page_id", body_col: str = "html") -> DataFrame:
    """page_id, payload_bytes, payload_digest of each page."""
    body = F.coalesce(F.encode(F.col(body_col), "UTF-8"), F.lit(b""))
    return pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.octet_length(body).cast("bigint").alias("payload_bytes"), F.sha2(body, 256).alias("payload_digest"))


def revisits(heads: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, payload_digest, refers_to of the records that are revisits."""
    large = heads.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
    originals = large.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    spread = originals.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))))
    salted = large.select("page_id", "payload_digest", F.pmod(F.xxhash64("page_id"), F.lit(SALT)).alias("salt"))
    return salted.join(spread, ["payload_digest", "salt"]).where("page_id <> refers_to").select("page_id", "payload_digest", "refers_to").distinct()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, now: str) -> bytes:
    """One record, with fresh headers."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    lines = [
        VERSION,
        b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
        f"WARC-Record-ID: {record_id(page_id, digest)}".encode(),
        f"WARC-Date: {now}".encode(),
        f"WARC-Target-URI: {target}".encode(),
        f"WARC-Payload-Digest: sha256:{digest}".encode(),
        b"Content-Type: application/http;msgtype=response",
        b"Page-ID: %s" % (b"" if page_id is None else str(page_id).encode()),
    ]
    if refers_to is not None:
        lines += [b"WARC-Profile: " + PROFILE, f"WARC-Refers-To: {record_id(refers_to, digest)}".encode(), b"Refers-To-Page-ID: %d" % refers_to]
    return b"\r\n".join([*lines, b"Content-Length: %d" % len(block), b"", b""]) + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive."""
    while line := stream.readline():
        if line != VERSION + b"\r\n":
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()) != b"\r\n":
            name, _, value = line.decode().partition(":")
            head[name.lower()] = value.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError("an archive is cut off")
        yield head, block


def write(pages: DataFrame, found: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Archives of ``pages``, with the records in ``found`` (see ``revisits``) as
    revisits; the manifest: file, n_records."""
    body = F.coalesce(F.encode(F.col(body_col), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), body.alias("payload"), F.sha2(body, 256).alias("payload_digest"))
    rows = join_sized(rows, found, ["page_id", "payload_digest"], "left").select("page_id", "url", "payload", "payload_digest", "refers_to")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = place(folder)
        name, n, out = attempt_name("pages", ".warc.gz"), 0, None
        now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        for batch in batches:
            if batch.num_rows and out is None:
                store.create_dir(path)
                out = store.open_output_stream(f"{path}/{name}", compression=None)
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.write(member(record(*row, now)))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "n_records": [n]})

    return written(rows.mapInArrow(go, "file string, n_records bigint"), "manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """``RECORD`` of every record of the archives that the manifest lists.  The
    payload of each response is hashed again and must have its digest."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = place(folder)
        for batch in batches:
            for file, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                with store.open_input_stream(f"{path}/{file}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for head, block in records(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
                        digest = head["warc-payload-digest"].removeprefix("sha256:")
                        if head["warc-type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                            raise ValueError(f"{file}: a payload does not have its digest")
                        number = lambda k, head=head: int(head[k]) if head.get(k) else None
                        rows.append((number("page-id"), head["warc-target-uri"], size, digest, head["warc-type"], number("refers-to-page-id")))
                if len(rows) != n:
                    raise ValueError(f"{file}: {len(rows)} records, {n} listed")
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    files = manifest.select("file", "n_records")
    return files.repartition(max(8, min(4096, files.count())), "file").mapInArrow(go, RECORD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract ``op3``: whole ``pages``."""
    pages = table(spark, sf_dir, "pages")
    found = written(revisits(headers(pages)), "revisits")
    folder = scratch(spark, "warc")
    manifest = write(pages, found, folder)
    return read(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
o AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN o.first IS NULL OR o.first = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN o.first <> p.page_id THEN o.first END AS refers_to
FROM p LEFT JOIN o ON p.d = o.d AND p.n >= 100
"""
