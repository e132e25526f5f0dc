"""WARC archives: one gzip member per record, written by the tasks that hold the records, and a
sequential reader that needs memory for one record and one read of compressed bytes.

Equal payloads of at least `min_bytes` are stored once: the record with the smallest id is a
`response`, the others are `revisit` records that name it. Smaller payloads are all responses.

The reader inflates member by member with zlib, frames each record by its Content-Length, checks
block and payload digests, and ends with an error at a record that is cut short or does not match.

Defined cases: a null html is an empty payload, a null url an empty target, a null id gives a record
without the id's header, read back as null (such a record is the response only where no other row
has its payload). Repeated rows of the smallest id are all responses. Empty tables give an archive folder without records. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from retailflow.llm.common import bounded_batches, mounted, renamed, written
from retailflow.session import run_dir

READ_BYTES = 256 << 10
ARCHIVE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    pass


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. With refers_to it is a revisit and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE),
        ("WARC-Target-URI", "".join(url.splitlines())),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", name(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


class _Members:
    """Inflated bytes of the gzip members of a file, read in steps."""

    def __init__(self, source: BinaryIO):
        self.source, self.rest, self.inflater = source, b"", None

    def begin(self) -> bool:
        """Goes to the next member, if there is one."""
        self.rest = self.rest or self.source.read(READ_BYTES)
        self.inflater = zlib.decompressobj(31) if self.rest else None
        return self.inflater is not None

    def read(self) -> bytes:
        """Some bytes, none at the end of the member."""
        while not self.inflater.eof:
            given = self.inflater.unconsumed_tail or self.rest or self.source.read(READ_BYTES)
            if not given:
                raise WarcError("the archive ends within a record")
            if not self.inflater.unconsumed_tail:
                self.rest = b""
            out = self.inflater.decompress(given, READ_BYTES)
            if self.inflater.eof:
                self.rest = self.inflater.unused_data + self.rest
            if out:
                return out
        return b""


def _headers(data: bytes) -> dict[str, str]:
    lines = data.decode().split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def read_records(source: BinaryIO) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """WARC headers, HTTP headers and payload of each record, in order."""
    members = _Members(source)
    while members.begin():
        data = bytearray()
        while (end := data.find(b"\r\n\r\n")) < 0:
            more = members.read()
            if not more:
                raise WarcError("a record has no end of headers")
            data += more
        if not data.startswith(b"WARC/1."):
            raise WarcError("a member does not begin with a WARC version")
        fields = _headers(bytes(data[:end]))
        del data[: end + 4]
        length = int(fields["content-length"])
        while more := members.read():
            data += more
            if len(data) > length + 4:
                raise WarcError("a record is longer than its Content-Length")
        if len(data) != length + 4 or data[length:] != b"\r\n\r\n":
            raise WarcError("a record is not as long as its Content-Length")
        block = bytes(data[:length])
        if fields["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
            raise WarcError(f"block digest of {fields['warc-record-id']}")
        http, _, payload = block.partition(b"\r\n\r\n")
        answer = _headers(http)
        if fields["warc-type"] == "response":
            if int(answer["content-length"]) != len(payload) or fields["warc-payload-digest"] != f"sha1:{sha1_base32(payload)}":
                raise WarcError(f"payload digest of {fields['warc-record-id']}")
        yield fields, answer, payload


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html and refers_to (null for responses) of every page."""
    pages = renamed(pages, ["page_id", "url", "html"])
    pages = pages.withColumn("digest", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    first = pages.where(F.octet_length(F.coalesce("html", F.lit(""))) >= min_bytes).groupBy("digest") \
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    first = written(first.where("n > 1 AND first_id IS NOT NULL").select(F.col("digest").alias("repeated"), "first_id"), "warc-repeated")
    rows = pages.join(first, F.col("digest") == F.col("repeated"), "left")
    return rows.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))


def write(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes an archive or several from each task, and returns path and records of each. A task that
    runs again writes the same names; an archive gets its name when it is whole."""
    bounded_batches(pages.sparkSession)
    place = mounted(folder)

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        os.makedirs(place, exist_ok=True)
        out, count, number = None, 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            os.replace(out.name, final := f"{place}/part-{context.partitionId():06d}-{number:04d}.warc.gz")
            return pa.RecordBatch.from_pydict({"path": [final], "records": [count]})

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c for c in batch.columns), strict=True):
                payload = (html.as_py() or "").encode()
                if out is None:
                    out, count = open(f"{place}/.part-{context.partitionId():06d}-{number:04d}.{context.taskAttemptId()}", "wb"), 0
                out.write(record(page_id.as_py(), url.as_py() or "", payload, sha1_base32(payload), refers_to.as_py()))
                count += 1
                if out.tell() >= archive_bytes:
                    yield close()
                    out, number = None, number + 1
        if out is not None:
            yield close()

    return revisits(pages, min_bytes).mapInArrow(archive, "path string, records long")


def read(archives: DataFrame) -> DataFrame:
    """A row for each record of the archives (column path): page_id, url, record_type, refers_to,
    payload_bytes, payload_digest, payload. Revisits give the full payload's length and digest, and no payload."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                with open(path, "rb") as source:
                    for fields, answer, payload in read_records(source):
                        number = lambda key, f=fields: int(f[key]) if key in f else None
                        rows.append((number("x-page-id"), fields["warc-target-uri"], fields["warc-type"], number("x-refers-to-page-id"),
                                     int(answer["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:"),
                                     payload if fields["warc-type"] == "response" else None))
                        size += len(payload)
                        if size >= 8 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    paths = archives.select("path")
    return paths.repartition(max(1, paths.count()), "path").mapInArrow(
        records, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes all pages into archives of the shared folder and reads every record back."""
    archives = written(write(pages, run_dir(pages.sparkSession, "warc"), min_bytes), "warc-archives")
    return read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """The archives of a folder that workers can open, as `path`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_replace(F.url_decode("path"), "^file:/*", "/").alias("path"))


__all__ = ["READ_BYTES", "WarcError", "listing", "read", "read_records", "record", "revisits", "round_trip", "write"]
