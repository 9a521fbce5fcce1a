"""WARC archives with an index: written in one pass, read by coalesced byte ranges.

Each task writes gzip members, one a record, to a file of its own in the shared folder and gives a row of
offset, length, URL and digest per record. The index counts; a file that a lost task left is in no row
of it. Readers sort the selected rows by place and fetch neighbours with one read.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch_path

INDEX = "file string, offset long, length long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads from this size on are stored once.
LEAST_BYTES = 100
#: One read spans at most this much, and skips at most that much between two records.
MOST_READ, MOST_GAP = 8 << 20, 64 << 10


def _open(uri: str, write: bool):
    if "://" not in uri or uri.startswith("file:"):
        path = "/" + uri.removeprefix("file:").lstrip("/")
        if write:
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb" if write else "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if write:
        store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None) if write else store.open_input_file(path)


def _record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    line = " ".join((url or "").split())
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {line}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(record: bytes) -> tuple[dict[str, str], bytes, dict[str, str]]:
    """Headers, payload and HTTP headers of one record without its compression."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:80]!r}")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(": "), "") for x in lines)
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("the record's length is not that of its block")
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, payload, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])


def write_archives(pages: DataFrame, folder: str | None = None, least: int = LEAST_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) and returns the index, a row per record.

    The payload is the html in UTF-8; null is empty. Of equal payloads of at least `least` bytes, records of
    the smallest page_id are responses and others revisit it, without their payload; smaller ones are all responses.
    Equal rows of the smallest page_id are all responses. Rows without page_id revisit one that has it; among
    themselves they are responses. Line breaks in a URL become blanks. An empty table gives an empty index.
    Other columns are not read.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    large = rows.filter(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    large = materialize(large.filter("n > 1").drop("n"), "warc_first")

    def write(batches):
        out, name, at = None, "", 0
        try:
            for batch in batches:
                found = []
                for page_id, url, html, digest, first in zip(*(batch.column(i) for i in range(5))):
                    page_id, url, payload, digest, first = page_id.as_py(), url.as_py(), html.as_py().encode(), digest.as_py(), first.as_py()
                    revisit = first is not None and first != page_id
                    member = _gzip(_record(page_id, url, payload, digest, first, revisit, date))
                    if out is None:
                        name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                        out = _open(name, True)
                    out.write(member)
                    found.append((name, at, len(member), page_id, url, len(payload), digest, "revisit" if revisit else "response", first if revisit else None))
                    at += len(member)
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                columns = list(zip(*found)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    joined = rows.join(large, "digest", "left").select(F.col("page_id").cast("long"), "url", "html", "digest", F.col("first").cast("long"))
    return materialize(joined.mapInArrow(write, INDEX), "warc_index")


def read_records(index: DataFrame, payload: bool = True) -> DataFrame:
    """Records that the rows of an index name: page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if wanted, payload.

    Bytes and digest are those of the full payload: of what is read for a response, as its headers tell for a
    revisit, whose payload is null. A response whose payload doesn't have the digest of its header is an error.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payload]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * payload]

    def records(places):
        """(record, page_id) of rows (file, offset, length, page_id)."""
        places, i = sorted(places, key=lambda x: x[:2]), 0
        handle, opened = None, None
        try:
            while i < len(places):
                name, begin, length, _ = places[i]
                j, end = i + 1, begin + length
                while j < len(places) and places[j][0] == name and places[j][1] - end <= MOST_GAP and places[j][1] + places[j][2] - begin <= MOST_READ:
                    end = max(end, places[j][1] + places[j][2])
                    j += 1
                if name != opened:
                    if handle:
                        handle.close()
                    handle, opened = _open(name, False), name
                handle.seek(begin)
                data = memoryview(handle.read(end - begin))
                for _, offset, length, page_id in places[i:j]:
                    yield zlib.decompress(data[offset - begin : offset - begin + length], 31), page_id
                i = j
        finally:
            if handle:
                handle.close()

    def row(record, page_id):
        headers, data, http = parse(record)
        digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha256:"), headers["WARC-Type"]
        revisit = kind == "revisit"
        if not revisit and hashlib.sha256(data).hexdigest() != digest:
            raise ValueError(f"page {page_id}: the payload doesn't have its digest")
        refers = int(headers["WARC-Refers-To"][len("<urn:page:") : -1]) if revisit else None
        return page_id, headers["WARC-Target-URI"], int(http["Content-Length"]) if revisit else len(data), digest, kind, refers, *[None if revisit else data] * payload

    def frame(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def read(batches):
        for batch in batches:
            rows, size = [], 0
            for record, page_id in records(list(zip(*(batch.column(i).to_pylist() for i in range(4))))):
                rows.append(row(record, page_id))
                size += len(record)
                if payload and size > 32 << 20:
                    yield frame(rows)
                    rows, size = [], 0
            if rows:
                yield frame(rows)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    return index.select("file", "offset", "length", "page_id").mapInArrow(read, schema)
