"""Deterministic sharded WARC writer and reader.

Records are dealt to shards by page id and sorted in them; a file rolls over
at a compressed size; every record is a gzip member of its own with
regenerated headers: block and payload digests, lengths, and record ids that
depend on the record alone.  Of equal payloads of at least 100 bytes the
smallest page id is a response, the others are revisits that refer to it.
Files are committed as ``files`` describes.

Defined results: null html is an empty payload; a null url is written as
``urn:unknown``; control characters and blanks in a url are
percent-encoded; rows that repeat the smallest page id of a payload are all
responses; a row without a page id is a revisit where its payload has an id.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cagetrace.llm import files
from cagetrace.llm.store import open_fs, stage

SHARD_BYTES, ROLL_BYTES, LEAST_PAYLOAD = 256 << 20, 64 << 20, 100
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f-\xa0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "urn:unknown"


def _record_id(page_id, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}').urn}>"


def record(page_id, url, html, digest, first, date: str = DATE) -> bytes:
    """One gzip member."""
    payload = (html or "").encode()
    revisit = first is not None and first != page_id
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest)}",
             f"WARC-Date: {date}", f"WARC-Target-URI: {_uri(url)}", "Content-Type: application/http;msgtype=response",
             f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(first, digest)}", f"X-Refers-To-Page-ID: {first}"]
    lines += [f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to); checks lengths and digests."""
    head, _, rest = member.partition(b"\r\n\r\n")
    h = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    n = int(h["Content-Length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n" or f"sha256:{hashlib.sha256(block).hexdigest()}" != h["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {h['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
    if h["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload {h['WARC-Record-ID']}")
    ids = [int(h[k]) if k in h else None for k in ("X-Page-ID", "X-Refers-To-Page-ID")]
    return ids[0], size, digest, h["WARC-Type"], ids[1]


def write_archives(pages: DataFrame, folder: str, date: str = DATE) -> DataFrame:
    """Write *pages* (page_id, url, html) below *folder*; the manifest."""
    html = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", "html", F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("size"))
    big = pages.where(F.col("size") >= LEAST_PAYLOAD)
    firsts = stage(big.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
                   .select("digest", "first"), "firsts")
    pages = files.with_shards(pages, "page_id", F.col("size") + 512, SHARD_BYTES).join(firsts, "digest", "left")

    def make():
        def one(page_id, url, html, digest, first):
            return record(page_id, url, html, digest, first, date), 1
        return one

    return files.write_files(pages, ["page_id", "url", "digest"], ["page_id", "url", "html", "digest", "first"], folder, ".warc.gz", make, ROLL_BYTES)


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives."""
    def run(batches):
        fs, root = open_fs(folder)

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))],
                                              names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        for b in batches:
            for name in b.column("name").to_pylist():
                rows = []
                with fs.open_input_stream(f"{root}/{name}") as f:
                    data, z, got = b"", zlib.decompressobj(31), []
                    while data or (data := f.read(1 << 20)):
                        got.append(z.decompress(data))
                        data = z.unused_data
                        if z.eof:
                            rows.append(parse(b"".join(got)))
                            z, got = zlib.decompressobj(31), []
                        if len(rows) >= 1000:
                            yield out(rows)
                            rows = []
                    if any(got):
                        raise ValueError(f"{name} ends inside a record")
                if rows:
                    yield out(rows)
    return files.spread(manifest.select("name")).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write *pages* to a new shared folder and read the archives back."""
    folder = files.new_folder(pages, "warc")
    return read_archives(write_archives(pages, folder), folder)
