"""WARC archives as chunked record tables.

A payload is one value of its page's row; from there on it travels as rows (record, chunk
number, bytes) of at most CHUNK bytes, so neither writer nor reader holds a whole oversized
record: the writer streams chunk rows into gzip members (one a record) and the reader
streams them out again, each chunk row carrying the size and SHA-1 of the payload so far.  Archives are written under
temporary names in the shared folder and renamed when whole, so a repeated task
replaces its own file.

Of records with equal payloads of at least min_bytes bytes, that with the largest
page_id is the response; others are revisits that refer to it and carry only headers.

Defined results: null html is an empty payload; a null page_id is smaller than any
other and refers_to of its copies, should only such exist, is null; rows that repeat the
largest page_id with the same payload are all responses; a null url is left out; extra
columns are ignored; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_side, stage_path, staged

CHUNK = 256 << 10
#: Revisits, of some 70 bytes each, up to which they are broadcast.
REVISITS = 200_000
DATE = "2020-01-01T00:00:00Z"
URN = "urn:gaugeline:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def verdicts(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, sha1, best) of the revisits: pages(page_id, sha1, size) whose payload the larger page_id best has too."""
    many = pages.where(F.col("size") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1 and best is not null")
    return pages.join(many, "sha1").where(~F.col("page_id").eqNullSafe(F.col("best"))).select("page_id", "sha1", "best").distinct()


def records(pages: DataFrame, min_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Chunk rows (page_id, url, record_type, refers_to, sha1, size, chunk_no, chunk).

    Digests alone are grouped; of the revisits, up to REVISITS are broadcast, so payloads stay where they were read.
    More revisits meet their pages by (page_id, digest), of which no value is common."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("body"))
    p = p.select("page_id", "url", "body", F.sha1("body").alias("sha1"), F.octet_length("body").cast("long").alias("size"))
    found = small_side(staged(verdicts(p.select("page_id", "sha1", "size"), min_bytes).toDF("id", "digest", "best"), "warc-revisits"), REVISITS)
    p = p.join(found, (p["sha1"] == found["digest"]) & p["page_id"].eqNullSafe(found["id"]), "left")
    again = F.col("best").isNotNull()
    p = p.select(
        "page_id", "url", F.when(again, "revisit").otherwise("response").alias("record_type"), F.col("best").alias("refers_to"), "sha1", "size",
        F.when(again, F.lit(b"")).otherwise(F.col("body")).alias("body"),
    )
    last = F.greatest(F.lit(0), F.floor((F.octet_length("body") - 1) / chunk)).cast("int")
    p = p.select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    return p.select("page_id", "url", "record_type", "refers_to", "sha1", "size", "chunk_no", F.substring("body", F.col("chunk_no") * chunk + 1, F.lit(chunk)).alias("chunk"))


def base32(hexa: str) -> str:
    return base64.b32encode(bytes.fromhex(hexa)).decode()


def head_of(page, url, kind, to, sha1, size) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{URN}{'null' if page is None else page}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <{URN}{to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{base32(sha1)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (size if kind == 'response' else 0)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


def writer(folder: str):
    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        temp, name = f"{base}/.{part}-{uuid.uuid4().hex}.tmp", f"part-{part:05d}.warc.gz"
        out, left, n, total = None, 0, 0, 0
        for b in batches:
            for page, url, kind, to, sha1, size, no, chunk in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    out = store.open_output_stream(temp)
                if no == 0:
                    gz, digest, left = zlib.compressobj(6, wbits=31), hashlib.sha1(), size if kind == "response" else 0
                    total += out.write(gz.compress(head_of(page, url, kind, to, sha1, size)))
                digest.update(chunk)
                left -= len(chunk)
                total += out.write(gz.compress(chunk))
                if left == 0:
                    if kind == "response" and digest.hexdigest() != sha1:
                        raise ValueError(f"payload of page {page} changed on its way")
                    total += out.write(gz.compress(b"\r\n\r\n") + gz.flush())
                    n += 1
        if out is not None:
            out.close()
            store.move(temp, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{name}"]), pa.array([n], pa.int64()), pa.array([total or 0], pa.int64())], names=["path", "n_records", "n_bytes"])

    return run


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Writes one archive a partition into folder; the manifest (path, n_records, n_bytes)."""
    return staged(records(pages, min_bytes, chunk).mapInArrow(writer(folder), "path string, n_records long, n_bytes long"), "warc-manifest")


class Reader:
    """Streams (headers, payload chunk, last) from a gzip-per-record archive."""

    def __init__(self, stream, chunk: int):
        self.stream, self.chunk = stream, chunk
        self.raw, self.buf, self.gz = b"", b"", zlib.decompressobj(31)

    def more(self) -> bool:
        while True:
            if self.gz.eof:
                self.raw, self.gz = self.gz.unused_data, zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.stream.read(self.chunk)
                if not self.raw:
                    return False
            got = self.gz.decompress(self.raw, self.chunk)
            self.raw = self.gz.unconsumed_tail
            if got:
                self.buf += got
                return True

    def head(self) -> dict[str, str] | None:
        while (end := self.buf.find(b"\r\n\r\n")) < 0:
            if not self.more():
                return None
        lines, self.buf = self.buf[:end].decode().split("\r\n"), self.buf[end + 4 :]
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])} | {"": lines[0]}

    def take(self, n: int):
        while n:
            if not self.buf and not self.more():
                raise EOFError("archive ends inside a record")
            part = self.buf[: min(n, self.chunk)]
            self.buf = self.buf[len(part) :]
            n -= len(part)
            yield part

    def __iter__(self):
        while (warc := self.head()) is not None:
            size = int(warc["content-length"])
            http, left = {}, size
            if "application/http" in warc.get("content-type", ""):
                http = self.head_counted()
                left = size - self.counted
            if not left:
                yield warc, http, b"", True
            for part in self.take(left):
                left -= len(part)
                yield warc, http, part, left == 0
            for _ in self.take(4):
                pass

    def head_counted(self) -> dict[str, str]:
        while (end := self.buf.find(b"\r\n\r\n")) < 0:
            if not self.more():
                raise EOFError("archive ends inside a record")
        self.counted = end + 4
        return self.head()


def reader(chunk: int, payloads: bool):
    def run(batches):
        from pyarrow import fs

        names = ["page_id", "record_type", "refers_to", "chunk_no", "last", "payload_bytes", "payload_digest", *["chunk"] * payloads]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), *[pa.binary()] * payloads]

        def number(x: str | None):
            x = (x or "").strip("<>").removeprefix(URN)
            return None if x in ("", "null") else int(x)

        for b in batches:
            for path in b.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                rows, size, no, digest, held = [], 0, 0, hashlib.sha1(), 0
                with store.open_input_stream(name, compression=None) as stream:
                    for warc, http, part, last in Reader(stream, chunk):
                        kind, said = warc["warc-type"], warc["warc-payload-digest"].removeprefix("sha1:")
                        digest.update(part)
                        size += len(part)
                        now = base64.b32encode(digest.digest()).decode() if kind == "response" else said
                        if last and now != said:
                            raise ValueError(f"{path}: payload digest of {warc['warc-record-id']} differs")
                        so_far = size if kind == "response" else int(http["content-length"])
                        rows.append((number(warc["warc-record-id"]), kind, number(warc.get("warc-refers-to")), no, last, so_far, now, *[part] * payloads))
                        held += len(part) * payloads + 100
                        no += 1
                        if last:
                            size, no, digest = 0, 0, hashlib.sha1()
                        if held > 16 * chunk:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def read_archives(manifest: DataFrame, chunk: int = CHUNK, payloads: bool = True) -> DataFrame:
    """Chunk rows (page_id, record_type, refers_to, chunk_no, last, payload_bytes, payload_digest[, chunk]):
    bytes and digest of the payload up to and with this chunk, of the full one in a row with last."""
    schema = "page_id long, record_type string, refers_to long, chunk_no int, last boolean, payload_bytes long, payload_digest string" + ", chunk binary" * payloads
    paths = manifest.select("path")
    return paths.repartition(max(1, paths.count()), "path").mapInArrow(reader(chunk, payloads), schema)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), read back from the archives written."""
    spark = pages.sparkSession
    manifest = write_archives(pages, stage_path(spark, "warc"), min_bytes)
    return read_archives(manifest, payloads=False).where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
