"""WARC archives of pages, and their records as a chunk table.

Writing: payloads travel as (record, chunk number, bytes) rows, so no task builds a whole record; each row goes straight
into a gzip member of the task's archive. Of equal payloads one record is a response, the others revisit it. Reading:
segments of archives are streamed, and every chunk row carries the digest of the payload up to and with that chunk.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dubflow.llm.common import join_classes, materialize, new_path, prepare, utf8

CHUNK_BYTES, SEGMENT_BYTES = 256 << 10, 32 << 20
#: Tasks that read a segment each; beyond, a task reads up to eight.
MOST_TASKS = 20_000
MANIFEST_DDL = "path string, start long, length long, records long"
CHUNK_DDL = (
    "record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
    "chunk_no int, chunk_start long, chunk_bytes int, chunk binary, digest_so_far string, last boolean"
)
ID = "urn:dubflow:page:"


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def filesystem(uri: str):
    """pyarrow's file system of a shared path, and the path inside it."""
    from pyarrow import fs as pafs

    return pafs.FileSystem.from_uri(uri) if ":" in uri else (pafs.LocalFileSystem(), uri)


def _header(row: dict) -> bytes:
    """WARC and HTTP headers of a record; the HTTP headers give the payload's length, of revisits too."""
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"] or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n_bytes']}\r\n\r\n".encode()
    name = "" if row["page_id"] is None else row["page_id"]
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{ID}{name}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{b32(row['sha1'])}"]
    if row["record_type"] == "revisit":
        refers = "" if row["refers_to"] is None else row["refers_to"]
        lines += [f"WARC-Refers-To: <{ID}{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    inside = row["n_bytes"] if row["record_type"] == "response" else 0
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + inside}", "", ""]
    return "\r\n".join(lines).encode() + http


def write_chunks(batches: Iterator[pa.RecordBatch], target: str, segment: int = SEGMENT_BYTES) -> Iterator[pa.RecordBatch]:
    """Writes chunk rows, ordered by record and chunk, into one archive; a manifest row for each segment of it."""
    files, root = filesystem(target)
    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
    out, member, at, begun, held, done = None, None, 0, 0, 0, []

    def put(data: bytes) -> None:
        nonlocal at
        out.write(data)
        at += len(data)

    for b in batches:
        for row in b.to_pylist():
            if out is None:
                files.create_dir(root, recursive=True)
                out = files.open_output_stream(path, compression=None)  # members are compressed here
            if row["chunk_no"] == 0:
                if at - begun >= segment:
                    done.append((path, begun, at - begun, held))
                    begun, held = at, 0
                member = zlib.compressobj(1, zlib.DEFLATED, 31)
                put(member.compress(_header(row)))
                held += 1
            put(member.compress(row["chunk"]))
            if row["chunk_no"] == row["chunks"] - 1:
                put(member.compress(b"\r\n\r\n") + member.flush())
    if out is not None:
        out.close()
        done.append((path, begun, at - begun, held))
        columns = zip(*done, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["path", "start", "length", "records"])


def chunked(pages: DataFrame, payload: str, size: int) -> DataFrame:
    """One row a chunk of the binary column: adds chunk_no, chunks, chunk."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(payload) / size)).cast("int")
    rows = pages.withColumn("chunks", n).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return rows.withColumn("chunk", F.substring(F.col(payload), F.col("chunk_no") * size + 1, F.lit(size))).drop(payload)


def write_archives(pages: DataFrame, min_bytes: int = 0, chunk: int = CHUNK_BYTES, segment: int = SEGMENT_BYTES) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html; null html: empty) and returns the manifest of segments.

    Of payloads of at least min_bytes that are equal, the row with the largest page_id is a response, the others are
    revisits of it; rows that repeat that page_id are responses each. A row without page_id is a response only if no
    equal payload has one. Smaller payloads are always responses. No rows: no archive, an empty manifest.
    """
    spark = pages.sparkSession
    prepare(spark)
    payload = utf8("html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("sha", F.unhex(F.sha2("payload", 256)))
    found = materialize(rows.groupBy("sha").agg(F.max("page_id").alias("keep_id"), F.count(F.lit(1)).alias("copies")), "payloads")
    total = found.agg(F.sum("copies")).first()[0] or 0
    marked = join_classes(rows, found, "sha", "copies", total, F.col("page_id")).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    first = F.col("page_id").eqNullSafe(F.col("keep_id")) | (F.col("n_bytes") < min_bytes)
    marked = marked.select(
        "page_id", "url", "n_bytes", F.unhex(F.sha1("payload")).alias("sha1"), F.when(first, "response").otherwise("revisit").alias("record_type"),
        F.when(~first, F.col("keep_id")).alias("refers_to"), F.when(first, F.col("payload")).otherwise(F.lit(b"")).alias("payload"),
    )
    target = new_path(spark, "warc")
    return materialize(chunked(marked, "payload", chunk).mapInArrow(lambda it: write_chunks(it, target, segment), MANIFEST_DDL), "manifest")


class _Members:
    """Reads the gzip members of a segment one after the other, a bounded piece at a time."""

    def __init__(self, file, length: int) -> None:
        self.file, self.left, self.raw, self.buf, self.z = file, length, b"", b"", None

    def more(self, want: int) -> bool:
        """Tries to have `want` plain bytes of the current member buffered."""
        while len(self.buf) < want and self.z is not None and not self.z.eof:
            if not self.raw:
                self.raw = self.file.read(min(self.left, 1 << 16))
                self.left -= len(self.raw)
                if not self.raw:
                    raise ValueError("archive ends inside a record")
            self.buf += self.z.decompress(self.raw, max(want, 1 << 16))
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        return len(self.buf) >= want

    def next_member(self) -> bool:
        if not self.raw and not self.left:
            return False
        self.buf, self.z = b"", zlib.decompressobj(31)
        return True

    def head(self) -> dict:
        while (end := self.buf.find(b"\r\n\r\n")) < 0:
            if not self.more(len(self.buf) + 1):
                raise ValueError("record without end of headers")
        lines, self.buf = self.buf[:end].decode().split("\r\n"), self.buf[end + 4 :]
        return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}

    def take(self, n: int) -> bytes:
        if not self.more(n):
            raise ValueError("record shorter than its Content-Length")
        out, self.buf = self.buf[:n], self.buf[n:]
        return out


def _id_of(urn: str | None) -> int | None:
    number = (urn or "").strip("<>")[len(ID) :]
    return int(number) if number else None


def _segment_chunks(path: str, start: int, length: int, files, chunk: int, payload: bool) -> Iterator[tuple]:
    with files.open_input_file(path) as f:
        f.seek(start)
        m = _Members(f, length)
        while m.next_member():
            warc = m.head()
            http = m.head()
            kind, declared = warc["warc-type"], int(http["content-length"])
            digest, at, no = hashlib.sha1(), 0, 0
            inside = declared if kind == "response" else 0
            while True:
                piece = m.take(min(chunk, inside - at))
                digest.update(piece)
                last = at + len(piece) == inside
                so_far = b32(digest.copy().digest())
                stated = warc["warc-payload-digest"].removeprefix("sha1:")
                if last and kind == "response" and so_far != stated:
                    raise ValueError(f"payload of {warc['warc-record-id']} has digest {so_far}, not {stated}")
                yield (warc["warc-record-id"].strip("<>"), _id_of(warc["warc-record-id"]), warc["warc-target-uri"], kind, _id_of(warc.get("warc-refers-to")), declared, stated, no, at, len(piece), piece if payload else None, so_far, last)
                at, no = at + len(piece), no + 1
                if last:
                    break
            m.take(4)
            m.more(1)


def read_chunks(manifest: DataFrame, root: str | None = None, chunk: int = CHUNK_BYTES, payload: bool = True) -> DataFrame:
    """The records of the segments as a chunk table, chunks in order; payload=False leaves the bytes out.

    digest_so_far is the SHA-1 of the payload up to this chunk; of a response's last chunk it must equal the stated one,
    else the read fails. payload_bytes and payload_digest of a revisit are those of the payload it stands for.
    """
    from dubflow.llm.common import shared_dir

    base = root or shared_dir(manifest.sparkSession)
    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.bool_())
    names = [x.split()[0] for x in CHUNK_DDL.split(", ")]

    def read(batches):
        files, _ = filesystem(base)
        rows, held = [], 0
        for b in batches:
            for s in b.to_pylist():
                for row in _segment_chunks(s["path"], s["start"], s["length"], files, chunk, payload):
                    rows.append(row)
                    held += 300 + (row[9] if payload else 0)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    n = manifest.count()  # about a task a segment, up to a number that the driver can plan
    return manifest.repartition(max(1, min(n, max(MOST_TASKS, n // 8)))).mapInArrow(read, CHUNK_DDL)


def warc_round_trip(pages: DataFrame, min_bytes: int = 0, chunk: int = CHUNK_BYTES, segment: int = SEGMENT_BYTES) -> DataFrame:
    """Writes the archives, reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to per record."""
    chunks = read_chunks(write_archives(pages, min_bytes, chunk, segment), chunk=chunk, payload=False)
    return chunks.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
