"""WARC archives: written from pages, read back as a table of payload chunks.

Writing: every task writes one gzip-per-record archive to the shared folder
under a temporary name, renames it when complete and returns one manifest row;
only archives in the manifest are read, so a lost or repeated task leaves no
wrong rows. Payloads are compressed chunk by chunk. Nothing in a record hangs on
the run that wrote it: the same rows in the same order are the same bytes.

Reading: records are decompressed in steps of CHUNK bytes and become rows
(record_id, chunk_no, data, length, digest), where length and digest are those of
the payload up to and with that chunk: an incremental digest travels along, and
no record is ever held whole. The row marked last holds the whole payload's.

Equal payloads of at least REVISIT_BYTES are stored once, as the response of the
smallest page_id; the others are revisit records that refer to its record by id
and target. A record's id follows from its page_id, payload and type.

Defined cases: a null html is an empty payload; a null url is an empty target;
control characters and spaces of a url are percent-encoded; rows that repeat the
smallest page_id of equal payloads are all responses, and records of repeated
rows are told apart within an archive by their number; a null page_id refers like
any other row and is read back as null; if all page_ids of equal payloads are
null, all are responses; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import itertools
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, new_path, save
from .packed import tidy

CHUNK = 1 << 20
REVISIT_BYTES = 100
#: A fixed date, so that records do not hang on the run.
DATE = "2024-01-01T00:00:00Z"
#: The HTTP head that precedes every payload within its record.
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _filesystem(path: str):
    return pafs.FileSystem.from_uri(path)


def record_id(page_id, digest: str, kind: str, again: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}:{kind}{again}')}>"


def _uri(url: str | None) -> str:
    """A header line holds the whole url: only what would end the line or the value is encoded."""
    return "".join(c if c.isprintable() and not c.isspace() else urllib.parse.quote(c, errors="replace") for c in url or "")


def record_head(page_id, url, kind: str, payload_bytes: int, digest: str, refers_to, refers_url, again: str = "") -> bytes:
    """The WARC header block of one record. again: tells records of repeated rows apart."""
    stored = len(HTTP_HEAD) + (payload_bytes if kind == "response" else 0)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id, digest, kind, again)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_uri(url)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Content-Length: {stored}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {payload_bytes}",
    ]
    if kind == "revisit":
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to, digest, 'response')}",
            f"WARC-Refers-To-Target-URI: {_uri(refers_url)}",
            f"X-Refers-To-Page-Id: {refers_to}",
        ]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def write_record(out, head: bytes, payload: Iterator[bytes]) -> int:
    """One gzip member: head, HTTP head, payload and the closing lines. Returns its compressed bytes."""
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    size = 0
    for piece in itertools.chain((head, HTTP_HEAD), payload, (b"\r\n\r\n",)):
        if data := squeeze.compress(piece):
            size += out.write(data) or len(data)
    data = squeeze.flush()
    out.write(data)
    return size + len(data)


def _pieces(text: str | None) -> Iterator[bytes]:
    text = text or ""
    for at in range(0, len(text), CHUNK // 4):
        yield text[at : at + CHUNK // 4].encode()


def write(pages: DataFrame) -> DataFrame:
    """Write archives; returns the manifest (path, records, bytes), itself a table in the shared folder."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("size"), F.sha2(html.cast("binary"), 256).alias("digest"))
    groups = full.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.min_by("url", F.struct("page_id", "url")).alias("first_url"), F.count("*").alias("n"))
    groups = save(groups.where("n > 1").select(F.col("digest").alias("_d"), "first", "first_url"), "warc-equal")
    full = full.join(groups, F.col("digest") == F.col("_d"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("kind")
    rows = full.select("page_id", "url", "size", "digest", kind, F.when(revisit, F.col("first")).alias("refers_to"), F.when(revisit, F.col("first_url")).alias("refers_url"), F.when(~revisit, F.col("html")).alias("html"))

    def run(batches):
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        # attempts write apart from each other and end as the same archive
        name, part = f"{root}/{task.partitionId():06d}.warc.gz", f"{root}/{task.partitionId():06d}.{task.taskAttemptId()}.part"
        n = size = 0
        out, seen = None, set()
        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, length, digest, kind, refers_to, refers_url, text = (batch.column(c)[k].as_py() for c in range(8))
                if out is None:
                    out = fs.open_output_stream(part, compression=None)
                key = hash((page_id, digest, kind))
                head = record_head(page_id, url, kind, length, digest, refers_to, refers_url, f"#{n}" if key in seen else "")
                seen.add(key)
                size += write_record(out, head, _pieces(text) if kind == "response" else ())
                n += 1
        if out is not None:
            out.close()
            fs.move(part, name)
            scheme = folder.split("://")[0] + "://" if "://" in folder else ""
            host = folder[len(scheme) : folder.index(root)] if scheme else ""
            yield pa.RecordBatch.from_arrays([pa.array([f"{scheme}{host}{name}"]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

    return save(bounded(rows).mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def read_records(stream) -> Iterator[tuple[dict, Iterator[bytes]]]:
    """(headers, payload pieces) of each record of a decompressed archive, pieces of at most CHUNK bytes."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            key, _, value = line.decode().partition(":")
            headers[key.lower()] = value.strip()
        left = int(headers["content-length"])
        while left:  # the HTTP head within the record
            line = stream.readline()
            left -= len(line)
            if not line.strip():
                break
        headers["payload-length"] = left

        def payload(left=left):
            while left:
                piece = stream.read(min(CHUNK, left))
                if not piece:
                    raise EOFError("the archive ends within a record")
                left -= len(piece)
                yield piece

        pieces = payload()
        yield headers, pieces
        for _ in pieces:  # skip what the caller left
            pass


_CHUNKS = "record_id string, page_id long, url string, record_type string, refers_to long, payload_length long, payload_digest string, chunk_no long, data binary, length long, digest string, last boolean"


def read(manifest: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunk table of all archives of a manifest."""
    names = [x.split()[0] for x in _CHUNKS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, name = _filesystem(path)
                with fs.open_input_stream(name, compression=None) as raw, gzip.GzipFile(fileobj=io.BufferedReader(_Raw(raw), CHUNK)) as stream:
                    for headers, pieces in read_records(stream):
                        number = lambda key: int(headers[key]) if headers.get(key) else None
                        base = (headers["warc-record-id"], number("x-page-id"), headers["warc-target-uri"], headers["warc-type"], number("x-refers-to-page-id"), number("x-payload-length"), headers["warc-payload-digest"].removeprefix("sha256:"))
                        running, length, k = hashlib.sha256(), 0, 0
                        total = headers["payload-length"]
                        for piece in pieces if total else iter([b""]):
                            running.update(piece)
                            length += len(piece)
                            rows.append((*base, k, piece if with_data else None, length, running.copy().hexdigest(), length == total))
                            held += len(piece) if with_data else 0
                            k += 1
                            if len(rows) >= 4096 or held >= 4 * CHUNK:
                                yield batch_of(rows)
                                rows, held = [], 0
        if rows:
            yield batch_of(rows)
        tidy()

    # a manifest row is an archive, and each is a task's work: a stated number of partitions is not coalesced
    archives = manifest.count()
    return bounded(manifest).select("path").repartition(max(1, archives)).mapInArrow(run, _CHUNKS)


class _Raw(io.RawIOBase):
    """A pyarrow input stream as a raw Python stream."""

    def __init__(self, stream):
        self._stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self._stream.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def op4_warc(pages: DataFrame) -> DataFrame:
    """Contract query: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's length and digest are those computed while reading its chunks; a
    revisit has no payload of its own and carries those its header states.
    """
    last = read(write(pages), with_data=False).where("last")
    response = F.col("record_type") == "response"
    return last.select(
        "page_id",
        F.when(response, F.col("length")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.col("digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS n, sha256(h) AS s FROM p),
f AS (SELECT s, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY s)
SELECT page_id, n AS payload_bytes, d.s AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f ON d.s = f.s
"""
