"""WARC archives written by tasks and read back as a chunked record table: record and chunk number, with a running digest."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, scratch, written

PIECE = 256 << 10
#: Rows of the table of repeated payloads up to which it is broadcast (about 100 bytes each); a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000
URN = "urn:page:"


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def deduplicated(df: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Adds payload_bytes, payload_digest (SHA-1 of the html's UTF-8), record_type and refers_to.

    Of rows with equal payloads of at least least_bytes the one with the largest page_id is the response and the others revisit it. Rows that
    share that largest page_id are all responses; a null page_id revisits if it can; null html is an empty payload.
    """
    rows = df.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha1(F.col("html").cast("binary"))})
    repeated = written(rows.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).filter("n > 1 AND head IS NOT NULL").drop("n"), "payloads")
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    head = F.col("head")
    return rows.join(repeated, "payload_digest", "left").select(
        *rows.columns, F.when(head.isNull() | (F.col("page_id") == head), "response").otherwise("revisit").alias("record_type"), F.when(head.isNotNull() & ~F.col("page_id").eqNullSafe(head), head).alias("refers_to")
    )


def _headers(kind: str, page, url, digest: str, refers, block: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{URN}{'' if page is None else page}>", f"WARC-Date: {datetime.now(UTC):%Y-%m-%dT%H:%M:%SZ}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {block}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{URN}{refers}>"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def write_warc(records: DataFrame, group_bytes: int = 8 << 20) -> DataFrame:
    """Writes one gzipped WARC file per task into the shared folder; returns the written index of record groups (path, at, size, records).

    Each record is a gzip member of its own, so an index row names a byte range that can be read alone. A payload is compressed piece by
    piece. A task that runs again writes another file, and only the finished attempt's file is in the index.
    """
    spark = records.sparkSession
    bounded(spark)
    folder = scratch(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        context, out, at, first, count, path = TaskContext.get(), None, 0, 0, 0, ""
        found: list[tuple] = []
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(len(batch)):
                if out is None:
                    store.create_dir(root, recursive=True)
                    path = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.warc.gz"
                    out = store.open_output_stream(f"{root}/{path}", compression=None)
                kind, payload = col["record_type"][i].as_py(), col["html"][i].as_buffer()
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload.size}\r\n\r\n".encode()
                body = memoryview(payload) if kind == "response" else memoryview(b"")
                head = _headers(kind, col["page_id"][i].as_py(), col["url"][i].as_py(), col["payload_digest"][i].as_py(), col["refers_to"][i].as_py(), len(http) + len(body))
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                for piece in (head, http, *(body[k : k + PIECE] for k in range(0, len(body), PIECE)), b"\r\n\r\n"):
                    if packed := z.compress(piece):
                        out.write(packed)
                        at += len(packed)
                packed = z.flush()
                out.write(packed)
                at, count = at + len(packed), count + 1
                if at - first >= group_bytes:
                    found.append((f"{folder}/{path}", first, at - first, count))
                    first, count = at, 0
        if out is not None:
            out.close()
            if count:
                found.append((f"{folder}/{path}", first, at - first, count))
        if found:
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "at", "size", "records"), x, strict=True)) for x in found], pa.schema([("path", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("records", pa.int64())]))

    columns = ["page_id", "url", "html", "payload_digest", "record_type", "refers_to"]
    return written(records.select(*columns).mapInArrow(run, "path string, at long, size long, records long"), "warc-index")


class _Stream:
    """Bytes of consecutive gzip members in a range of a file, unpacked as they are asked for."""

    def __init__(self, file, at: int, size: int):
        self.file, self.left, self.z, self.packed, self.plain = file, size, zlib.decompressobj(31), b"", bytearray()
        file.seek(at)

    def more(self) -> bool:
        """Unpacks another piece; False at the end."""
        while True:
            if not self.packed:
                self.packed = self.file.read(min(PIECE, self.left))
                self.left -= len(self.packed)
                if not self.packed:
                    return False
            got = self.z.decompress(self.packed, PIECE)
            self.packed = self.z.unconsumed_tail
            if self.z.eof:
                self.packed, self.z = self.z.unused_data, zlib.decompressobj(31)
            if got:
                self.plain += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (i := self.plain.find(mark, start)) < 0:
            start = max(0, len(self.plain) - len(mark))
            if not self.more():
                return None
        got = bytes(self.plain[:i])
        del self.plain[: i + len(mark)]
        return got

    def some(self, most: int) -> bytes:
        if not self.plain and not self.more():
            raise ValueError("the archive ends within a record")
        got = bytes(self.plain[:most])
        del self.plain[:most]
        return got


def _fields(block: bytes) -> dict[str, str]:
    return {k.lower(): v.removeprefix(" ") for k, _, v in (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n")[1:])}


CHUNKS = "page_id long, url string, record_type string, refers_to long, header_digest string, declared_bytes long, chunk_no long, chunk_bytes long, bytes_so_far long, sha1_so_far string, last boolean"


def read_warc(index: DataFrame, chunk_bytes: int = 1 << 20, data: bool = True) -> DataFrame:
    """The chunked record table of the archives in an index: a row per record and chunk of its payload (at least one, if empty).

    bytes_so_far and sha1_so_far run over the payload up to this chunk; the row with last true has the whole payload's. No record is ever
    held whole: memory stays at about a chunk. declared_bytes and header_digest are what the headers say, also for revisits.
    """
    names = ["page_id", "url", "record_type", "refers_to", "header_digest", "declared_bytes", "chunk_no", "chunk_bytes", "bytes_so_far", "sha1_so_far", "last"] + ["data"] * data
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()] + [pa.binary()] * data
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    urn = lambda x: int(n) if x and (n := x.strip("<>").removeprefix(URN)) else None

    def chunks(path: str, at: int, size: int) -> Iterator[tuple]:
        store, name = _store(path)
        with store.open_input_file(name) as file:
            s = _Stream(file, at, size)
            while (block := s.until(b"\r\n\r\n")) is not None:
                h = _fields(block)
                http = s.until(b"\r\n\r\n")
                inner = _fields(http or b"")
                left = int(h["content-length"]) - len(http) - 4
                sha, so_far, number = hashlib.sha1(), 0, 0
                base = (urn(h["warc-record-id"]), h.get("warc-target-uri"), h["warc-type"], urn(h.get("warc-refers-to")), h["warc-payload-digest"].removeprefix("sha1:"), int(inner["content-length"]))
                while True:
                    piece = bytearray()
                    while left and len(piece) < chunk_bytes:
                        got = s.some(min(left, chunk_bytes - len(piece)))
                        piece += got
                        left -= len(got)
                    sha.update(piece)
                    so_far += len(piece)
                    yield (*base, number, len(piece), so_far, sha.hexdigest(), not left, *([bytes(piece)] if data else []))
                    number += 1
                    if not left:
                        break
                if s.until(b"\r\n\r\n") != b"":
                    raise ValueError(f"{path}: a record of {h['warc-record-id']} does not end where it says")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(held: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], schema)

        for batch in batches:
            for row in batch.to_pylist():
                held, size = [], 0
                for c in chunks(row["path"], row["at"], row["size"]):
                    held.append(c)
                    size += 200 + (c[7] if data else 0)
                    if size >= 4 << 20:
                        yield table(held)
                        held, size = [], 0
                if held:
                    yield table(held)

    spread = index.select("path", "at", "size").repartition(max(1, index.sparkSession.sparkContext.defaultParallelism * 4), "path", "at")
    return spread.mapInArrow(run, CHUNKS + (", data binary" if data else ""))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back; the last chunk of a record has its whole payload's size and digest."""
    index = write_warc(deduplicated(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    whole = read_warc(index, data=False).filter("last")
    revisit = F.col("record_type") == "revisit"
    return whole.select(
        "page_id", F.when(revisit, F.col("declared_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"), F.when(revisit, F.col("header_digest")).otherwise(F.col("sha1_so_far")).alias("payload_digest"), "record_type", "refers_to"
    )


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest FROM p),
h AS (SELECT payload_digest, max(page_id) AS head FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN head IS NULL OR head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN head <> page_id THEN head END AS refers_to
FROM d LEFT JOIN h USING (payload_digest)
"""
