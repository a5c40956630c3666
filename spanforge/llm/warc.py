"""WARC archives as seekable Zstandard bundles, with an index from record identifiers to places inside frames.

A bundle is a run of independent Zstandard frames, each of whole WARC records, and a seek table in a skippable frame at its
end (the published seekable format). A reader finds a frame from the table and a record at its offset inside the frame's
content, and decompresses nothing else.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm._shared import fresh_path, small_batches, table, written
from spanforge.llm.rawfiles import read_files, read_stretches, write_files

#: Payloads of fewer bytes are never revisits.
LEAST_SHARED = 100
#: Bytes of records in a frame, and of compressed frames in a bundle, at least.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 8 << 20

# Fixed values of the seekable format.
SKIPPABLE, TRAILER = 0x184D2A5E, struct.pack("<I", 0x8F92EAB1)
#: Bytes at the end of a bundle that say how many frames its seek table has.
FOOT = 9
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"


def record_id(page: int | None, digest: str) -> str:
    x = hashlib.sha256(f"{page}:{digest}".encode()).hexdigest()
    return f"urn:uuid:{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:32]}"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit of the page refers_to, whose payload is left out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id(page, digest)}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    lines += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page is not None:
        lines.append(f"X-Page-ID: {page}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{record_id(refers_to, digest)}>", f"WARC-Profile: {_PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Bundle:
    """Frames being gathered for one file."""

    def __init__(self) -> None:
        self.frames: list[bytes] = []
        self.table: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.open_bytes = self.bytes = 0

    def add(self, data: bytes) -> None:
        self.open.append(data)
        self.open_bytes += len(data)
        if self.open_bytes >= FRAME_BYTES:
            self.close()

    def close(self) -> None:
        if self.open:
            frame = zstandard.ZstdCompressor(level=3).compress(b"".join(self.open))
            self.frames.append(frame)
            self.table.append((len(frame), self.open_bytes))
            self.bytes += len(frame)
            self.open, self.open_bytes = [], 0

    def body(self) -> bytes:
        """The bundle without the last four bytes (TRAILER)."""
        self.close()
        entries = b"".join(struct.pack("<II", *x) for x in self.table)
        return b"".join([*self.frames, struct.pack("<II", SKIPPABLE, len(entries) + 9), entries, struct.pack("<IB", len(self.frames), 0)])


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed bytes, content bytes) of each frame."""
    if bundle[-4:] != TRAILER:
        raise ValueError("no whole bundle")
    n, flags = struct.unpack_from("<IB", bundle, len(bundle) - 9)
    width = 12 if flags & 0x80 else 8
    at, out = 0, []
    for k in range(n):
        packed, content = struct.unpack_from("<II", bundle, len(bundle) - 9 - width * (n - k))
        out.append((at, packed, content))
        at += packed
    return out


def frame(bundle: bytes, place: tuple[int, int, int]) -> bytes:
    start, packed, content = place
    return zstandard.ZstdDecompressor().decompress(bundle[start : start + packed], max_output_size=content)


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The headers and block of the record at a place in a frame's content, and the place after it."""
    stop = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:stop].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("no WARC record")
    headers = dict(x.split(": ", 1) for x in lines)
    end = stop + 4 + int(headers["Content-Length"])
    return headers, data[stop + 4 : end], end + 4


def payload_of(block: bytes) -> bytes:
    return block[block.index(b"\r\n\r\n") + 4 :]


def revisits(pages: DataFrame, id: str = "page_id", html: str = "html", least: int = LEAST_SHARED) -> DataFrame:
    """Distinct (id, digest, refers_to) of the pages whose payload another page with a smaller id has.

    Only ids and digests are grouped and joined; the minimum is combined before the shuffle. Rows without an id are no
    revisits and are not referred to.
    """
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    keys = pages.where(F.col(id).isNotNull() & (F.octet_length(html) >= least)).select(id, F.sha2(payload, 256).alias("digest"))
    first = keys.groupBy("digest").agg(F.min(id).alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return keys.distinct().join(first, "digest").where(F.col(id) > F.col("refers_to")).select(id, "digest", "refers_to")


def write_bundles(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_SHARED) -> None:
    """One WARC record for each row of pages, in bundles under path. Null html: an empty payload."""
    small_batches(pages.sparkSession)
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id).cast("long").alias("id"), F.col(url).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    again = revisits(pages, id, html, least).select(F.col(id).cast("long").alias("id"), "digest", F.col("refers_to").cast("long").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, bundle = TaskContext.get().partitionId(), 0, Bundle()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{part:07d}-{number:07d}"]), pa.array([bundle.body()], pa.binary())], names=["name", "body"])

        for batch in batches:
            for page, link, data, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bundle.add(record(page, link, data, digest, refers_to))
                if bundle.bytes >= BUNDLE_BYTES:
                    yield out()
                    number, bundle = number + 1, Bundle()
        if bundle.bytes or bundle.open:
            yield out()

    joined = rows.join(again, ["id", "digest"], "left").select("id", "url", "payload", "digest", "refers_to")
    write_files(joined.mapInArrow(run, "name string, body binary"), path, TRAILER)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Each record's figures and its place: record_id, bundle, frame, offset in the frame's content, n_bytes.

    Lengths and digests of responses are made from the payloads read, and a digest that differs from the header's fails;
    a revisit carries those of the payload that it leaves out.
    """
    small_batches(spark)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "bundle", "frame", "offset", "n_bytes"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                bundle = body.as_py()
                for k, place in enumerate(seek_table(bundle)):
                    data, at, rows = frame(bundle, place), 0, []
                    while at < len(data):
                        headers, block, after = parse_record(data, at)
                        digest, size = headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(headers["X-Payload-Length"])
                        if headers["WARC-Type"] == "response":
                            payload = payload_of(block)
                            if hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"payload of {headers['WARC-Record-ID']} is damaged")
                            size = len(payload)
                        page, to = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page-ID")
                        rows.append((page and int(page), size, digest, headers["WARC-Type"], to and int(to), headers["WARC-Record-ID"].strip("<>"), name, k, at, after - at))
                        at = after
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return read_files(spark, path).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, bundle string, frame long, offset long, n_bytes long")


def read_payload(spark: SparkSession, path: str, index: DataFrame, page: int) -> bytes | None:
    """The payload of one page: its place from the index (revisits are followed), then the seek table and one frame of one bundle."""
    place = index.where(F.col("page_id") == page).orderBy("refers_to").first()
    if place is None:
        return None
    if place.record_type == "revisit":
        return read_payload(spark, path, index, place.refers_to)
    (foot,) = read_stretches(spark, path, place.bundle, [(-FOOT, FOOT)])
    size = FOOT + 12 * struct.unpack_from("<I", foot)[0]
    (table,) = read_stretches(spark, path, place.bundle, [(-size, size)])
    start, packed, content = seek_table(table)[place.frame]
    (body,) = read_stretches(spark, path, place.bundle, [(start, packed)])
    return payload_of(parse_record(frame(body, (0, packed, content)), place.offset)[1])


def archive(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the archive, read it back whole, and return the index of its records as a written table."""
    write_bundles(pages, path, id, url, html)
    if not pages.limit(1).count():
        return pages.sparkSession.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, bundle string, frame long, offset long, n_bytes long")
    return written(read_bundles(pages.sparkSession, path), "warc-index")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, read back from the archive written.

    Null html is an empty payload. A page that is there twice gives two records; equal payloads refer to the least page_id,
    rows without an id are responses. A very long page is one record of one frame. An empty table gives an empty one.
    """
    return archive(table(spark, sf_dir, "pages"), fresh_path(spark, "warc")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY sha256(h)) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM d
"""
