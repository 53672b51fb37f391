"""WARC archives as seekable Zstandard bundles.

A bundle is a chain of independent Zstandard frames, each with a group of WARC
records, then a skippable frame that maps record identifiers to (frame, offset in
the frame), then the seek table of the seekable format. Any record can be read by
inflating one frame. Bundles are written by Spark's own text writer, one row a
file, so its commit protocol makes retried tasks safe and any file system that
Spark reaches will do: the writer ends a row with the separator, and the separator
here is the four bytes of the seekable format's magic number, the end of a bundle.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import Scratch, narrow

LEAST_REVISIT = 1000
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 16 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Fixed values of the Zstandard seekable format.
SKIPPABLE = 0x184D2A5E
INDEX_FRAME = 0x184D2A51
SEEKABLE_MAGIC = struct.pack("<I", 0x8F92EAB1)
_ENTRY = struct.Struct("<16sII")


def record_uuid(page_id: int | None) -> uuid.UUID:
    """A version 8 UUID that holds the identifier."""
    x = 0 if page_id is None else page_id & (1 << 64) - 1
    return uuid.UUID(int=0xC0 << 120 | 8 << 76 | (x >> 62 | (page_id is None) << 2) << 64 | 2 << 62 | x & (1 << 62) - 1)


def page_of(record: uuid.UUID) -> int | None:
    high = record.int >> 64 & 0xFFF
    x = (high & 3) << 62 | record.int & (1 << 62) - 1
    return None if high & 4 else x - (1 << 64) if x >> 63 else x


def _clean(url: str | None) -> str:
    return "".join(c if "\x20" < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "urn:none")


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{record_uuid(page_id)}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(url)}"]
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}"]
    lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{record_uuid(refers)}>"] if revisit else []
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


class Bundle:
    """Gathers records into frames; ``finish`` gives the bytes of the whole bundle."""

    def __init__(self) -> None:
        import zstandard

        self.zip = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[bytes] = []
        self.open: list[bytes] = []
        self.at = self.bytes = 0

    def add(self, page_id: int | None, rec: bytes) -> None:
        self.index.append(_ENTRY.pack(record_uuid(page_id).bytes, len(self.frames), self.at))
        self.open.append(rec)
        self.at += len(rec)
        if self.at >= FRAME_BYTES:
            self._close()

    def _close(self) -> None:
        if self.open:
            frame = self.zip.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.at))
            self.bytes += len(frame)
            self.open, self.at = [], 0

    def finish(self) -> bytes:
        self._close()
        index = b"".join(self.index)
        index = struct.pack("<II", INDEX_FRAME, len(index)) + index
        sizes = [*self.sizes, (len(index), 0)]
        table = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IB", len(sizes), 0) + SEEKABLE_MAGIC
        return b"".join(self.frames) + index + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(body: bytes) -> list[tuple[int, int, int]]:
    """(offset, size, inflated size) of each frame, from the footer."""
    if body[-4:] != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    n = struct.unpack_from("<I", body, len(body) - 9)[0]
    at, out = 0, []
    for size, inflated in struct.iter_unpack("<II", body[len(body) - 9 - 8 * n : len(body) - 9]):
        out.append((at, size, inflated))
        at += size
    return out


def record_index(body: bytes) -> Iterator[tuple[uuid.UUID, int, int]]:
    """(record, frame, offset in the frame) for each record of the bundle."""
    at, size, _ = seek_table(body)[-1]
    for raw, frame, offset in _ENTRY.iter_unpack(body[at + 8 : at + size]):
        yield uuid.UUID(bytes=raw), frame, offset


def parse(data: bytes, at: int = 0) -> dict:
    """The record that begins at ``at`` of an inflated frame."""
    end = data.index(b"\r\n\r\n", at)
    head = {}
    for line in data[at:end].decode().split("\r\n")[1:]:
        k, _, v = line.partition(": ")
        head[k] = v
    block = data[end + 4 : end + 4 + int(head["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    long = int(http.rsplit(b"Content-Length: ", 1)[1])
    ident = lambda k: page_of(uuid.UUID(head[k][10:-1])) if k in head else None
    digest = base64.b32decode(head["WARC-Payload-Digest"][5:]).hex()
    kind = head["WARC-Type"]
    if kind == "response" and (len(payload) != long or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload in {head['WARC-Record-ID']}")
    return {"page_id": ident("WARC-Record-ID"), "payload_bytes": long, "payload_digest": digest, "record_type": kind, "refers_to": ident("WARC-Refers-To"), "url": head["WARC-Target-URI"], "payload": payload}


def _write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, bundle, n = TaskContext.get().partitionId(), Bundle(), 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"bundle": [f"{part:06d}-{n:05d}"], "body": pa.array([bundle.finish()[:-4]], pa.binary())})

    for b in it:
        for k in range(b.num_rows):
            page_id, url, payload, sha1, refers, revisit = (c[k].as_py() for c in b.columns)
            bundle.add(page_id, record(page_id, url, payload, sha1, refers, revisit))
            if bundle.bytes >= BUNDLE_BYTES:
                yield done()
                bundle, n = Bundle(), n + 1
    if bundle.index:
        yield done()


def write_warc(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT) -> None:
    """Write a record for each row to bundles below ``path``, a folder that all executors reach.

    Of rows with equal payloads of at least ``least`` bytes, the one with the
    largest identifier is a response and the others revisit it; smaller payloads
    are all responses. Defined cases: a null html is an empty payload; a null url
    becomes urn:none; a null identifier is below all others and keeps its null on
    reading; rows that repeat the largest identifier are all responses; an empty
    table writes no bundle; other columns are ignored.

    Plan: groups of equal payloads come from digests, aggregated on the map side;
    only groups of two or more are joined back, and a hot one can be split.
    """
    docs = narrow(df, id_col, url_col, html_col)
    body = F.encode(F.coalesce(html_col, F.lit("")), "UTF-8")
    t = docs.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), body.alias("body"))
    long = t.where(F.octet_length("body") >= least)
    groups = long.groupBy(F.sha2("body", 256).alias("__key")).agg(F.max("id").alias("__most"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    # written, as adaptive execution splits a hot key only where a join reads both sides from shuffles of its own
    groups = Scratch(df.sparkSession, "warc-groups").table(groups, "groups")
    key = F.when(F.octet_length("body") >= least, F.sha2("body", 256))
    t = t.withColumn("__mine", key).join(groups, F.col("__mine") == F.col("__key"), "left")
    revisit = F.coalesce(F.col("__n") > 1, F.lit(False)) & ~F.col("id").eqNullSafe(F.col("__most"))
    t = t.select("id", "url", "body", F.sha1("body").alias("sha1"), F.when(revisit, F.col("__most")).alias("refers"), revisit.alias("revisit"))
    made = t.mapInArrow(_write, "bundle string, body binary")
    made.select("bundle", F.col("body").cast("string").alias("body")).write.mode("overwrite").partitionBy("bundle").option("lineSep", SEEKABLE_MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def _read(full: bool):
    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["url", "payload"] * full
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for b in it:
            for k in range(b.num_rows):
                body = b.column(0)[k].as_py()
                places: dict[int, list[int]] = {}
                for _, frame, offset in record_index(body):
                    places.setdefault(frame, []).append(offset)
                for frame, (at, size, inflated) in enumerate(seek_table(body)):
                    if frame in places:
                        data = unzip.decompress(body[at : at + size], max_output_size=inflated)
                        rows = [parse(data, x) for x in places[frame]]
                        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, kinds, strict=False)], names)

    return read


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to (and url, payload)."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * payloads
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(_read(payloads), schema)


def fetch(body: bytes, page_id: int | None) -> Iterator[dict]:
    """The records of ``page_id`` in a bundle, each by inflating one frame only."""
    import zstandard

    table, want = seek_table(body), record_uuid(page_id)
    for found, frame, offset in record_index(body):
        if found == want:
            at, size, inflated = table[frame]
            yield parse(zstandard.ZstdDecompressor().decompress(body[at : at + size], max_output_size=inflated), offset)
