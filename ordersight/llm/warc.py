"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about ``frame_bytes``;
an archive is frames, then the seek table of the public Zstandard seekable
format in a skippable frame (magic ``0x184D2A5E``; per frame its compressed and
uncompressed size; a nine-byte footer with the number of frames and the magic
``0x8F92EAB1``). Any Zstandard tool can unpack an archive whole; with the seek
table and the index, which maps a record id to its frame and its offset there,
one record costs one frame.

The payload's SHA-256 tells equal payloads. Of equal ones of at least
``min_revisit`` bytes, the record with the smallest page id is a response and
the others are revisit records that refer to it; shorter ones are responses.
The smallest ids are pre-aggregated by digest, and adaptive skew joins split a
digest that many pages share. Each task writes archives of about
``archive_bytes`` to a folder all executors share, under names of their own, and
the index lists only the archives of tasks that succeeded: a lost executor
leaves an unlisted file at most.

Defined cases: a null payload is an empty one; a null url is ``urn:x-page:ID``
as target. Pages with a null id are responses without an id. Rows that repeat
a page with the smallest id are responses, each with its own record. An empty
table gives an empty index and no archive. Columns other than page id, url and
payload are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, qualified
from .common import file_system, map_rows

#: Fixed values of the Zstandard seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Fixed value of WARC 1.1.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
           date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP head only."""
    rid = f"urn:x-page:{'' if page_id is None else page_id}"
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else rid
    revisit = refers_to is not None
    block = _HTTP if revisit else _HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{rid}>",
            f"WARC-Target-URI: {target}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}",
            f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, offset: int) -> tuple[dict[str, str], bytes]:
    """Header fields and payload (of the block, so empty for a revisit) of the record at the offset."""
    end = data.index(b"\r\n\r\n", offset)
    first, *lines = data[offset:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no record at offset {offset}")
    head = dict(line.split(": ", 1) for line in lines)
    block = data[end + 4:end + 4 + int(head["Content-Length"])]
    return head, block[block.index(b"\r\n\r\n") + 4:]


def _page(uri: str) -> int | None:
    tail = uri.strip("<>").rpartition(":")[2]
    return int(tail) if tail else None


class Archive:
    """A file of frames; ``add`` gives the frame and the offset of the record in it."""

    def __init__(self, out, frame_bytes: int, level: int):
        self.out, self.frame_bytes = out, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.sizes: list[tuple[int, int]] = []
        self.held, self.length, self.written = [], 0, 0

    def add(self, data: bytes) -> tuple[int, int]:
        if self.length and self.length + len(data) > self.frame_bytes:
            self._flush()
        at = len(self.sizes), self.length
        self.held.append(data)
        self.length += len(data)
        return at

    def _flush(self) -> None:
        if self.held:
            frame = self.zstd.compress(b"".join(self.held))
            self.out.write(frame)
            self.sizes.append((len(frame), self.length))
            self.written += len(frame)
            self.held, self.length = [], 0

    def close(self) -> None:
        self._flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes)
        table += struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


def seek_table(file) -> list[tuple[int, int]]:
    """``(start, compressed size)`` of each frame, from the footer of an open archive."""
    size = file.size()
    file.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    file.seek(size - 9 - 8 * n)
    raw, start, out = file.read(8 * n), 0, []
    for packed, _ in struct.iter_unpack("<II", raw):
        out.append((start, packed))
        start += packed
    return out


def read_record(path: str, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record, by its place in the index: reads the seek table and one frame."""
    system, name = file_system(path)
    with system.open_input_file(name) as f:
        start, packed = seek_table(f)[frame]
        f.seek(start)
        return parse(zstandard.decompress(f.read(packed)), offset)


INDEX = [("page_id", pa.int64(), "long"), ("record_id", pa.string(), "string"), ("archive", pa.string(), "string"),
         ("frame", pa.int64(), "long"), ("offset", pa.int64(), "long"), ("length", pa.int64(), "long")]


def write(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          min_revisit: int = 100, frame_bytes: int = 1 << 18, archive_bytes: int = 1 << 30, level: int = 3,
          date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives into ``folder`` (all executors share it; one without a scheme is in the cluster's
    default file system); the index, one row per record.

    The result is written too, so that reading it twice does not write the archives twice.
    """
    c = lambda name: F.col(f"`{name}`")
    rows = pages.select(c(id_col).cast("long").alias("page_id"), c(url_col).cast("string").alias("url"),
                        F.coalesce(c(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = (rows.where((F.octet_length("payload") >= min_revisit) & F.col("page_id").isNotNull())
             .groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("k"))
             .where("k > 1").select("digest", "first"))
    rows = rows.join(first, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to"))
    folder = qualified(pages.sparkSession, folder)

    def run(it):
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        archive = name = None
        for batch in it:
            for page_id, url, payload, digest, refers_to in zip(
                    *(batch.column(k).to_pylist() if k != 2 else batch.column(2) for k in range(5)), strict=True):
                if archive is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    archive = Archive(system.open_output_stream(f"{base}/{name}", compression=None), frame_bytes, level)
                data = record(page_id, url, payload.as_buffer().to_pybytes(), digest, refers_to, date)
                frame, offset = archive.add(data)
                yield (page_id, None if page_id is None else f"urn:x-page:{page_id}", f"{folder}/{name}", frame, offset,
                       len(data))
                if archive.written >= archive_bytes:
                    archive.close()
                    archive = None
        if archive:
            archive.close()

    return materialize(map_rows(rows, run, INDEX), "warc_index")


def _frames(name: str, wanted: list[tuple[int, int]]) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of one archive at the given, sorted (frame, offset) places; every frame is unpacked once."""
    system, path = file_system(name)
    with system.open_input_file(path) as f:
        table, at, data = seek_table(f), None, b""
        for frame, offset in wanted:
            if frame != at:
                start, packed = table[frame]
                f.seek(start)
                data, at = zstandard.decompress(f.read(packed)), frame
            yield parse(data, offset)


def read_back(index: DataFrame, *, payloads: bool = True, task_bytes: int = 1 << 26) -> DataFrame:
    """Every record of the index, from its archive: ``page_id, url, record_type, refers_to, payload_bytes,
    payload_digest, payload``.

    A response's size and digest are those of the payload that was read; a revisit has no payload, and gives
    those it was written with. Without ``payloads`` that column is null. A task unpacks about ``task_bytes`` of
    records, but there are as many tasks as cores at least, whatever the index rows amount to.
    """
    def run(it):
        held, archive = [], None
        for batch in it:
            for name, frame, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != archive or (held and held[-1][0] != frame and len(held) >= 1000):
                    yield from out(archive, held)
                    held, archive = [], name
                held.append((frame, offset))
        yield from out(archive, held)

    def out(archive, held):
        for head, payload in _frames(archive, held) if held else ():
            response = head["WARC-Type"] == "response"
            yield (_page(head["WARC-Record-ID"]), head["WARC-Target-URI"], head["WARC-Type"],
                   None if response else _page(head["WARC-Refers-To"]),
                   len(payload) if response else int(head["X-Payload-Length"]),
                   hashlib.sha256(payload).hexdigest() if response else head["WARC-Payload-Digest"].partition(":")[2],
                   payload.decode() if response and payloads else None)

    n_bytes = index.agg(F.sum("length")).first()[0] or 0
    n_tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-n_bytes // task_bytes))
    at = (index.select("archive", "frame", "offset").repartition(n_tasks, "archive", F.floor(F.col("frame") / 64))
          .sortWithinPartitions("archive", "frame", "offset"))
    return map_rows(at, run, [
        ("page_id", pa.int64(), "long"), ("url", pa.string(), "string"), ("record_type", pa.string(), "string"),
        ("refers_to", pa.int64(), "long"), ("payload_bytes", pa.int64(), "long"),
        ("payload_digest", pa.string(), "string"), ("payload", pa.string(), "string")], size=500)
