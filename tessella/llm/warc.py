"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames; a bundle ends with a seek table
in a skippable frame (sizes of every frame), and an index maps each record to
its frame and to its place inside the frame. Records of one payload after the
first are revisits without a body.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.exchange import fresh_path, release, small_batches, stored, until_exit

#: Fixed values of the seekable format: skippable frame, seek table footer.
SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES, LEAST_BUNDLES = 256 << 10, 16 << 20, 24
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str | None) -> str:
    return "" if value is None else value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id, copy: int, url, payload: bytes, refers_to) -> bytes:
    """One WARC record; with ``refers_to`` a revisit, whose HTTP head still tells the payload's length."""
    name = f"<urn:page:{'' if page_id is None else page_id}:{copy}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    body = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name}",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}:0>"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


class BundleWriter:
    """Frames of about ``frame_bytes``, then the seek table."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.out, self.frame_bytes, self.zstd = out, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames, self.buffer, self.size = [], [], 0

    def add(self, data: bytes) -> tuple[int, int, int]:
        """(frame, offset in the frame, length) of the record."""
        if self.size and self.size + len(data) > self.frame_bytes:
            self.flush()
        at = (len(self.frames), self.size, len(data))
        self.buffer.append(data)
        self.size += len(data)
        return at

    def flush(self) -> None:
        if self.buffer:
            packed = self.zstd.compress(b"".join(self.buffer))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.buffer, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", c, d) for c, d in self.frames) + struct.pack("<IBI", len(self.frames), 0, FOOTER)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class BundleReader:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - 9)
        count, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != FOOTER:
            raise ValueError("no seek table")
        file.seek(size - 9 - 8 * count)
        sizes = struct.iter_unpack("<II", file.read(8 * count))
        self.frames, at = [], 0
        for packed, plain in sizes:
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.frames[number]
        self.file.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=plain)

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


def parse_records(data: bytes):
    """(headers, body) of each record of a frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        size = int(head["Content-Length"])
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _write(folder: str, least_bytes: int, frame_bytes: int):
    def run(key, pages, repeats):
        number = key[0].as_py()
        first = {(d, n): p for d, n, p in zip(*(repeats.column(c).to_pylist() for c in ("digest", "size", "refers_to")))}
        pages = pages.sort_by([("page_id", "ascending"), ("url", "ascending")])
        fs, where = _open(folder)
        fs.create_dir(where, recursive=True)
        # each attempt of a task writes a file of its own; the index names that of the attempt which succeeded
        name = f"bundle-{number:06d}-{uuid.uuid4().hex}.warc.zst"
        rows, seen, copies = [], set(), {}
        with fs.open_output_stream(f"{where}/{name}", compression=None) as out:
            w = BundleWriter(out, frame_bytes)
            for page_id, url, html in zip(pages.column("page_id"), pages.column("url"), pages.column("html")):
                page_id, url, payload = page_id.as_py(), url.as_py(), (html.as_py() or "").encode()
                origin = None
                if len(payload) >= least_bytes and page_id is not None:
                    same = (hashlib.sha1(payload).hexdigest(), len(payload))
                    origin = first.get(same)
                    if origin == page_id and (same, page_id) not in seen:
                        seen.add((same, page_id))
                        origin = None
                copy = copies[page_id] = copies.get(page_id, -1) + 1
                rows.append((name, page_id, copy, *w.add(record(page_id, copy, url, payload, origin))))
            w.close()
        release()
        return pa.table([pa.array([r[c] for r in rows], k) for c, k in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["bundle", "page_id", "copy", "frame", "frame_offset", "length"])

    return run


def write_bundles(pages: DataFrame, folder: str, least_bytes: int = 0, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write one record for each row of pages(page_id, url, html) and return the index, stored in the shared folder.

    ``folder`` is a URI that driver and executors share. Equal payloads of at
    least ``least_bytes`` bytes: the smallest page_id is the response, the
    others are revisits; of rows with that same page_id the first is. A null
    html is an empty payload, a null page_id is always a response.
    """
    small_batches(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    total = pages.select(F.sum(F.octet_length(html)).alias("n")).first()["n"] or 0
    bundles = max(LEAST_BUNDLES, -(-total // BUNDLE_BYTES))
    page = pages.select(F.pmod(F.xxhash64(F.col("page_id").cast("long"), F.when(F.col("page_id").isNull(), html)), F.lit(bundles)).alias("bundle"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    narrow = page.select(F.col("bundle").alias("bundle"), "page_id", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").alias("size")).where(F.col("page_id").isNotNull() & (F.col("size") >= least_bytes))
    again = narrow.groupBy("digest", "size").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1").drop("c")
    repeats = narrow.select(F.col("bundle").alias("to"), "digest", "size").distinct().join(again, ["digest", "size"]).select(F.expr("to + 0").alias("bundle"), "digest", "size", "refers_to")
    index = page.groupBy("bundle").cogroup(repeats.groupBy("bundle")).applyInArrow(_write(folder, least_bytes, frame_bytes), "bundle string, page_id long, copy int, frame int, frame_offset long, length long")
    return stored(index, "warc-index")


def _read(folder: str):
    def run(batches):
        fs, where = _open(folder)
        for batch in batches:
            for name in batch.column("bundle").to_pylist():
                with fs.open_input_file(f"{where}/{name}") as file:
                    reader = BundleReader(file)
                    for number in range(len(reader.frames)):
                        rows = []
                        for head, body in parse_records(reader.frame(number)):
                            page = head["WARC-Record-ID"][10:-1].split(":")[0]
                            http, _, payload = body.partition(b"\r\n\r\n")
                            size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                            kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"][5:]
                            if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
                                raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
                            refers = head.get("WARC-Refers-To")
                            rows.append((int(page) if page else None, size, digest, kind, int(refers[10:-1].split(":")[0]) if refers else None))
                        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        release()

    return run


def read_record(folder: str, bundle: str, frame: int, offset: int, length: int) -> tuple[dict, bytes]:
    """(headers, body) of one record by its row of the index; reads the seek table and a single frame."""
    fs, where = _open(folder)
    with fs.open_input_file(f"{where}/{bundle}") as file:
        return next(parse_records(BundleReader(file).record(frame, offset, length)))


def read_bundles(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record in the bundles of an index; a task for about each bundle."""
    names = index.select("bundle").distinct()
    return names.repartition(max(LEAST_BUNDLES, names.count())).mapInArrow(_read(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages to fresh bundles in the shared folder and read them back; an empty table gives an empty table."""
    folder = fresh_path(pages.sparkSession, "warc")
    index = write_bundles(pages, folder, least_bytes)
    if not index.isEmpty():
        until_exit(pages.sparkSession, folder)
    return read_bundles(index, folder)
