"""WARC archives in seekable Zstandard bundles.

Records are written in groups of about `frame_bytes`; each group is one independent zstd frame.
A bundle is a run of frames and, as its footer, a seek table in the zstd seekable format (a
skippable frame), so that any zstd tool can unpack it and a reader can open one frame alone. A
bundle is one row of a table in the shared folder: its bytes, and an index from record identifier
to (frame, offset in the frame, length). Rows go through Spark's own writer, so a lost executor
leaves no half archive, and any store that Spark writes will do.

Of records with equal payloads (by SHA-1) of at least `min_payload_bytes`, the one with the
largest page_id is written in full, the others as revisits that refer to it. Smaller payloads
are always written in full.

Edge cases: a null html is an empty payload. A null url is written as an empty target. Repeated
rows of the page_id that is kept are all responses. A null page_id is kept only where no other
page has its payload. An empty table gives no bundles. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize, pick

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: The side of repeated payloads is broadcast up to so many rows (40 bytes each), else shuffled.
MAX_BROADCAST_ROWS = 500_000
BUNDLE = "bundle_id string, data binary, index array<struct<record_id:string,frame:int,offset:bigint,length:bigint>>"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}").urn


def encode_record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool, length: int) -> bytes:
    """One WARC/1.1 record. The page id and the full payload's length travel as extra fields."""
    target = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = b"" if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_id(page_id)}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {length}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{record_id(refers_to)}>", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def decode_record(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """The fields, the payload and where the next record begins."""
    head = data.index(b"\r\n\r\n", at) + 4
    fields = dict(line.split(": ", 1) for line in data[at:head].decode().split("\r\n")[1:] if line)
    end = head + int(fields["Content-Length"])
    block = data[head:end]
    payload = block[block.index(b"\r\n\r\n") + 4 :] if block else b""
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("record without its end mark")
    return fields, payload, end + 4


class BundleWriter:
    def __init__(self, level: int = 3, frame_bytes: int = 1 << 17):
        self.zstd, self.frame_bytes = zstandard.ZstdCompressor(level=level), frame_bytes
        self.frames: list[bytes] = []
        self.table: list[tuple[int, int]] = []
        self.index: list[tuple] = []
        self.open: list[bytes] = []
        self.fill = self.size = 0

    def add(self, key: str, record: bytes) -> None:
        self.index.append((key, len(self.frames), self.fill, len(record)))
        self.open.append(record)
        self.fill += len(record)
        if self.fill >= self.frame_bytes:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            frame = self.zstd.compress(b"".join(self.open))
            self.table.append((len(frame), self.fill))
            self.frames.append(frame)
            self.size += len(frame)
            self.open, self.fill = [], 0

    def finish(self) -> bytes:
        self.close_frame()
        entries = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(entries)) + entries


def seek_table(bundle: bytes) -> list[tuple[int, int]]:
    """(start, compressed size) of each frame, from the footer alone."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table")
    sizes = [struct.unpack("<II", bundle[x : x + 8])[0] for x in range(len(bundle) - 9 - 8 * n, len(bundle) - 9, 8)]
    starts = [0]
    for size in sizes:
        starts.append(starts[-1] + size)
    return list(zip(starts, sizes, strict=False))


def read_frame(bundle: bytes, frame: int) -> bytes:
    start, size = seek_table(bundle)[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[start : start + size])


def read_record(bundle: bytes, frame: int, offset: int) -> tuple[dict, bytes]:
    return decode_record(read_frame(bundle, frame), offset)[:2]


def choose(pages: DataFrame, min_payload_bytes: int = 0) -> DataFrame:
    """pages with digest (SHA-1 hex), length and kept (the page_id written in full, where the
    payload repeats). Counting pre-aggregates on the map side; html itself is not shuffled
    unless the repeated payloads are too many to broadcast."""
    rows = pick(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "length": F.octet_length("html").cast("long")})
    repeated = materialize(
        rows.filter(F.col("length") >= min_payload_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("digest", "kept"),
        "warc-repeated",
    )
    small = repeated.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    return rows.join(F.broadcast(repeated) if small else repeated, "digest", "left")


def write(pages: DataFrame, min_payload_bytes: int = 0, frame_bytes: int = 1 << 17, bundle_bytes: int = 1 << 22) -> DataFrame:
    """The table of bundles, already written to the shared folder."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n, out = TaskContext.get().partitionId(), 0, BundleWriter(frame_bytes=frame_bytes)

        def done() -> pd.DataFrame:
            return pd.DataFrame({"bundle_id": [f"{part:06d}-{n:06d}"], "data": [out.finish()], "index": [out.index]})

        for batch in batches:
            for page, url, html, digest, length, kept in zip(
                batch.page_id, batch.url, batch.html, batch.digest, batch.length, batch.kept, strict=True
            ):
                page, kept = None if pd.isna(page) else int(page), None if pd.isna(kept) else int(kept)
                revisit = kept is not None and page != kept
                sha = base64.b32encode(bytes.fromhex(digest)).decode()
                out.add(record_id(page), encode_record(page, url or "", html.encode(), sha, kept, revisit, int(length)))
                if out.size >= bundle_bytes:
                    yield done()
                    n, out = n + 1, BundleWriter(frame_bytes=frame_bytes)
        if out.index:
            yield done()

    rows = choose(pages, min_payload_bytes).select("page_id", "url", "html", "digest", "length", "kept")
    return materialize(rows.mapInPandas(pack, BUNDLE), "warc-bundles")


def read(bundles: DataFrame) -> DataFrame:
    """Every record, by its index entry. A response's digest is made anew from its payload and
    must equal the one in its header."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bundle, index in zip(batch.data, batch["index"], strict=True):
                rows, opened = [], (-1, b"")
                for entry in index:
                    if opened[0] != entry["frame"]:
                        opened = (entry["frame"], read_frame(bundle, entry["frame"]))
                    f, payload, end = decode_record(opened[1], entry["offset"])
                    digest, full = f["WARC-Payload-Digest"].removeprefix("sha1:"), f["WARC-Type"] == "response"
                    if f["WARC-Record-ID"] != f"<{entry['record_id']}>" or end - entry["offset"] != entry["length"]:
                        raise ValueError(f"index and archive differ at {entry['record_id']}")
                    if full and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"payload of {entry['record_id']} is damaged")
                    rows.append(
                        (
                            int(f["X-Page-Id"]) if f["X-Page-Id"] else None,
                            f["WARC-Target-URI"],
                            f["WARC-Type"],
                            int(f["X-Refers-To-Page"]) if not full else None,
                            len(payload) if full else int(f["X-Payload-Length"]),
                            digest,
                            payload if full else None,
                        )
                    )
                frame = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])
                yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    return bundles.select("data", "index").mapInPandas(unpack, RECORD)
