"""Media columns: Ogg pages with verified checksums, packets, logical streams and timestamps.

A payload is stored as 8-bit samples in packets of 576, dealt in turn to two logical
streams of one physical stream. The reader is general: it checks every page's checksum,
reassembles packets from lacing values across pages, separates streams by serial number,
and turns granule positions into times.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lamina.llm.common import cut, remove, scratch, slices, texts

FRAME, RATE, SERIALS = 576, 8000, (1, 2)
HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = -1
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    """A page or packet is damaged."""


def checksum(page: bytes) -> int:
    """Ogg's CRC: polynomial 04c11db7, most significant bit first, from 0, not inverted.

    It is the mirror image of zlib's over bytes with their bits reversed.
    """
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "big").translate(_REVERSED)[::-1], "big")


def lacing(size: int) -> bytes:
    """A packet's lacing values: 255 for each whole 255 bytes, then the rest (which may be 0)."""
    return b"\xff" * (size // 255) + bytes([size % 255])


@dataclass
class Writer:
    """Pages of one logical stream. A granule position counts the samples up to the end of a page's last whole packet."""

    serial: int
    pages: list[bytes] = field(default_factory=list)
    values: bytearray = field(default_factory=bytearray)
    body: list[bytes] = field(default_factory=list)
    granule: int = NO_GRANULE
    continued: bool = False

    def packet(self, data: bytes, granule: int) -> None:
        values, at = lacing(len(data)), 0
        for begin in range(0, len(values), 255):
            part = values[begin : begin + 255]
            while part:
                room = part[: 255 - len(self.values)]
                size = sum(room)
                self.values += room
                self.body.append(data[at : at + size])
                at += size
                part = part[len(room) :]
                if room[-1] < 255:
                    self.granule = granule
                if len(self.values) == 255:
                    self.flush(room[-1] == 255)

    def flush(self, unfinished: bool = False, last: bool = False) -> None:
        flags = CONTINUED * self.continued | FIRST * (not self.pages) | LAST * last
        head = HEAD.pack(b"OggS", 0, flags, self.granule, self.serial, len(self.pages), 0, len(self.values)) + bytes(self.values)
        page = head + b"".join(self.body)
        self.pages.append(page[:22] + struct.pack("<I", checksum(page)) + page[26:])
        self.values, self.body, self.granule, self.continued = bytearray(), [], NO_GRANULE, unfinished


def mux(payload: bytes, frame: int = FRAME, rate: int = RATE, serials: tuple[int, ...] = SERIALS) -> bytes:
    """A physical stream: a head packet in each logical stream, then frames of ``payload`` dealt to them in turn."""
    streams = [Writer(s) for s in serials]
    for i, stream in enumerate(streams):
        stream.packet(b"lamina8b" + struct.pack("<IIHH", rate, frame, i, len(serials)), 0)
        stream.flush()
    done = [0] * len(streams)
    for n, at in enumerate(range(0, len(payload), frame)):
        i, data = n % len(streams), payload[at : at + frame]
        done[i] += len(data)
        streams[i].packet(data, done[i])
    for stream in streams:
        stream.flush(last=True)
    longest = max(len(s.pages) for s in streams)
    return b"".join(s.pages[k] for k in range(longest) for s in streams if k < len(s.pages))


@dataclass
class Stream:
    """A logical stream as read: packets, the time in seconds at the end of each page that ends a packet, and pages."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    closed: bool = False
    pending: list[bytes] | None = None

    def times(self, rate: int) -> list[float]:
        return [g / rate for g in self.granules]


def demux(data: bytes) -> dict[int, Stream]:
    """The logical streams by serial number, in order of their first pages.

    Raises OggError for a wrong checksum, a page out of sequence, a packet that does not
    continue, or bytes that are no page.
    """
    streams: dict[int, Stream] = {}
    view, at = memoryview(data), 0
    while at < len(data):
        if len(data) - at < HEAD.size:
            raise OggError(f"a page is cut short at byte {at}")
        magic, version, flags, granule, serial, number, crc, segments = HEAD.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        table = data[at + HEAD.size : at + HEAD.size + segments]
        begin = at + HEAD.size + segments
        end = begin + sum(table)
        if end > len(data):
            raise OggError(f"a page is cut short at byte {at}")
        if checksum(b"".join((view[at : at + 22], b"\0\0\0\0", view[at + 26 : end]))) != crc:
            raise OggError(f"the checksum of the page at byte {at} is wrong")
        stream = streams.setdefault(serial, Stream())
        if number != stream.pages or bool(flags & FIRST) != (number == 0) or stream.closed:
            raise OggError(f"page {number} of stream {serial} is out of sequence")
        if bool(flags & CONTINUED) != (stream.pending is not None):
            raise OggError(f"page {number} of stream {serial} does not continue its packet")
        part, place, ended = stream.pending or [], begin, False
        open_ = stream.pending is not None
        size = 0
        for value in table:
            size += value
            open_ = True
            if value < 255:
                part.append(data[place : place + size])
                stream.packets.append(b"".join(part))
                place, size, part, open_, ended = place + size, 0, [], False, True
        if size:
            part.append(data[place : place + size])
        stream.pending = part if open_ else None
        if ended != (granule != NO_GRANULE):
            raise OggError(f"page {number} of stream {serial} has a wrong granule position")
        if ended:
            if stream.granules and granule < stream.granules[-1]:
                raise OggError(f"granule positions of stream {serial} fall")
            stream.granules.append(granule)
        stream.pages += 1
        stream.closed = bool(flags & LAST)
        at = end
    if any(s.pending is not None or not s.closed for s in streams.values()):
        raise OggError("a stream is not ended")
    return streams


def pad(raw: bytes, frame: int = FRAME) -> bytes:
    """``raw`` and bytes 255 up to a positive multiple of ``frame``."""
    return raw + b"\xff" * ((-len(raw)) % frame or (0 if raw else frame))


def unmux(data: bytes) -> tuple[bytes, dict[int, Stream], int]:
    """The payload that ``mux`` stored, the streams, and the sample rate."""
    streams = demux(data)
    heads = {}
    for serial, stream in streams.items():
        if not stream.packets or stream.packets[0][:8] != b"lamina8b":
            raise OggError(f"stream {serial} has no head packet")
        rate, _, place, many = struct.unpack("<IIHH", stream.packets[0][8:])
        heads[place] = serial
    if len(heads) != many or len(streams) != many:
        raise OggError("a logical stream is missing")
    turns = [streams[heads[i]].packets[1:] for i in range(many)]
    for i, packets in enumerate(turns):
        if sum(map(len, packets)) != streams[heads[i]].granules[-1]:
            raise OggError(f"stream {heads[i]} lacks samples")
    payload = [turns[n % many][n // many] for n in range(sum(map(len, turns)))]
    return b"".join(payload), streams, rate


def feature(payload: bytes, streams: dict[int, Stream], rate: int) -> str:
    """Pages, packets and seconds of the streams, and mean and deviation of the samples."""
    x = np.frombuffer(payload, np.uint8)
    seconds = sum(s.times(rate)[-1] for s in streams.values())
    pages, packets = sum(s.pages for s in streams.values()), sum(len(s.packets) for s in streams.values())
    return f"streams={len(streams)};pages={pages};packets={packets};seconds={seconds:.3f};mean={x.mean():.4f};std={x.std():.4f}"


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text (null: empty) as a binary column of Ogg pages; other columns are ignored."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            raws = texts(batch)
            media = pa.array([mux(pad(r)) for r in raws], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(r) for r in raws], pa.int64()), media], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_bytes long, media binary")


def decode(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of a media column.

    A damaged medium raises OggError: no row is dropped in silence.
    """
    id_type = media.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000, column="media"):
            rows = []
            for data in texts(batch, "media"):
                payload, streams, rate = unmux(data)
                digest = hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])
                rows.append((len(payload), *digest, len(data), hashlib.sha256(data).hexdigest(), feature(payload, streams, rate)))
            arrays = [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(zip(*rows), types))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"doc_id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def media_features(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Stores every text's medium as a Parquet table, reads it back and returns what ``decode`` finds: one row a document.

    Equal texts give equal media. A null or empty text is one frame of padding; repeated
    rows stay. The table stays at ``path`` if one is given; else it lies in the shared
    folder until the features are computed. No shuffle.
    """
    spark = docs.sparkSession
    table = path or scratch(spark, "media")
    encode(docs).write.option("compression", "zstd").parquet(table)
    found = cut(decode(spark.read.parquet(table)))
    if path is None:
        remove(spark, table)
    return found
