"""Media columns: Ogg containers written, verified, demultiplexed and timed.

``mux`` writes packets of several logical streams into one physical stream; ``demux`` walks the pages, verifies each
page's checksum, reassembles packets from the lacing values, separates the logical streams by serial number and turns
granule positions into times. ``encode_texts`` stores texts losslessly as 8-bit samples, and ``read_media`` reads a
binary column back into one row of features each.

Defined results: a null or empty text is one padded frame of 192 spaces; bytes that hold no page give no streams; a page
whose checksum is wrong is counted and skipped (the packet it continues is dropped with it), and reading goes on at
the next capture pattern. Repeated rows, and rows without an id, have a row each; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import arrow_map, utf8

FRAME = 192
#: Samples of 8 bits that one packet holds, and samples a second.
PACKET_FRAMES, RATE = 8, 8000
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
NO_PACKET_ENDS = 0xFFFFFFFFFFFFFFFF
_HEADER = struct.Struct("<4sBBQIIIB")
#: Header packet of a logical stream: mark, number of the stream, samples a second, bytes of the text.
HEAD, HEAD_MARK = struct.Struct("<5sBIQ"), b"\x01pcm8"
_REVERSED = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))


def page_checksum(page: bytes) -> int:
    """The container's CRC-32 (polynomial 0x04C11DB7, most significant bit first, start 0, no final inversion).

    zlib computes the bit-reflected form of the same polynomial, so bytes and result are reflected around it.
    """
    reflected = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, sequence: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEADER.pack(CAPTURE, 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    crc = page_checksum(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


class Writer:
    """Pages of one logical stream; a packet may span pages, and a page ends with any whole or full lacing value."""

    def __init__(self, serial: int, page_segments: int = 255) -> None:
        self.serial, self.page_segments = serial, page_segments
        self.sequence, self.pages, self.lacing, self.body = 0, [], bytearray(), []
        self.granule, self.continued = NO_PACKET_ENDS, False

    def flush(self, last: bool = False) -> None:
        if not self.lacing and not last:
            return
        flags = CONTINUED * self.continued | FIRST * (self.sequence == 0) | LAST * last
        self.continued = bool(self.lacing) and self.lacing[-1] == 255
        self.pages.append(_page(flags, self.granule if self.lacing else max(0, self.final), self.serial, self.sequence, bytes(self.lacing), b"".join(self.body)))
        self.sequence += 1
        self.lacing, self.body, self.granule = bytearray(), [], NO_PACKET_ENDS

    final = 0

    def packet(self, data: bytes, granule: int) -> None:
        at = 0
        while True:
            room = self.page_segments - len(self.lacing)
            if not room:
                self.flush()
                continue
            whole = (len(data) - at) // 255
            if whole >= room:
                self.lacing += b"\xff" * room
                self.body.append(data[at : at + 255 * room])
                at += 255 * room
                self.flush()
                continue
            self.lacing += b"\xff" * whole + bytes([len(data) - at - 255 * whole])
            self.body.append(data[at:])
            self.granule = self.final = granule
            return


def mux(streams: dict[int, list[tuple[bytes, int]]], page_segments: int = 255) -> bytes:
    """One physical stream of (packet, granule position) lists by serial: first pages first, then pages in turn."""
    written = []
    for serial, packets in streams.items():
        writer = Writer(serial, page_segments)
        for n, (data, granule) in enumerate(packets):
            writer.packet(data, granule)
            if n == 0:
                writer.flush()
        writer.flush(last=True)
        written.append(writer.pages)
    out = [pages[0] for pages in written]
    for n in range(1, max(map(len, written), default=0)):
        out += [pages[n] for pages in written if n < len(pages)]
    return b"".join(out)


@dataclass
class Logical:
    """A demultiplexed logical stream: packets, and the granule position known after each (-1: none)."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    last_sequence: int = -1
    lost: int = 0
    partial: list[bytes] | None = None

    def ends(self, samples: Callable[[bytes], int] | None = None) -> list[int]:
        """Granule position at the end of each packet. A page tells that of the last packet ending on it; those before it
        follow from the packets' ``samples``, and are -1 without them."""
        out = list(self.granules)
        if samples:
            for k in range(len(out) - 2, -1, -1):
                if out[k] < 0 <= out[k + 1]:
                    out[k] = max(0, out[k + 1] - samples(self.packets[k + 1]))
        return out

    def seconds(self, rate: int = RATE, samples: Callable[[bytes], int] | None = None) -> list[float]:
        """When each packet ends, -1 where nothing tells."""
        return [g / rate if g >= 0 else -1.0 for g in self.ends(samples)]


@dataclass
class Physical:
    streams: dict[int, Logical]
    pages: int = 0
    bad: int = 0
    skipped: int = 0


def demux(data: bytes) -> Physical:
    """Every page of ``data``, verified; see the module's text for damaged input."""
    out, at = Physical({}), 0
    while (found := data.find(CAPTURE, at)) >= 0:
        out.skipped += found - at
        if found + 27 > len(data):
            at = found
            break
        _, version, flags, granule, serial, sequence, crc, n = _HEADER.unpack_from(data, found)
        lacing = data[found + 27 : found + 27 + n]
        end = found + 27 + n + sum(lacing)
        page = data[found:end]
        if version or len(lacing) < n or end > len(data) or page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            out.bad += 1
            at = found + 4
            continue
        at = end
        out.pages += 1
        s = out.streams.setdefault(serial, Logical(serial))
        s.pages += 1
        if sequence != s.last_sequence + 1:
            s.lost += sequence - s.last_sequence - 1 if sequence > s.last_sequence else 1
            s.partial = None
        s.last_sequence = sequence
        s.ended |= bool(flags & LAST)
        if flags & CONTINUED:
            current, skip = s.partial, s.partial is None
        else:
            current, skip = None, False
        place, start = found + 27 + n, found + 27 + n
        for value in lacing:
            place += value
            if value < 255:
                if skip:
                    skip = False
                else:
                    s.packets.append(b"".join([*current, data[start:place]]) if current else data[start:place])
                    s.granules.append(-1)
                start, current = place, None
        if s.granules and granule != NO_PACKET_ENDS:
            s.granules[-1] = granule
        s.partial = None
        if lacing and lacing[-1] == 255 and not skip:
            s.partial = [*(current or []), data[start:place]]
    out.skipped += max(0, len(data) - at)
    return out


def padded(text: bytes) -> bytes:
    """``text`` with spaces up to a positive multiple of 192 bytes."""
    return text.ljust(max(1, -(-len(text) // FRAME)) * FRAME)


def encode_payload(payload: bytes, n_bytes: int | None = None) -> bytes:
    """8-bit samples in two logical streams: packets of up to 8 frames go to them in turn. The header packets hold the text's size."""
    size = FRAME * PACKET_FRAMES
    streams: dict[int, list[tuple[bytes, int]]] = {}
    for k in (0, 1):
        head = HEAD.pack(HEAD_MARK, k, RATE, len(payload) if n_bytes is None else n_bytes)
        streams[0x5A01 + k] = packets = [(head, 0)]
        samples = 0
        for at in range(size * k, len(payload), 2 * size):
            piece = payload[at : at + size]
            samples += len(piece)
            packets.append((piece, samples))
    return mux(streams)


def decode_payload(physical: Physical) -> bytes:
    """The samples of both streams in turn, without the header packets."""
    parts = [physical.streams[s].packets[1:] for s in sorted(physical.streams)]
    out = []
    for n in range(max(map(len, parts), default=0)):
        out += [p[n] for p in parts if n < len(p)]
    return b"".join(out)


def packet_samples(packet: bytes) -> int:
    """Samples of a packet: its bytes, but none in a header."""
    return 0 if len(packet) == HEAD.size and packet.startswith(HEAD_MARK) else len(packet)


def media_features(media: bytes) -> tuple[bytes, int, str]:
    """The payload read back, the text's size by the header (-1 without one), and features as text: streams, pages, packets,
    damage, packets with a time, length and level."""
    p = demux(media)
    payload = decode_payload(p)
    samples = np.frombuffer(payload, np.uint8)
    times = [t for s in p.streams.values() for t in s.seconds(RATE, packet_samples) if t >= 0]
    heads = [s.packets[0] for s in p.streams.values() if s.packets and len(s.packets[0]) == HEAD.size and s.packets[0].startswith(HEAD_MARK)]
    level = int(samples.sum(dtype=np.int64)) * 1000 // max(1, len(samples))
    text = f"streams={len(p.streams)};pages={p.pages};packets={sum(len(s.packets) for s in p.streams.values())};bad={p.bad};lost={sum(s.lost for s in p.streams.values())};ended={sum(s.ended for s in p.streams.values())};timed={len(times)};ms={round(1000 * max(times, default=0.0))};level_milli={level}"
    return payload, HEAD.unpack(heads[0])[3] if heads else -1, text


def encode_texts(documents: DataFrame) -> DataFrame:
    """doc_id and media (binary): every whole text of ``documents`` as an Ogg container; other columns are left out."""
    return arrow_map(
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, media binary",
        lambda b: pa.RecordBatch.from_arrays([b.column(0), pa.array([encode_payload(padded(t), len(t)) for t in utf8(b.column(1))], pa.binary())], ["doc_id", "media"]),
    )


REPORT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_media(media: DataFrame) -> DataFrame:
    """One row of features for each (doc_id, media): what the container holds, read back and verified."""

    def features(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for m in b.column(1).to_pylist():
            payload, n_bytes, text = media_features(m or b"")
            rows.append((n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m or b""), hashlib.sha256(m or b"").hexdigest(), text))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([b.column(0), *columns], [c.split()[0] for c in REPORT.split(", ")])

    return arrow_map(media.select("doc_id", "media"), REPORT, features)


def media_report(documents: DataFrame) -> DataFrame:
    """The digest row of every document: its text stored in a media column, and everything read back from that column."""
    return read_media(encode_texts(documents))
