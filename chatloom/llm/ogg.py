"""Ogg: pages with verified checksums, packets reassembled from lacing values, logical streams
told apart by serial number, and timestamps derived from granule positions.

A page's checksum is the CRC with polynomial 0x04C11DB7, most significant bit first, from 0,
over the page with its checksum field zeroed. zlib's CRC is the same polynomial with bits
reversed, so it serves after reversing each byte's bits and starting its register at 0.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPTURE = b"OggS"
HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
NO_PACKET_ENDS = -1
REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """The checksum of a page whose checksum field is zero."""
    raw = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(REVERSED), "big")


@dataclass
class Page:
    at: int
    serial: int
    sequence: int
    flags: int
    granule: int
    lacing: bytes
    body: bytes
    size: int
    ok: bool


def pages(data: bytes) -> Iterator[Page]:
    """The pages of a physical stream; after damage the next capture pattern is looked for. A
    page with a wrong checksum or cut short is told by ``ok``."""
    at = 0
    while (at := data.find(CAPTURE, at)) >= 0:
        if at + HEAD.size > len(data):
            return
        _, version, flags, granule, serial, sequence, crc, segments = HEAD.unpack_from(data, at)
        lacing = data[at + HEAD.size : at + HEAD.size + segments]
        start = at + HEAD.size + segments
        size = HEAD.size + segments + sum(lacing)
        whole = version == 0 and len(lacing) == segments and at + size <= len(data)
        ok = whole and page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : at + size]) == crc
        yield Page(at, serial, sequence, flags, granule, lacing, data[start : at + size], size, ok)
        at += size if ok else 4


@dataclass
class Stream:
    """One logical stream: its packets with the granule position of the page on which they
    end (None for all but the last that ends there), and what is wrong with it."""

    serial: int
    packets: list[tuple[bytes, int | None]] = field(default_factory=list)
    pages: int = 0
    lost: int = 0
    ended: bool = False
    last: int | None = None
    open: bytearray | None = None


def demultiplex(data: bytes) -> tuple[dict[int, Stream], int]:
    """Logical streams by serial number, and the number of bad pages. A packet that misses a
    page is dropped; ``lost`` counts gaps in the page numbers."""
    streams: dict[int, Stream] = {}
    bad = 0
    for p in pages(data):
        if not p.ok:
            bad += 1
            continue
        s = streams.setdefault(p.serial, Stream(p.serial))
        gap = s.last is not None and p.sequence != (s.last + 1) & 0xFFFFFFFF
        s.lost += gap
        if gap or not p.flags & CONTINUED:
            s.open = None
        s.last, s.pages, s.ended = p.sequence, s.pages + 1, s.ended or bool(p.flags & LAST)
        skip = bool(p.flags & CONTINUED) and s.open is None
        part, at, ends = s.open or bytearray(), 0, []
        for n in p.lacing:
            part += p.body[at : at + n]
            at += n
            if n < 255:
                if not skip:
                    ends.append(len(s.packets))
                    s.packets.append((bytes(part), None))
                part, skip = bytearray(), False
        s.open = part if p.lacing[-1:] == b"\xff" and not skip else None
        if ends and p.granule != NO_PACKET_ENDS:
            s.packets[ends[-1]] = (s.packets[ends[-1]][0], p.granule)
    return streams, bad


def multiplex(streams: dict[int, list[tuple[bytes, int]]], body: int = 4096) -> bytes:
    """A physical stream of packets (bytes, granule position at their end) by serial number.
    First pages come first; then the streams' pages alternate, each filled to about ``body``
    bytes and packets running over from page to page."""
    todo: dict[int, list[tuple[int, int, bytes, bytes]]] = {}
    for serial, packets in streams.items():
        out, lacing, held, granule, flags = [], bytearray(), bytearray(), NO_PACKET_ENDS, FIRST
        for i, (packet, end) in enumerate(packets):
            sizes = [255] * (len(packet) // 255) + [len(packet) % 255]
            at = 0
            for k, n in enumerate(sizes):
                if lacing and (len(lacing) == 255 or (i > 0 and len(held) >= body)):
                    out.append((flags, granule, bytes(lacing), bytes(held)))
                    lacing, held, granule, flags = bytearray(), bytearray(), NO_PACKET_ENDS, CONTINUED if k else 0
                lacing.append(n)
                held += packet[at : at + n]
                at += n
            granule = end
            if i == 0:  # a stream's first packet has a page of its own
                out.append((flags, granule, bytes(lacing), bytes(held)))
                lacing, held, granule, flags = bytearray(), bytearray(), NO_PACKET_ENDS, 0
        if lacing:
            out.append((flags, granule, bytes(lacing), bytes(held)))
        todo[serial] = out
    order = [(serial, 0) for serial in todo if todo[serial]]
    order += sorted(((s, n) for s in todo for n in range(1, len(todo[s]))), key=lambda x: (x[1], list(todo).index(x[0])))
    data = bytearray()
    for serial, n in order:
        flags, granule, lacing, held = todo[serial][n]
        flags |= LAST if n == len(todo[serial]) - 1 else 0
        page = HEAD.pack(CAPTURE, 0, flags, granule, serial, n, 0, len(lacing)) + lacing + held
        data += page[:22] + struct.pack("<I", page_crc(page)) + page[26:]
    return bytes(data)


#: Bytes of a frame, frames of a packet, frames a second, and the streams' serial numbers.
FRAME, FRAMES, RATE = 192, 7, 250
SERIALS = (0x0A55E001, 0x0A55E002)
IDENT = struct.Struct("<8sIIIQ")


def store(payload: bytes) -> bytes:
    """8-bit samples in frames of FRAME bytes, dealt in packets of FRAMES frames alternately to
    two logical streams. A granule position is the number of the last frame plus one in the
    whole payload; the first packet of a stream states rate, frame and payload size."""
    step = FRAME * FRAMES
    streams: dict[int, list[tuple[bytes, int]]] = {}
    for k, serial in enumerate(SERIALS):
        head = IDENT.pack(b"PCM8FRAM", RATE, FRAME, FRAMES, len(payload))
        body = [(payload[at : at + step], min(len(payload), at + step) // FRAME) for at in range(k * step, len(payload), 2 * step)]
        streams[serial] = [(head, 0), *body]
    return multiplex(streams)


def load(media: bytes) -> tuple[bytes, dict]:
    """The payload read back from ``store``'s form, with what was found on the way. Packets
    without a granule position of their own count back from the next that has one."""
    streams, bad = demultiplex(media)
    timed, size = [], 0
    for serial in sorted(streams):
        head, *packets = streams[serial].packets
        magic, rate, frame, frames, size = IDENT.unpack(head[0])
        if magic != b"PCM8FRAM":
            raise ValueError("not a frame stream")
        end = None
        for packet, granule in reversed(packets):
            end = granule if granule is not None else end - 2 * frames if end % frames == 0 else end - end % frames - frames
            timed.append((end - len(packet) // frame, end, packet))
    timed.sort(key=lambda x: x[0])
    payload = b"".join(x[2] for x in timed)
    if len(payload) != size:
        raise ValueError("packets are missing")
    found = {"streams": len(streams), "pages": sum(s.pages for s in streams.values()), "packets": sum(len(s.packets) for s in streams.values()), "bad": bad, "lost": sum(s.lost for s in streams.values()), "ms": (timed[-1][1] * 1000 // RATE) if timed else 0, "gaps": sum(a[1] != b[0] for a, b in zip(timed, timed[1:], strict=False))}
    return payload, found


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            cols: list[list] = [[] for _ in range(7)]
            for t in part.column(1):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                payload = raw + b" " * (max(FRAME, -(-len(raw) // FRAME) * FRAME) - len(raw))
                media = store(payload)
                back, found = load(media)
                feature = ";".join(f"{k}={v}" for k, v in found.items()) + f";mean={sum(back) / len(back):.4f}"
                for c, v in zip(cols, (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, cols)], OUT)


OUT = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def round_trip(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Carry every text through Ogg and back: its UTF-8 bytes (none for a null text), padded
    with spaces to a positive multiple of FRAME, are stored, read back and described. Equal
    texts give equal values; repeated rows each give a row; an empty table gives none; other
    columns are ignored."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_carry, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for key, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            streams, bad = demultiplex(data.as_py() or b"")
            rows = [(key, s.serial, i, p, g, bad, s.lost) for s in streams.values() for i, (p, g) in enumerate(s.packets)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "serial", "packet", "data", "granule", "bad_pages", "lost_pages"])


def packets(media: DataFrame, data: str = "media", key: str = "doc_id", rate: int = RATE) -> DataFrame:
    """One row for each packet of each logical stream of the Ogg files in column ``data``:
    ``doc_id, serial, packet, data, granule, bad_pages, lost_pages, seconds``. ``granule`` and
    ``seconds`` (at ``rate`` granules a second) are null where no page states them. Null,
    empty and foreign bytes give no rows; damaged pages are left out and counted."""
    rows = media.select(F.col(key).cast("long").alias("doc_id"), F.col(data).alias("data"))
    out = rows.mapInArrow(_packets, "doc_id long, serial long, packet long, data binary, granule long, bad_pages long, lost_pages long")
    return out.withColumn("seconds", F.col("granule") / rate)
