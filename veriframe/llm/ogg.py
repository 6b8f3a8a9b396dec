"""Media columns: Ogg files written and read inside tasks.

Reading verifies page checksums, puts packets together from lacing values (over pages too), keeps
logical streams apart by serial number, and files that stand end to end (chained links) apart by
where streams begin anew, and derives times from granule positions."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
#: First packet of a stream of raw samples and of one of notes; a rate of 0 means no time.
HEAD = struct.Struct("<8sII")
AUDIO, NOTES = b"PCM u8  ", b"notes   "
RATE = 8000
FRAME = 4000
#: Bit-reversed bytes: Ogg's checksum runs from the high bit, zlib's from the low one.
REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """Ogg's CRC (0x04c11db7, from 0, high bit first) of a page whose checksum field is zero."""
    low_first = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{low_first:032b}"[::-1], 2)


def page(serial: int, number: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    """One page with its checksum; up to 255 lacing values, which add up to the body's length. An empty body is allowed."""
    head = PAGE.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def stream_pages(serial: int, packets: list[bytes], granules: list[int]) -> list[bytes]:
    """Pages of one logical stream; granules are the positions at the packets' ends. The first
    packet has a page of its own; a page without a packet's end has granule -1."""
    pages: list[bytes] = []
    lacing, body, granule, number, carried = bytearray(), bytearray(), -1, 0, False

    def flush(last: bool) -> None:
        nonlocal granule, number, carried
        flags = CONTINUED * carried | FIRST * (number == 0) | LAST * last
        pages.append(page(serial, number, granule, flags, bytes(lacing), bytes(body)))
        carried = bool(lacing) and lacing[-1] == 255
        lacing.clear()
        body.clear()
        granule, number = -1, number + 1

    for i, (packet, at) in enumerate(zip(packets, granules, strict=True)):
        view = memoryview(packet)
        values = [255] * (len(packet) // 255) + [len(packet) % 255]
        for k, v in enumerate(values):
            if len(lacing) == 255:
                flush(False)
            lacing.append(v)
            body += view[255 * k : 255 * k + v]
        granule = at
        if i == 0 and len(packets) > 1:
            flush(False)
    flush(True)
    return pages


def encode(payload: bytes, notes: bytes) -> bytes:
    """An Ogg file of two streams: payload as 8-bit samples, and notes. First pages come first, as
    the format asks; then pages alternate. Nothing depends on chance or time."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    ends = np.minimum(np.arange(1, len(frames) + 1) * FRAME, len(payload)).tolist()
    audio = stream_pages(1, [HEAD.pack(AUDIO, RATE, 8), *frames], [0, *ends])
    other = stream_pages(2, [HEAD.pack(NOTES, 0, 0), notes], [0, 0])
    out = [audio[0], other[0]]
    for i in range(1, max(len(audio), len(other))):
        out += audio[i : i + 1] + other[i : i + 1]
    return b"".join(out)


@dataclass
class Stream:
    serial: int
    link: int = 0
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    lost_pages: int = 0
    repeated_pages: int = 0
    bad_packets: int = 0
    ended: bool = False
    _partial: bytearray | None = None
    _next: int = 0

    def seconds(self) -> list[float | None]:
        """Time at each packet's end, None for packets that end inside a page or where there is no rate."""
        rate = HEAD.unpack(self.packets[0])[1] if self.packets and len(self.packets[0]) == HEAD.size else 0
        return [g / rate if rate and g >= 0 else None for g in self.granules]

    def add(self, number: int, granule: int, flags: int, lacing: bytes, body: memoryview) -> None:
        """Takes a page. Page numbers run modulo 2^32; one that goes back, and any page after the last one, is
        counted as repeated and gives nothing."""
        ahead = number - self._next & 0xFFFFFFFF
        if ahead >= 1 << 31 or self.ended:
            self.repeated_pages += 1
            return
        if ahead:
            self.lost_pages += ahead
            if self._partial is not None:
                self.bad_packets, self._partial = self.bad_packets + 1, None
        self._next, self.pages, self.ended = number + 1 & 0xFFFFFFFF, self.pages + 1, bool(flags & LAST)
        orphan = bool(flags & CONTINUED) and self._partial is None
        if not flags & CONTINUED and self._partial is not None:
            self.bad_packets, self._partial = self.bad_packets + 1, None
        at, done = 0, len(self.packets)
        for v in lacing:
            if not orphan:
                self._partial = self._partial if self._partial is not None else bytearray()
                self._partial += body[at : at + v]
            at += v
            if v < 255:
                if orphan:
                    self.bad_packets, orphan = self.bad_packets + 1, False
                else:
                    self.packets.append(bytes(self._partial))
                    self.granules.append(-1)
                    self._partial = None
        if len(self.packets) > done:
            self.granules[-1] = granule


@dataclass
class Decoded:
    """Streams in the order in which they begin; a serial number may come again in a later link."""

    every: list[Stream] = field(default_factory=list)
    links: int = 0
    bad_pages: int = 0
    skipped_bytes: int = 0
    _begins: bool = False

    @property
    def streams(self) -> dict[int, Stream]:
        """By serial number, the first link that has it."""
        return {s.serial: s for s in reversed(self.every)}

    def stream(self, serial: int, number: int, flags: int, again: bool) -> Stream:
        """The stream that a page belongs to. A first page begins a stream, and a link where pages that are no
        first ones came since or the link has its serial number; only one that is the page right before it again belongs to the stream that began."""
        known = next((s for s in reversed(self.every) if s.serial == serial), None)
        if known and not flags & FIRST:
            self._begins = False
            return known
        if known and again:
            return known
        if not self._begins or known and known.link == self.links - 1:
            self.links += 1
        self._begins = bool(flags & FIRST)
        found = Stream(serial, self.links - 1)
        if flags & FIRST:
            found._next = number
        self.every.append(found)
        return found


def decode(data: bytes) -> Decoded:
    """All streams of an Ogg file, of files end to end too. A page whose checksum is wrong is counted and left out; bytes that
    are no page are skipped up to the next page; a file cut short gives what is whole."""
    out, at, view, before = Decoded(), 0, memoryview(data), b""
    while at < len(data):
        start = data.find(b"OggS", at)
        if start < 0:
            out.skipped_bytes += len(data) - at
            break
        out.skipped_bytes += start - at
        before = before if start == at else b""
        at = start
        if len(data) - at < PAGE.size:
            out.skipped_bytes += len(data) - at
            break
        _, version, flags, granule, serial, number, crc, n = PAGE.unpack_from(data, at)
        lacing = data[at + PAGE.size : at + PAGE.size + n]
        end = at + PAGE.size + n + sum(lacing)
        whole = len(lacing) == n and end <= len(data) and version == 0
        if not whole or checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            out.bad_pages += 1
            out.skipped_bytes += 4
            at += 4
            continue
        out.stream(serial, number, flags, data[at:end] == before).add(number, granule, flags, lacing, view[at + PAGE.size + n : end])
        before, at = data[at:end], end
    return out


def by_kind(found: Decoded, kind: bytes) -> Stream | None:
    """The first stream whose first packet names the kind; None where none does."""
    return next((s for s in found.every if s.packets and s.packets[0][:8] == kind), None)


def features(samples: np.ndarray, seconds: list[float | None]) -> str:
    """Peak, mean, root mean square and sign changes of samples about 128, and the last packet's time."""
    x = samples.astype(np.int64) - 128
    changes = int((np.diff(np.signbit(x)) != 0).sum())
    at = next((s for s in reversed(seconds) if s is not None), 0.0)
    return f"peak={int(np.abs(x).max())};mean={x.sum() / len(x):.6f};rms={(float((x * x).sum()) / len(x)) ** 0.5:.6f};crossings={changes};seconds={at:.6f}"


STORED = "n_bytes long, media binary"
READ = (
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "n_streams long, n_packets long, bad_pages long, bad_packets long, n_links long, lost_pages long, repeated_pages long"
)


def store(text: str | None) -> tuple[int, bytes]:
    """A text's UTF-8 bytes with zeros up to a positive multiple of 64, as an Ogg file."""
    data = (text or "").encode("utf-8", "surrogatepass")
    padded = data + bytes(-len(data) % 64 or 64 * (not data))
    return len(data), encode(padded, f"n_bytes={len(data)}".encode())


def summary(media: bytes | None) -> tuple:
    """What READ names, of one file: the payload of the first sample stream, and counts over all links. Null is an empty file."""
    found = decode(media or b"")
    audio = by_kind(found, AUDIO)
    payload = b"".join(audio.packets[1:]) if audio else b""
    feature = features(np.frombuffer(payload, np.uint8), audio.seconds()) if payload else ""
    streams = found.every
    return (
        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media or b""), hashlib.sha256(media or b"").hexdigest(), feature,
        len(streams), sum(len(s.packets) for s in streams), found.bad_pages, sum(s.bad_packets for s in streams), found.links, sum(s.lost_pages for s in streams), sum(s.repeated_pages for s in streams),
    )


def write_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc, n_bytes, media) for every row; doc holds the row as it came. A null text is an empty one,
    stored as 64 zeros. Equal texts give equal files; repeated rows stay; no rows give none."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([store(t) for t in texts], columns=["n_bytes", "media"])

    return docs.select(F.struct("*").alias("doc"), F.pandas_udf(run, STORED, F.PandasUDFType.SCALAR_ITER)(F.col(text)).alias("m")).select("doc", "m.*")


def read_media(df: DataFrame, media: str = "media") -> DataFrame:
    """df with what its Ogg column holds: payload of the first sample stream, features, counts of
    streams, packets, links and faults. A null or broken file gives counts and an empty payload, no error."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in READ.split(", ")]
        for files in batches:
            yield pd.DataFrame([summary(f) for f in files], columns=names)

    udf = F.pandas_udf(run, READ, F.PandasUDFType.SCALAR_ITER)
    return df.select(F.struct("*").alias("row"), udf(F.col(media)).alias("read"))
