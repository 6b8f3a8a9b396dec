import hashlib
import random
import struct
import zlib

import pytest

from veriframe.llm import ogg
from veriframe.llm.queries import op7_ogg

from .texts import ROWS, frame


def slow_checksum(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def padded(text):
    data = (text or "").encode()
    return data + bytes(-len(data) % 64 if data else 64)


def test_checksum_equals_its_definition():
    rng = random.Random(3)
    for n in (0, 1, 27, 300):
        data = rng.randbytes(n)
        assert ogg.checksum(data) == slow_checksum(data)


@pytest.mark.parametrize("size", [0, 1, 254, 255, 256, 510, 255 * 255, 255 * 255 + 1, 200_000])
def test_packets_of_any_size_survive(size):
    packets = [b"first", bytes(i % 251 for i in range(size)), b"", b"last"]
    data = b"".join(ogg.stream_pages(9, packets, [0, size, size, size + 4]))
    found = ogg.decode(data)
    assert found.bad_pages == 0 and found.skipped_bytes == 0
    assert found.streams[9].packets == packets
    assert found.streams[9].ended and found.streams[9].bad_packets == 0 and found.streams[9].granules[-1] == size + 4


def test_two_streams_times_and_damage():
    payload = random.Random(4).randbytes(20_000)
    media = ogg.encode(payload, b"note")
    found = ogg.decode(media)
    audio, notes = ogg.by_kind(found, ogg.AUDIO), ogg.by_kind(found, ogg.NOTES)
    assert b"".join(audio.packets[1:]) == payload and notes.packets[1:] == [b"note"]
    assert max(s for s in audio.seconds() if s is not None) == 20_000 / ogg.RATE
    broken = bytearray(media)
    broken[len(media) // 2] ^= 1
    assert ogg.decode(bytes(broken)).bad_pages == 1
    assert ogg.decode(b"junk" + media[: len(media) // 3]).skipped_bytes >= 4
    for cut in range(0, 200, 7):
        ogg.decode(media[:cut])
    assert ogg.decode(b"").streams == {}
    assert struct.unpack_from("<4s", media)[0] == b"OggS"


def parts_of(media):
    """The pages of a file, by their stated lengths alone."""
    out, at = [], 0
    while at < len(media):
        n = media[at + 26]
        end = at + 27 + n + sum(media[at + 27 : at + 27 + n])
        out.append(media[at:end])
        at = end
    return out


def slow_payloads(media):
    """Payload of each sample stream, by the format's own terms: from a first page of serial 1 to its last."""
    found = []
    for page in parts_of(media):
        flags, serial, n = page[5], struct.unpack_from("<I", page, 14)[0], page[26]
        if serial == 1 and flags & 2:
            found.append(b"")
        if serial == 1 and not flags & 2:
            found[-1] += page[27 + n :]
    return found


def test_files_end_to_end_are_links_of_their_own():
    rng = random.Random(6)
    payloads = [rng.randbytes(n) for n in (512, 640, 9000, 64)]
    media = [ogg.encode(p, b"n") for p in payloads]
    for k in (1, 2, 4):
        found = ogg.decode(b"".join(media[:k]))
        assert found.links == k and len(found.every) == 2 * k and found.bad_pages == 0
        audio = [s for s in found.every if s.serial == 1]
        assert [b"".join(s.packets[1:]) for s in audio] == payloads[:k] == slow_payloads(b"".join(media[:k]))
        assert [s.link for s in audio] == list(range(k)) and all(s.ended and not (s.bad_packets or s.lost_pages or s.repeated_pages) for s in found.every)
        assert ogg.summary(b"".join(media[:k]))[:2] == (512, hashlib.sha256(payloads[0]).hexdigest())
    cut = media[2][: len(media[2]) // 2]  # a link that never ends
    found = ogg.decode(cut + media[1])
    assert found.links == 2 and b"".join(found.every[2].packets[1:]) == payloads[1] and not found.every[0].ended


def test_repeated_pages_are_counted_and_left_out():
    payload = random.Random(7).randbytes(200_000)
    parts = parts_of(ogg.encode(payload, b"n"))
    for i in range(len(parts)):
        found = ogg.decode(b"".join([*parts[: i + 1], parts[i], *parts[i + 1 :]]))
        assert b"".join(ogg.by_kind(found, ogg.AUDIO).packets[1:]) == payload
        assert (found.links, sum(s.repeated_pages for s in found.every), sum(s.bad_packets + s.lost_pages for s in found.every)) == (1, 1, 0)
    late = ogg.decode(b"".join([*parts, parts[-1], parts[4]]))
    assert b"".join(ogg.by_kind(late, ogg.AUDIO).packets[1:]) == payload and sum(s.repeated_pages for s in late.every) == 2
    lost = ogg.decode(b"".join([*parts[:4], *parts[5:]]))
    assert sum(s.lost_pages for s in lost.every) == 1


def test_awkward_rows_and_broken_media(spark):
    stored = ogg.write_media(frame(spark))
    rows = ogg.read_media(stored).select("row.doc.text", "row.n_bytes", "read.*").collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        want = padded(r["text"])
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
    broken = spark.createDataFrame([(None,), (b"",), (b"OggS",)], "media binary")
    assert [r["payload_bytes"] for r in ogg.read_media(broken).select("read.*").collect()] == [0, 0, 0]
    assert ogg.write_media(frame(spark, [])).count() == 0


def test_query_over_the_whole_table(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op7_ogg(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = padded(docs[r["doc_id"]])
        assert r["n_bytes"] == len((docs[r["doc_id"]] or "").encode())
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        assert r["bad_pages"] == 0
