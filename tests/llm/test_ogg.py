from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import pytest

from strata.llm import ogg


def test_checksum_bit_by_bit():
    def slow(data):
        crc = 0
        for byte in data:
            crc ^= byte << 24
            for _ in range(8):
                crc = (crc << 1 ^ 0x04C11DB7 if crc & 1 << 31 else crc << 1) & 0xFFFFFFFF
        return crc

    for data in (b"", b"OggS", bytes(range(256)) * 3):
        assert ogg.page_checksum(data) == slow(data)


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 254, 255, 256, 4096, 4097, 130_000, 1_200_000])
def test_round_trip(size):
    raw = bytes((k * 31) & 255 for k in range(min(size, 5000))) * (size // 5000 + 1)
    raw = raw[:size]
    payload = ogg.padded(raw)
    assert len(payload) % 64 == 0 and len(payload) >= 64
    found = ogg.unwrap(ogg.wrap(payload, size))
    assert (found["payload"], found["n_bytes"]) == (payload, size) and found["times"][-1] == len(payload) / ogg.RATE


def test_lengths_whose_seconds_round(make):
    """64,064 samples over the rate, times the rate, are not 64,064."""
    sizes = [n for n in range(64, 600_000, 64) if n / ogg.RATE * ogg.RATE != n]
    assert len(sizes) > 100 and sizes[0] == 64_064
    for n in (*sizes[:20], *sizes[-20:]):
        assert len(ogg.unwrap(ogg.wrap(b"a" * n, n))["payload"]) == n
    texts = [(k, "a" * n) for k, n in enumerate(sizes[:3])]
    assert [r.payload_bytes for r in ogg.describe(ogg.store(make(texts)), strict=True).orderBy("doc_id").collect()] == sizes[:3]


@pytest.mark.parametrize("size", [0, 255, 510, 65_024, 65_025, 65_026, 200_000])
def test_packets_over_pages(size):
    packets = [(b"a" * size, 5), (b"", 6), (b"xyz", 9)]
    found = ogg.demux(b"".join(ogg.pages_of(7, packets)))
    stream = found.streams[7]
    assert stream.packets == [p for p, _ in packets] and stream.granules[-1] == 9 and stream.ended and not found.bad_pages and not stream.lost


def test_streams_apart_and_damage():
    one, two = ogg.pages_of(1, [(b"a" * 70_000, 1), (b"b", 2)]), ogg.pages_of(2, [(b"c" * 70_000, 1)])
    mixed = [p for pair in zip(one, two) for p in pair]
    found = ogg.demux(b"junk" + b"".join(mixed))
    assert found.streams[1].packets == [b"a" * 70_000, b"b"] and found.streams[2].packets == [b"c" * 70_000]
    broken = bytearray(b"".join(mixed))
    broken[500] ^= 1
    found = ogg.demux(bytes(broken))
    assert found.bad_pages >= 1 and found.streams[1].packets == [b"b"] and found.streams[1].lost and found.streams[2].packets == [b"c" * 70_000]
    assert ogg.demux(b"").streams == {} and ogg.demux(b"OggS").bad_pages == 1


def plain_reader(media):
    """Streams of undamaged Ogg bytes, byte by byte: serial to (packets, granule positions, pages)."""
    def crc_of(page):
        crc = 0
        for byte in page[:22] + b"\0" * 4 + page[26:]:
            crc ^= byte << 24
            for _ in range(8):
                crc = (crc << 1 ^ 0x04C11DB7 if crc & 1 << 31 else crc << 1) & 0xFFFFFFFF
        return crc

    streams, at = {}, 0
    while at < len(media):
        assert media[at : at + 5] == b"OggS\0"
        number = lambda a, b: int.from_bytes(media[at + a : at + b], "little", signed=a == 6)  # noqa: E731, B023
        lacing = media[at + 27 : at + 27 + media[at + 26]]
        packets, granules, pages, part = streams.setdefault(number(14, 18), ([], [], [0], [b""]))
        assert number(18, 22) == pages[0]
        pages[0] += 1
        size = 27 + len(lacing) + sum(lacing)
        assert crc_of(media[at : at + size]) == number(22, 26)
        pos, granule = at + 27 + len(lacing), number(6, 14)
        for value in lacing:
            part[0] += media[pos : pos + value]
            pos += value
            if value < 255:
                packets.append(part[0])
                part[0] = b""
        granules.append(granule)
        at += size
    return streams


def test_features_by_a_plain_reader(make):
    texts = ["", "short", "x" * 64, "caf" + chr(233) * 3000, "words and more " * 900]
    found = {r.doc_id: r for r in ogg.describe(ogg.store(make(list(enumerate(texts)))), strict=True).collect()}
    stored = {r.doc_id: bytes(r.media) for r in ogg.store(make(list(enumerate(texts)))).collect()}
    for k, text in enumerate(texts):
        media, r = stored[k], found[k]
        assert (len(media), hashlib.sha256(media).hexdigest()) == (r.media_bytes, r.media_sha256)
        (one, granules, pages, _), (two, _, more, _) = (plain_reader(media)[n] for n in (1, 2))
        payload = b"".join(one[1:])
        assert payload == ogg.padded(text.encode()) and hashlib.sha256(payload).hexdigest() == r.payload_sha256
        assert [int.from_bytes(p, "little") for p in two[1:]] == [zlib.crc32(p) for p in one[1:]]
        assert r.feature == f"streams=2;pages={pages[0] + more[0]};packets={len(one) + len(two)};rate=8000;end_us={round(max(granules) / 8000 * 1e6)};mean={sum(payload) / len(payload):.6f}"


def test_damage_fails_the_query_if_strict(spark):
    bad = spark.createDataFrame([(1, b"OggS but no media")], "doc_id long, media binary")
    with pytest.raises(Exception, match="damaged or incomplete"):
        ogg.describe(bad, strict=True).collect()


def test_query(docs, rows, spark):
    got = Counter(tuple(r)[:5] for r in ogg.describe(ogg.store(docs)).collect())
    want = Counter((k, len(b := (t or "").encode()), len(p := ogg.padded(b)), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for k, t in rows)
    assert got == want
    by_text = {}
    for r, in zip(ogg.describe(ogg.store(docs)).select("payload_sha256", "n_bytes", "media_sha256", "feature").collect()):
        assert by_text.setdefault((r.payload_sha256, r.n_bytes), (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    bad = spark.createDataFrame([(1, b"no media"), (2, None)], "doc_id long, media binary")
    assert [r.n_bytes for r in ogg.describe(bad).collect()] == [None, None]


def test_empty(empty):
    assert ogg.describe(ogg.store(empty)).count() == 0
