"""Media columns in Ogg: texts' bytes stored as 8-bit samples and read back.

Layout written by ``wrap``: two logical streams in one physical stream, their pages dealt in turn.  Stream 1 holds the
samples, ``PACKET`` of them to a packet; stream 2 holds for each packet of stream 1 its CRC-32 (a packet of four bytes).  Each
stream begins with a header packet on a page of its own (name, rate, number of payload bytes).  A page's granule position is the
number of samples after the last packet that ends on it, or -1 if none ends there, so positions over the rate are timestamps.

``demux`` reads any Ogg bytes: it finds pages by their capture pattern, verifies each page's checksum (CRC-32 of polynomial
0x04C11DB7, not reflected, from zero), skips damaged pages, reassembles packets from lacing values over page boundaries, and
drops a packet of which a page is missing.

Defined results: null text counts as empty; the payload of the empty text is 64 zero bytes; repeated rows each give a row;
media that are null or no Ogg give no streams; texts of any length are stored whole; an empty table gives no rows; other columns
are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strata.llm.common import columns

RATE, PACKET, UNIT = 8000, 4096, 64
SAMPLES, CHECKS = 1, 2
_HEAD = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """The page's CRC: zlib's runs over reflected bits, so bytes and result are reversed."""
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


def pages_of(serial: int, packets: list[tuple[bytes, int]], first: int = 0, header: bool = False, last: bool = True) -> list[bytes]:
    """Pages of a logical stream for (packet, granule position after it) pairs, as full as lacing allows."""
    lacing: list[tuple[int, bytes, int]] = []  # (value, its bytes, granule position if the packet ends here, else -1)
    for data, granule in packets:
        for at in range(0, len(data) + 1, 255):
            part = data[at : at + 255]
            lacing.append((len(part), part, granule if len(part) < 255 else -1))
    out, carried = [], False
    for k in range(0, len(lacing), 255):
        some = lacing[k : k + 255]
        granule = max((g for _, _, g in some), default=-1)
        flags = carried | 2 * header | 4 * (last and k + 255 >= len(lacing))
        body = bytes(v for v, _, _ in some) + b"".join(p for _, p, _ in some)
        head = lambda crc: _HEAD.pack(b"OggS", 0, flags, granule, serial, first + len(out), crc, len(some))
        out.append(head(page_checksum(head(0) + body)) + body)
        carried = some[-1][0] == 255
    return out


def wrap(payload: bytes, n_bytes: int) -> bytes:
    """The Ogg bytes of a payload."""
    info = struct.pack("<8sIQ", b"u8-mono\0", RATE, n_bytes)
    ends = [min(at + PACKET, len(payload)) for at in range(0, len(payload), PACKET)]
    parts = [(payload[at : at + PACKET], e) for at, e in zip(range(0, len(payload), PACKET), ends)]
    checks = [(struct.pack("<I", zlib.crc32(p)), e) for p, e in parts]
    streams = [pages_of(serial, body, first=1) for serial, body in ((SAMPLES, parts), (CHECKS, checks))]
    out = [pages_of(serial, [(info, 0)], header=True, last=False)[0] for serial in (SAMPLES, CHECKS)]
    for k in range(max(map(len, streams))):
        out += [s[k] for s in streams if k < len(s)]
    return b"".join(out)


@dataclass
class LogicalStream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  #: -1 for a packet that is not the last to end on its page
    pages: int = 0
    lost: int = 0
    ended: bool = False
    _next: int = 0
    _part: list[bytes] | None = None


@dataclass
class Demuxed:
    streams: dict[int, LogicalStream]
    bad_pages: int


def demux(data: bytes) -> Demuxed:
    """Logical streams by serial number."""
    streams: dict[int, LogicalStream] = {}
    bad, at = 0, 0
    while (at := data.find(b"OggS", at)) >= 0:
        if at + 27 > len(data):
            bad += 1
            break
        _, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        page = data[at:end]
        if version or len(lacing) < n or end > len(data) or page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            bad += 1
            at += 4
            continue
        s = streams.setdefault(serial, LogicalStream(serial))
        gap = number != s._next
        if gap or (s._part is not None) != bool(flags & 1):
            s.lost += s._part is not None or gap
            s._part = None
        skipping = bool(flags & 1) and s._part is None  # the rest of a packet whose start is missing
        s.pages, s._next, s.ended = s.pages + 1, number + 1, s.ended or bool(flags & 4)
        pos, last = at + 27 + n, None
        for v in lacing:
            part = data[pos : pos + v]
            pos += v
            if skipping:
                skipping = v == 255
                continue
            s._part = (s._part or []) + [part] if len(s._part or []) < 64 else [b"".join(s._part), part]
            if v < 255:
                s.packets.append(b"".join(s._part))
                s.granules.append(-1)
                s._part, last = None, len(s.packets) - 1
        if last is not None:
            s.granules[last] = granule
        at = end
    for s in streams.values():
        s.lost += s._part is not None
    return Demuxed(streams, bad)


def unwrap(media: bytes) -> dict:
    """Payload and features of Ogg bytes that ``wrap`` made; raises ValueError if any of it is missing or damaged."""
    found = demux(media)
    if found.bad_pages or set(found.streams) != {SAMPLES, CHECKS} or any(s.lost or not s.ended for s in found.streams.values()):
        raise ValueError("damaged or incomplete Ogg data")
    samples, checks = found.streams[SAMPLES], found.streams[CHECKS]
    _, rate, n_bytes = struct.unpack("<8sIQ", samples.packets[0])
    body = samples.packets[1:]
    if [struct.pack("<I", zlib.crc32(p)) for p in body] != checks.packets[1:]:
        raise ValueError("a packet differs from its checksum")
    payload = b"".join(body)
    ends = [g for g in samples.granules[1:] if g >= 0]
    if not ends or ends[-1] != len(payload):  # in samples: seconds times the rate can differ by rounding
        raise ValueError("granule positions do not fit the samples")
    times = [g / rate for g in ends]
    total = int(np.frombuffer(payload, np.uint8).sum(dtype=np.int64))
    return {"n_bytes": n_bytes, "payload": payload, "rate": rate, "times": times, "pages": samples.pages + checks.pages,
            "packets": len(samples.packets) + len(checks.packets), "mean": total / len(payload)}


def padded(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % UNIT or (0 if raw else UNIT))


def store(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, media binary): each whole text as Ogg bytes."""

    def run(batches):
        for batch in batches:
            keys, texts = columns(batch, key, text)
            raws = [(x or "").encode() for x in texts.to_pylist()]
            for a in range(0, len(raws), 256):
                yield pa.RecordBatch.from_arrays([keys.slice(a, 256), pa.array([wrap(padded(r), len(r)) for r in raws[a : a + 256]], pa.binary())], [key, "media"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, media binary")


_FEATURES = ["n_bytes long", "payload_bytes long", "payload_sha256 string", "tail_crc32 long", "media_bytes long", "media_sha256 string", "feature string", "duration_s double"]


def features(media: bytes) -> tuple:
    found = unwrap(media)
    payload = found["payload"]
    feature = f"streams=2;pages={found['pages']};packets={found['packets']};rate={found['rate']};end_us={round(found['times'][-1] * 1e6)};mean={found['mean']:.6f}"
    return (found["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media),
            hashlib.sha256(media).hexdigest(), feature, found["times"][-1])


def describe(media: DataFrame, column: str = "media", key: str = "doc_id", strict: bool = False) -> DataFrame:
    """(key, features): reads media back; null media have null features, damaged ones too, or fail the query if ``strict``."""

    def one(data):
        try:
            return features(data) if data is not None else (None,) * len(_FEATURES)
        except ValueError:
            if strict:
                raise
            return (None,) * len(_FEATURES)

    def run(batches):
        kinds = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]] for c in _FEATURES]
        for batch in batches:
            keys, data = columns(batch, key, column)
            cols = list(zip(*(one(x.as_py()) for x in data))) or [()] * len(_FEATURES)
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(list(c), k) for c, k in zip(cols, kinds))], [key, *(c.split()[0] for c in _FEATURES)])

    kind = media.schema[key].dataType.simpleString()
    return media.select(key, column).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(_FEATURES))
