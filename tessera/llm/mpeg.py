"""MPEG audio columns: frames, tags, variable-bitrate tables, checksums, seek offsets.

``parse`` reads the bytes of an MPEG-1/2/2.5 Layer I-III stream: it skips and
reads ID3 tags, finds frame headers again after junk, reads Xing/Info and VBRI
tables, verifies frame checksums and gives exact durations (samples over
sample rate, as a fraction) and the offset of every frame.  ``probe`` does so
for a binary column.  ``build`` writes a valid Layer III stream that carries a
payload in its frames (silent frames whose main data is ancillary data), with
checksums, an ID3v2 tag and a Xing table; ``payload`` takes it out again.

Edge cases: null or empty media have no frames and duration 0; bytes without a
frame count as junk; a frame that the end of the data cuts off is not counted
and its bytes are junk.  Layer II checksums cover a bit allocation whose size
needs decoding and are reported as unchecked.  Rows are independent, so ties
and repeated rows give equal results.  Memory follows 4 MB of media or the
longest one.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blocks import blocks, utf8

# Fixed values of the format: kbit/s by (MPEG-1?, layer), Hz by version, samples by (MPEG-1?, layer).
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {"1": (44100, 48000, 32000), "2": (22050, 24000, 16000), "2.5": (11025, 12000, 8000)}
SAMPLES = {(True, 1): 384, (True, 2): 1152, (True, 3): 1152, (False, 1): 384, (False, 2): 1152, (False, 3): 576}


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1) ^ (0x8005 if c & 0x8000 else 0)
        out.append(c & 0xFFFF)
    return out


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    """The checksum of frames: polynomial 0x8005, initial value 0xFFFF."""
    c = 0xFFFF
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ _CRC[(c >> 8) ^ b]
    return c


@dataclass(frozen=True)
class Header:
    version: str
    layer: int
    bitrate: int
    rate: int
    channels: int
    protected: bool
    samples: int
    size: int
    side: int

    @property
    def family(self) -> tuple:
        """What all frames of a stream have in common."""
        return self.version, self.layer, self.rate


_headers: dict[bytes, Header | None] = {}


def header(raw: bytes) -> Header | None:
    """The frame header in four bytes, or None where they are none (free-format frames included)."""
    if raw in _headers:
        return _headers[raw]
    h = None
    if len(raw) == 4 and raw[0] == 0xFF and raw[1] & 0xE0 == 0xE0:
        version = {0: "2.5", 2: "2", 3: "1"}.get(raw[1] >> 3 & 3)
        layer, index, rate = 4 - (raw[1] >> 1 & 3), raw[2] >> 4, raw[2] >> 2 & 3
        if version and layer < 4 and 0 < index < 15 and rate < 3:
            one = version == "1"
            kbps, hz, pad = BITRATES[one, layer][index], RATES[version][rate], raw[2] >> 1 & 1
            samples = SAMPLES[one, layer]
            size = (12 * kbps * 1000 // hz + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hz + pad
            mono = raw[3] >> 6 == 3
            side = 0 if layer < 3 else (17 if mono else 32) if one else (9 if mono else 17)
            h = Header(version, layer, kbps, hz, 1 if mono else 2, not raw[1] & 1, samples, size, side)
    if len(_headers) > 1 << 16:
        _headers.clear()
    _headers[raw] = h
    return h


_sums: dict[bytes, int] = {}


def checksum(data: bytes, at: int, h: Header) -> bool | None:
    """Whether a frame's checksum holds; None if it has none or it can't be checked."""
    if not h.protected or h.layer == 2:
        return None
    n = h.side if h.layer == 3 else 16 * h.channels
    covered = data[at + 2 : at + 4] + data[at + 6 : at + 6 + n]
    if covered not in _sums:
        if len(_sums) > 1 << 12:
            _sums.clear()
        _sums[covered] = crc16(covered)
    return _sums[covered] == data[at + 4] << 8 | data[at + 5]


@dataclass
class Audio:
    tags: dict[str, str] = field(default_factory=dict)
    vbr: dict | None = None
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    junk: int = 0
    crc_ok: int = 0
    crc_bad: int = 0

    @property
    def duration(self) -> Fraction:
        """Seconds of the frames, exactly."""
        total: dict[int, int] = {}
        for h in self.headers:
            total[h.rate] = total.get(h.rate, 0) + h.samples
        return sum((Fraction(n, r) for r, n in total.items()), Fraction(0))


def _safe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def _id3v2(data: bytes, tags: dict[str, str]) -> int:
    """Reads text frames of an ID3v2 tag at the start; its length, 0 without one."""
    if len(data) < 10 or data[:3] != b"ID3" or max(data[6:10]) > 127:
        return 0
    major, size = data[3], _safe(data[6:10])
    end, at = 10 + size, 10
    while major in (3, 4) and at + 10 <= min(end, len(data)) and data[at : at + 4].strip(b"\0"):
        name = data[at : at + 4].decode("latin-1")
        n = _safe(data[at + 4 : at + 8]) if major == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + 10 : at + 10 + n]
        if name[0] == "T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace")
            if name == "TXXX":
                name, _, text = text.partition("\0")
            tags[name] = text.rstrip("\0")
        at += 10 + n
    return end + 10 * (data[5] >> 4 & 1)


def _vbr(data: bytes, at: int, h: Header) -> dict | None:
    """The Xing/Info or VBRI table of a first frame."""
    for x in (at + 4 + h.side, at + 6 + h.side):
        if data[x : x + 4] in (b"Xing", b"Info"):
            flags, p = int.from_bytes(data[x + 4 : x + 8], "big"), x + 8
            out = {"kind": data[x : x + 4].decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name] = int.from_bytes(data[p : p + 4], "big")
                    p += 4
            if flags & 4:
                out["toc"] = list(data[p : p + 100])
            return out
    x = at + 36
    if data[x : x + 4] == b"VBRI" and len(data) >= x + 26:
        size, frames, entries, scale, width, per = struct.unpack(">IIHHHH", data[x + 10 : x + 26])
        table = [scale * int.from_bytes(data[x + 26 + k * width : x + 26 + (k + 1) * width], "big") for k in range(entries)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": table, "frames_per_entry": per}
    return None


def parse(data: bytes | None) -> Audio:
    """Reads a stream; frames are counted without the one that holds a table."""
    out = Audio()
    data = data or b""
    at, end = min(_id3v2(data, out.tags), len(data)), len(data)
    if end - at >= 128 and data[-128:-125] == b"TAG":
        end -= 128
        out.tags.setdefault("TIT2", data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1"))
    family, first, expected = None, True, -1
    while at + 4 <= end:
        h = header(data[at : at + 4])
        if h and (at + h.size > end or h.size < 4 or family and h.family != family):
            h = None
        if h and at != expected and not checksum(data, at, h) and at + h.size + 4 <= end:
            # a start, or a new start after junk, without a checksum that holds: another frame must follow
            following = header(data[at + h.size : at + h.size + 4])
            if following is None or following.family != h.family:
                h = None
        if h is None:
            step = data.find(b"\xff", at + 1, end)
            step = end if step < 0 else step
            out.junk += step - at
            at = step
            continue
        ok = checksum(data, at, h)
        out.crc_ok += ok is True
        out.crc_bad += ok is False
        table = _vbr(data, at, h) if first and h.layer == 3 else None
        if table:
            out.vbr = table
        else:
            out.offsets.append(at)
            out.headers.append(h)
        family, first = h.family, False
        at = expected = at + h.size
    out.junk += end - at
    return out


# 32 kHz mono MPEG-1 Layer III with checksums: a frame has 144 * kbps / 32 bytes.
_HEAD = 4 + 2 + 17
_FRAMES = []
for _index in range(1, 15):
    _raw = bytes((0xFF, 0xFA, _index << 4 | 2 << 2, 0xC0))
    _FRAMES.append((header(_raw).size, _raw + crc16(_raw[2:] + bytes(17)).to_bytes(2, "big") + bytes(17)))


def _text_frame(name: bytes, body: bytes) -> bytes:
    return name + len(body).to_bytes(4, "big") + b"\0\0" + body


def build(payload: bytes) -> bytes:
    """A stream of the fewest frames that carries a payload; an ID3v1 tag ends it where its own bytes would read as one."""
    big, head = _FRAMES[-1]
    room = big - _HEAD
    full, rest = divmod(len(payload), room)
    parts = [head + payload[k * room : (k + 1) * room] for k in range(full)]
    if rest:
        size, head = next(f for f in _FRAMES if f[0] - _HEAD >= rest)
        parts.append((head + payload[full * room :]).ljust(size, b"\0"))
    tag = _text_frame(b"TXXX", b"\3payload_bytes\0" + str(len(payload)).encode())
    n = len(tag)
    tag = b"ID3\3\0\0" + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + tag
    size, head = next(f for f in _FRAMES if f[0] - _HEAD >= 116)
    total = size + sum(map(len, parts))
    ends, toc = [size], []
    for p in parts:
        ends.append(ends[-1] + len(p))
    for k in range(100):
        toc.append(min(255, 256 * ends[k * len(parts) // 100] // total))
    table = b"Xing" + (7).to_bytes(4, "big") + len(parts).to_bytes(4, "big") + total.to_bytes(4, "big") + bytes(toc)
    out = b"".join([tag, (head + table).ljust(size, b"\0"), *parts])
    return out + b"TAG".ljust(127, b"\0") + b"\xff" if out[-128:-125] == b"TAG" else out


def payload(data: bytes, audio: Audio) -> bytes:
    """What ``build`` stored; an error if some of it is missing."""
    body = b"".join([data[at + 6 + h.side : at + h.size] for at, h in zip(audio.offsets, audio.headers, strict=True)])
    n = int(audio.tags["payload_bytes"])
    if len(body) < n:
        raise ValueError(f"the stream has {len(body)} of {n} payload bytes")
    return body[:n]


def features(a: Audio) -> dict:
    """Durations and counts of a stream; offsets as a digest."""
    d = a.duration
    return {
        "duration": f"{d.numerator}/{d.denominator}",
        "frames": len(a.offsets),
        "kbps": sorted({h.bitrate for h in a.headers}),
        "rate": a.headers[0].rate if a.headers else 0,
        "table_frames": a.vbr.get("frames") if a.vbr else None,
        "crc_ok": a.crc_ok,
        "crc_bad": a.crc_bad,
        "junk": a.junk,
        "seek_sha256": hashlib.sha256(",".join(map(str, a.offsets)).encode()).hexdigest()[:16],
    }


PROBE = "duration_s double, samples long, sample_rate int, n_frames long, offsets array<long>, vbr_kind string, vbr_frames long, crc_ok long, crc_bad long, junk_bytes long, tags map<string,string>"


def probe(media: DataFrame, column: str = "media") -> DataFrame:
    """Adds what ``parse`` finds in a binary column, frame offsets included."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    added = _parse_datatype_string(PROBE).fields
    names = {f.name for f in added}
    kept = media.select(F.col(column).alias("__media"), *[c for c in media.columns if c != column and c not in names])
    schema = StructType([*kept.schema.fields[1:], *added])

    def run(batches):
        kinds = [pa.float64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string())]
        for batch in batches:
            size = np.array([len(m) if m is not None else 0 for m in (x.as_buffer() for x in batch.column(0))], np.int64)
            for i, j in blocks(np.concatenate(([0], np.cumsum(size))), 4 << 20):
                rows = []
                for row in range(i, j):
                    a = parse(batch.column(0)[row].as_py())
                    rows.append((float(a.duration), sum(h.samples for h in a.headers), a.headers[0].rate if a.headers else None, len(a.offsets), a.offsets, a.vbr and a.vbr["kind"], a.vbr and a.vbr.get("frames"), a.crc_ok, a.crc_bad, a.junk, list(a.tags.items())))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns[1:], *[pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names=schema.names)

    return kept.mapInArrow(run, schema)


def store(docs: DataFrame, text: str = "text", into: str = "media") -> DataFrame:
    """Adds each text's stream: its UTF-8 bytes, padded to a positive multiple of 64."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    kept = docs.select(F.col(text).alias("__text"), *[c for c in docs.columns if c != into])
    schema = StructType([*kept.schema.fields[1:], StructField(into, BinaryType())])

    def run(batches):
        for batch in batches:
            data, off = utf8(batch.column(0))
            for i, j in blocks(off, 4 << 20):
                built = [build(padded(data[off[k] : off[k + 1]].tobytes())) for k in range(i, j)]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns[1:], pa.array(built, pa.binary())], names=schema.names)

    return kept.mapInArrow(run, schema)


def padded(raw: bytes) -> bytes:
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def op8_mpeg_audio(spark, sf_dir: str) -> DataFrame:
    """Stores each text in a stream, reads the stream back and describes it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches):
        sha = hashlib.sha256
        for batch in batches:
            data, off = utf8(batch.column(1))
            for i, j in blocks(off, 4 << 20):
                rows = []
                for k in range(i, j):
                    raw = data[off[k] : off[k + 1]].tobytes()
                    media = build(padded(raw))
                    audio = parse(media)
                    back = payload(media, audio)
                    rows.append((len(raw), len(back), sha(back).hexdigest(), zlib.crc32(back[-64:]), len(media), sha(media).hexdigest(), json.dumps(features(audio), separators=(",", ":"))))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=[x.split(" ")[0] for x in schema.split(", ")])

    return docs.mapInArrow(run, schema)
