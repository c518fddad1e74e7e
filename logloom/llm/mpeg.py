"""MPEG audio in binary columns: frames, tags, variable-bitrate tables, checksums, exact durations and seek offsets.

`parse` reads any MPEG-1, 2 or 2.5 audio stream of layers I to III. It reads the fields of ID3v2 tags at the beginning and
of an ID3v1 tag behind the frames (bytes that a frame in step holds are never taken for a tag), searches for the next
header where a frame does not follow, and accepts a header only if another follows it or the stream ends there. Checksums
are recomputed over what they protect: the header's last two bytes and, in Layer III, the side information, in Layer I
and II the bit allocation and, in Layer II, the scale factor selection. `store` writes bytes as the ancillary part of
silent Layer III frames (48 kHz, mono, 80 kbit/s: 240 bytes, of which 192 are payload) behind an ID3v2 tag and a Xing
frame with a seek table, and `payload_of` reads them back, whatever they are.

A null is stored like an empty payload, and a null stream has no frames; a repeated row gives a row each time, an empty
table none. `with_facts` refuses a column name that is there already; other columns pass through.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = 192
# Fixed values of the format: kbit/s by (version 1?, layer), and Hz by version bits.
KBPS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
CRC_POLYNOMIAL = 0x8005
#: Layer II allocation widths by the number of subbands, and those of the low sample rates.
LAYER2 = {27: (4,) * 11 + (3,) * 12 + (2,) * 4, 30: (4,) * 11 + (3,) * 12 + (2,) * 7, 8: (4,) * 2 + (3,) * 6, 12: (4,) * 2 + (3,) * 10}
LAYER2_LOW_RATE = (4,) * 4 + (3,) * 7 + (2,) * 19


@dataclass(frozen=True)
class Header:
    length: int
    samples: int
    hz: int
    kbps: int
    layer: int
    side: int  #: bytes of Layer III side information
    protected: bool
    version1: bool
    channels: int
    bound: int  #: the first subband that joint stereo shares; 32 without it


@dataclass
class Audio:
    offsets: list[int]
    headers: list[Header]
    crc_good: int = 0
    crc_bad: int = 0
    skipped: int = 0  #: bytes outside tags and frames
    tag_bytes: int = 0
    table: dict | None = None  #: what a Xing, Info or VBRI frame says
    tags: list[tuple[str, str]] = field(default_factory=list)  #: (frame or field, text) in the order of the stream

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.headers)

    @property
    def seconds(self) -> Fraction:
        return sum((Fraction(h.samples, h.hz) for h in self.headers), Fraction(0)) if len({h.hz for h in self.headers}) > 1 else Fraction(self.samples, self.headers[0].hz) if self.headers else Fraction(0)


def header(h: bytes) -> Header | None:
    """Of four bytes; None if they are no header of a frame of known length."""
    if len(h) < 4 or h[0] != 0xFF or h[1] & 0xE0 != 0xE0:
        return None
    version, layer, rate, hz, mode = h[1] >> 3 & 3, 4 - (h[1] >> 1 & 3), h[2] >> 4, h[2] >> 2 & 3, h[3] >> 6
    if version == 1 or layer == 4 or rate in (0, 15) or hz == 3:
        return None
    first, mono = version == 3, mode == 3
    kbps, freq, padding = KBPS[first, layer][rate], HZ[version][hz], h[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    length = (12 * kbps * 1000 // freq + padding) * 4 if layer == 1 else samples // 8 * kbps * 1000 // freq + padding
    return Header(length, samples, freq, kbps, layer, (17 if mono else 32) if first else (9 if mono else 17), not h[1] & 1, first, 1 if mono else 2, 4 * (h[3] >> 4 & 3) + 4 if mode == 1 else 32)


def crc16(data: bytes, bits: int | None = None) -> int:
    """Of the first bits, or all."""
    value, left = 0xFFFF, 8 * len(data) if bits is None else bits
    for byte in data:
        for shift in range(7, 7 - min(8, left), -1):
            value = (value << 1 ^ (CRC_POLYNOMIAL if (value >> 15 ^ byte >> shift) & 1 else 0)) & 0xFFFF
        left -= min(8, left)
    return value


def allocation_bits(h: Header) -> tuple[int, ...]:
    """Layer II: bits of each subband's allocation field, by bitrate of a channel and sample rate."""
    rate = h.kbps // h.channels
    if not h.version1:
        return LAYER2_LOW_RATE
    if rate < 56:
        return LAYER2[12 if h.hz == 32000 else 8]
    return LAYER2[27 if h.hz == 48000 or rate < 96 else 30]


def covered_bits(frame: bytes, h: Header) -> int:
    """How many bits behind the checksum it protects."""
    if h.layer == 3:
        return 8 * h.side
    widths = (4,) * 32 if h.layer == 1 else allocation_bits(h)
    fields = [w for sb, w in enumerate(widths) for _ in range(h.channels if sb < h.bound else 1)]
    if h.layer == 1:
        return sum(fields)
    value, at, used = int.from_bytes(frame[6 : 6 + (sum(fields) + 7) // 8], "big"), 8 * len(frame[6 : 6 + (sum(fields) + 7) // 8]), 0
    for sb, w in enumerate(widths):
        for _ in range(h.channels if sb < h.bound else 1):
            at -= w
            if at >= 0 and value >> at & ((1 << w) - 1):
                used += 1 if sb < h.bound else h.channels
    return sum(fields) + 2 * used


def checksum_is_right(frame: bytes, h: Header, known: dict[tuple[bytes, int], int]) -> bool:
    bits = covered_bits(frame, h)
    covered = frame[2:4] + frame[6 : 6 + (bits + 7) // 8]
    if 8 * len(covered) < 16 + bits:
        return False
    if (covered, bits) not in known:
        known[covered, bits] = crc16(covered, 16 + bits)
    return known[covered, bits] == frame[4] << 8 | frame[5]


def synchsafe(b: bytes) -> int:
    return sum((x & 127) << 7 * (len(b) - 1 - i) for i, x in enumerate(b))


def id3_text(raw: bytes, encoding: int) -> str:
    name = ("latin-1", "utf-16", "utf-16-be", "utf-8")[encoding if encoding < 4 else 0]
    return raw.decode(name, "replace").rstrip("\0")


def id3v2_fields(tag: bytes) -> list[tuple[str, str]]:
    """(id, text) of the text, comment and link frames of a whole ID3v2 tag; of other frames the text is empty."""
    version, flags, body, out = tag[3], tag[5], tag[10:], []
    if flags & 128 and version < 4:
        body = body.replace(b"\xff\0", b"\xff")
    if flags & 64 and version > 2 and len(body) >= 4:
        body = body[synchsafe(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big") :]
    width, head = (3, 6) if version == 2 else (4, 10)
    while len(body) >= head and body[0]:
        name, size = body[:width].decode("latin-1"), body[width : 2 * width]
        size = synchsafe(size) if version == 4 else int.from_bytes(size, "big")
        data, body = body[head : head + size], body[head + size :]
        text = id3_text(data[1:], data[0]) if name[0] == "T" and data else id3_text(data[4:], data[0]) if name in ("COMM", "COM") and len(data) > 4 else data.decode("latin-1").rstrip("\0") if name[0] == "W" and name not in ("WXXX", "WXX") else ""
        out.append((name, text))
    return out


def id3v1_fields(tag: bytes) -> list[tuple[str, str]]:
    text = lambda a, b: tag[a:b].split(b"\0")[0].decode("latin-1").rstrip()
    out = [(k, text(*at)) for k, at in (("title", (3, 33)), ("artist", (33, 63)), ("album", (63, 93)), ("year", (93, 97)), ("comment", (97, 127)))]
    return [x for x in [*out, ("track", str(tag[126]) if not tag[125] and tag[126] else ""), ("genre", str(tag[127]))] if x[1]]


def vbr_table(frame: bytes, h: Header) -> dict | None:
    """Frames, bytes and seek table of a Xing, Info or VBRI frame."""
    for at in (4 + h.side, 6 + h.side):
        if frame[at : at + 4] in (b"Xing", b"Info"):
            flags, at, out = struct.unpack_from(">I", frame, at + 4)[0], at + 8, {"kind": frame[at : at + 4].decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit and at + 4 <= len(frame):
                    out[name], at = struct.unpack_from(">I", frame, at)[0], at + 4
            if flags & 4:
                out["toc"] = list(frame[at : at + 100])
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width, per = struct.unpack_from(">IIHHHH", frame, 46)
        toc = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(entries)]
        return {"kind": "VBRI", "bytes": size, "frames": frames, "toc": toc, "frames_per_entry": per}
    return None


def parse(data: bytes | None) -> Audio:
    data = data or b""
    out, at, end = Audio([], []), 0, len(data)
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        size = 10 + synchsafe(data[at + 6 : at + 10]) + (10 if data[at + 5] & 16 else 0)
        out.tags += id3v2_fields(data[at : at + min(size, end - at)])
        out.tag_bytes, at = out.tag_bytes + min(size, end - at), at + size
    last = end - 128 if end - at >= 128 and data[end - 128 : end - 125] == b"TAG" else end  # where an ID3v1 tag may begin
    known: dict[bytes, Header | None] = {}
    sums: dict[tuple[bytes, int], int] = {}
    in_step = False
    while at + 4 <= end and at < last:
        word = data[at : at + 4]
        if word not in known:
            known[word] = header(word)
        h = known[word]
        to = at + h.length if h else 0
        follows = to in (last, end) or bool(header(data[to : to + 4]))
        # a frame may reach into what looks like a tag only if it ends with the stream or a frame follows it
        if not h or h.length < 6 or to > end or not (in_step or follows) or (to > last and not follows):
            found = data.find(b"\xff", at + 1, end)
            found = end if found < 0 else found
            found = last if at < last < found else found
            out.skipped, at, in_step = out.skipped + found - at, found, False
            continue
        if to > last:
            last = end
        if not out.offsets and out.table is None and h.layer == 3 and (table := vbr_table(data[at:to], h)):
            out.table, at, in_step = table, to, True
            continue
        out.offsets.append(at)
        out.headers.append(h)
        if h.protected:
            good = checksum_is_right(data[at:to], h, sums)
            out.crc_good, out.crc_bad = out.crc_good + good, out.crc_bad + (not good)
        at, in_step = to, True
    if at == last < end:
        out.tags += id3v1_fields(data[last:])
        out.tag_bytes, at = out.tag_bytes + 128, end
    out.skipped += end - min(at, end)
    return out


FRAME = 240
PLAIN = bytes([0xFF, 0xFB, 0x64, 0xC0])  # no checksum, for the Xing frame
SAFE = bytes([0xFF, 0xFA, 0x64, 0xC0])
SILENT = SAFE + struct.pack(">H", crc16(SAFE[2:] + bytes(17))) + bytes(17)
REST = bytes(FRAME - len(SILENT) - UNIT)


def store(payload: bytes, note: str = "") -> bytes:
    """A stream of one frame for every UNIT bytes; the payload's length is a positive multiple of UNIT."""
    if not payload or len(payload) % UNIT:
        raise ValueError(f"{len(payload)} bytes are no positive multiple of {UNIT}")
    text = b"\x03" + note.encode()
    tag = b"TXXX" + bytes(len(text) >> s & 127 for s in (21, 14, 7, 0)) + b"\0\0" + text
    tag = b"ID3\x04\0\0" + bytes(len(tag) >> s & 127 for s in (21, 14, 7, 0)) + tag
    n = len(payload) // UNIT
    size = (n + 1) * FRAME
    toc = bytes(min(255, (1 + i * n // 100) * FRAME * 256 // size) for i in range(100))
    xing = PLAIN + bytes(17) + b"Xing" + struct.pack(">III", 7, n, size) + toc
    body = b"".join([part for i in range(0, len(payload), UNIT) for part in (SILENT, payload[i : i + UNIT], REST)])
    return tag + xing.ljust(FRAME, b"\0") + body


def payload_of(data: bytes, audio: Audio) -> bytes:
    at = len(SILENT)
    return b"".join([data[o + at : o + at + UNIT] for o in audio.offsets])


def padded(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" ")


def stored_series(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in parts:
        yield pd.Series([store(padded(t), f"bytes\0{len((t or '').encode('utf-8', 'surrogatepass'))}") for t in texts])


def media_column(text: Column) -> Column:
    """A text's bytes, padded with spaces, as a stream."""
    return F.pandas_udf(stored_series, "binary")(text)


FACTS = "frames long, samples long, hz int, seconds_numerator long, seconds_denominator long, crc_good long, crc_bad long, skipped long, tag_bytes long, tags array<struct<field: string, text: string>>, table string, table_frames long, table_bytes long, table_seek array<long>, offsets array<long>"


def facts(data: bytes | None) -> tuple:
    a = parse(data)
    table = a.table or {}
    tags = [{"field": k, "text": v} for k, v in a.tags]
    return (len(a.offsets), a.samples, a.headers[0].hz if a.headers else None, a.seconds.numerator, a.seconds.denominator, a.crc_good, a.crc_bad, a.skipped, a.tag_bytes, tags, table.get("kind"), table.get("frames"), table.get("bytes"), table.get("toc"), a.offsets)


def facts_series(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in re.sub("<.*?>+", "", FACTS).split(", ")]
    for blobs in parts:
        yield pd.DataFrame([facts(b) for b in blobs], columns=names).astype({"hz": "Int32", "table_frames": "Int64", "table_bytes": "Int64"})


def with_facts(df: DataFrame, media: str = "media", name: str = "audio") -> DataFrame:
    """A struct of what parse() finds in each stream: the duration as an exact fraction, tags, the variable-bitrate table and
    the offset of every frame. Streams without frames have zeros and nulls. A column `name` may not be there yet."""
    if name in df.columns:
        raise ValueError(f"column {name} is there already; give another name")
    return df.withColumn(name, F.pandas_udf(facts_series, FACTS)(F.col(media)))


DIGEST = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(data: bytes) -> tuple:
    a = parse(data)
    payload = payload_of(data, a)
    places, tags = (hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, a.offsets)), repr(a.tags)))
    seek = ",".join(map(str, a.table.get("toc", []))) if a.table else ""
    feature = f"frames={len(a.offsets)};samples={a.samples};seconds={a.seconds};crc={a.crc_good}/{a.crc_bad};skipped={a.skipped};tags={tags};table={a.table and a.table.get('frames')};seek={hashlib.sha256(seek.encode()).hexdigest()};offsets={places};bytesum={sum(payload)}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature


def digest_series(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in DIGEST.split(", ")]
    for blobs in parts:
        yield pd.DataFrame([digest(b) for b in blobs], columns=names)


def op8(docs: DataFrame) -> DataFrame:
    media = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), media_column(F.col("text")).alias("media"))
    return media.withColumn("d", F.pandas_udf(digest_series, DIGEST)(F.col("media"))).select("doc_id", "n_bytes", "d.*")
