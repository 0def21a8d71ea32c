"""Operator 9: payloads in MPEG audio.

A payload is stored losslessly as the ancillary bytes of MPEG-1 Layer III frames whose granules are
empty (such a file plays as silence). A file is: an ID3v2 tag with the payload's length and CRC-32; a
frame with a Xing table (frames, bytes, 100 seek points); frames, each as short as its part of the
payload allows, so that the bit rate varies; an ID3v1 tag. Every frame has a CRC-16 of its header and
side information. Reading parses the tags and the table (Xing, Info or VBRI), finds frames by their headers,
resynchronises after damage, verifies the checksums, and gives exact durations and the frames' offsets.
Damage is counted and never an error; an empty file has no frames.
"""

from __future__ import annotations

import functools
import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcast.llm.shared import append_column, text_of

#: Fixed values of MPEG-1 Layer III, in kbit/s and Hz, by their codes in a header.
BIT_RATES = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
SAMPLE_RATES = (44100, 48000, 32000)
SAMPLES = 1152
MONO = 3
SIDE_BYTES = {MONO: 17, 0: 32, 1: 32, 2: 32}
#: The encoder's choices: 32 kHz, where lengths need no padding, one channel.
RATE_CODE = 2
OVERHEAD = 4 + 2 + SIDE_BYTES[MONO] + 2  # header, checksum, side information, length of the frame's part
BLOCK = 64
TAG_NAME = b"loomcast"


@functools.lru_cache(4096)
def crc16(data: bytes) -> int:
    """The checksum of MPEG audio frames: polynomial 0x8005, initial value 0xFFFF."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


@dataclass(frozen=True)
class Header:
    protected: bool
    rate: int
    size: int
    side: int


@functools.lru_cache(4096)
def parse_header(raw: bytes) -> Header | None:
    """The header of an MPEG-1 Layer III frame, or None if these four bytes are none."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xFE != 0xFA:
        return None
    bits, rate, padding = raw[2] >> 4, raw[2] >> 2 & 3, raw[2] >> 1 & 1
    if bits in (0, 15) or rate == 3:
        return None
    return Header(not raw[1] & 1, SAMPLE_RATES[rate], 144_000 * BIT_RATES[bits] // SAMPLE_RATES[rate] + padding, SIDE_BYTES[raw[3] >> 6])


def frame(bits: int, part: bytes, marked: bool = True) -> bytes:
    header = bytes((0xFF, 0xFA, bits << 4 | RATE_CODE << 2, MONO << 6))
    side = bytes(SIDE_BYTES[MONO])
    size = 144_000 * BIT_RATES[bits] // SAMPLE_RATES[RATE_CODE]
    body = b"".join((header, crc16(header[2:] + side).to_bytes(2, "big"), side, len(part).to_bytes(2, "big") if marked else b"", part))
    return body + bytes(size - len(body))


ROOM = [0, *(144_000 * b // SAMPLE_RATES[RATE_CODE] - OVERHEAD for b in BIT_RATES[1:])]


def synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def padded(raw: bytes) -> bytes:
    """``raw`` with zero bytes up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK))


def encode(payload: bytes) -> bytes:
    frames, at = [], 0
    while at < len(payload):
        left = len(payload) - at
        bits = next((k for k in range(1, 15) if ROOM[k] >= left), 14)
        frames.append(frame(bits, payload[at : at + ROOM[bits]]))
        at += ROOM[bits]
    total = sum(map(len, frames))
    first = 144_000 * BIT_RATES[5] // SAMPLE_RATES[RATE_CODE]  # the length of the Xing frame
    seek, place, k = [], 0, 0
    for percent in range(100):
        while k * 100 < percent * len(frames):
            place += len(frames[k])
            k += 1
        seek.append(min(255, (first + place) * 256 // (first + total)))
    # The Xing frame has no part of the payload: its ancillary bytes are the table.
    xing = frame(5, b"Xing" + struct.pack(">III", 7, len(frames), first + total) + bytes(seek), marked=False)
    value = f"payload={len(payload)};crc32={zlib.crc32(payload):08x}".encode("latin-1")
    body = b"\0" + TAG_NAME + b"\0" + value  # text in Latin-1: a description and a value
    tag = b"TXXX" + struct.pack(">I", len(body)) + bytes(2) + body
    return b"".join((b"ID3\x03\0\0", synchsafe(len(tag)), tag, xing, *frames, b"TAG".ljust(127, b"\0") + b"\xff"))


@dataclass
class Audio:
    """What reading a file gives. ``damaged`` counts frames with wrong checksums and places where the reader had to look for the next frame."""

    payload: bytes = b""
    frames: int = 0
    samples: int = 0
    rate: int = 0
    damaged: int = 0
    table: tuple[int | None, int | None] | None = None
    offsets: list[int] = field(default_factory=list)
    tag_length: int | None = None
    tag_crc32: int | None = None

    @property
    def whole(self) -> bool:
        """Whether frames, table and tag agree and nothing is damaged."""
        return not self.damaged and self.table is not None and self.table[0] == self.frames and self.tag_length == len(self.payload) and self.tag_crc32 == zlib.crc32(self.payload)

    @property
    def feature(self) -> str:
        return f"frames={self.frames};samples={self.samples};rate={self.rate};us={self.samples * 1_000_000 // self.rate if self.rate else 0};vbr={self.table is not None:d};last={self.offsets[-1] if self.offsets else -1};ok={self.whole:d}"


def unsynchsafe(raw: bytes) -> int:
    return functools.reduce(lambda n, b: n << 7 | b & 127, raw, 0)


def tag_frames(media: bytes) -> tuple[int, list[tuple[bytes, bytes]], bool]:
    """Of an ID3v2 tag (versions 2.3 and 2.4) at the front: its length in bytes (0: there is none), its
    frames (id, body) and whether it is whole. Damage ends the list of frames; it is never an error."""
    if media[:3] != b"ID3" or len(media) < 10:
        return 0, [], True
    version, flags, size = media[3], media[5], unsynchsafe(media[6:10])
    length = 10 + size + (10 if version == 4 and flags & 0x10 else 0)
    body = media[10 : 10 + size]
    if flags & 0x80:  # unsynchronised: a zero byte was put after each 0xFF
        body = body.replace(b"\xff\0", b"\xff")
    at, found = 0, []
    if flags & 0x40 and len(body) >= 4:  # an extended header
        at = unsynchsafe(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big")
    while at + 10 <= len(body) and body[at]:  # zero bytes are padding
        kind, raw = body[at : at + 4], body[at + 4 : at + 8]
        n = unsynchsafe(raw) if version == 4 else int.from_bytes(raw, "big")
        if not kind.isalnum() or at + 10 + n > len(body):
            return length, found, False
        found.append((kind, body[at + 10 : at + 10 + n]))
        at += 10 + n
    return length, found, length <= len(media) and version in (3, 4)


def own_tag(frames: list[tuple[bytes, bytes]]) -> tuple[int | None, int | None]:
    """The payload's length and CRC-32 in the tag frames that ``encode`` writes; None where they are missing or no numbers."""
    found: dict[bytes, int] = {}
    for kind, body in frames:
        if kind == b"TXXX" and body[:1] == b"\0" and body[1:].partition(b"\0")[0] == TAG_NAME:
            for item in body[1:].partition(b"\0")[2].split(b";"):
                key, _, value = item.partition(b"=")
                if key == b"payload" and value.isdigit() and len(value) < 20:
                    found[key] = int(value)
                elif key == b"crc32" and len(value) == 8 and not value.strip(b"0123456789abcdef"):
                    found[key] = int(value, 16)
    return found.get(b"payload"), found.get(b"crc32")


def rate_table(part: bytes, side: int) -> tuple[int | None, int | None] | None:
    """(frames, bytes) of a variable-bitrate table in the first frame, whose bytes from its side information
    on are ``part``: Xing or Info with the fields that its flags name, or VBRI. None if there is no whole one."""
    after = part[side:]
    if after[:4] in (b"Xing", b"Info") and len(after) >= 8:
        flags, at, found = int.from_bytes(after[4:8], "big"), 8, []
        for bit in (1, 2):
            if flags & bit and len(after) < at + 4:
                return None
            found.append(int.from_bytes(after[at : at + 4], "big") if flags & bit else None)
            at += 4 if flags & bit else 0
        return found[0], found[1]
    if part[32:36] == b"VBRI" and len(part) >= 50:  # always 32 bytes after the header
        n_bytes, n_frames = struct.unpack_from(">II", part, 42)
        return n_frames, n_bytes
    return None


def decode(media: bytes) -> Audio:
    out, end, parts = Audio(), len(media), []
    at, tags, tag_whole = tag_frames(media)
    out.tag_length, out.tag_crc32 = own_tag(tags)
    out.damaged += not tag_whole
    if media[-128:-125] == b"TAG":
        end -= 128
    begin = None
    lost = False
    while at < end:
        head = parse_header(media[at : at + 4])
        if head is None or at + head.size > end or (lost and at + head.size < end and parse_header(media[at + head.size : at + head.size + 4]) is None):
            out.damaged += not lost  # resynchronise: two headers a frame's length apart
            lost = True
            at = media.find(b"\xff", at + 1, end)
            if at < 0:
                break
            continue
        lost = False
        body = at + 4
        if head.protected:
            if crc16(media[at + 2 : at + 4] + media[body + 2 : body + 2 + head.side]) != int.from_bytes(media[body : body + 2], "big"):
                out.damaged += 1
            body += 2
        begin = at if begin is None else begin
        table = rate_table(media[body : at + head.size], head.side) if out.table is None and not out.frames else None
        body += head.side
        if table is not None:
            out.table = table
        else:
            n = int.from_bytes(media[body : body + 2], "big")
            out.damaged += body + 2 + n > at + head.size
            parts.append(media[body + 2 : min(body + 2 + n, at + head.size)])
            out.offsets.append(at)
            out.frames += 1
            out.samples += SAMPLES
            out.rate = head.rate
        at += head.size
    if out.table is not None and out.table[1] is not None and begin is not None:
        out.damaged += out.table[1] != at - begin  # the table counts its own frame too
    out.payload = b"".join(parts)
    return out


def write_media(df: DataFrame, text_column: str = "text", out: str = "media") -> DataFrame:
    """``df`` with ``out``: its whole texts in UTF-8, zero-padded to a positive multiple of 64 bytes, as
    MPEG audio. Null and empty texts are 64 zero bytes; equal texts have equal files; other columns stay."""
    return append_column(df, text_of(text_column).cast("binary"), lambda raw: pa.array([encode(padded(bytes(r))) for r in raw], pa.binary()), out, "binary")


READ = "struct<payload: binary, frames: long, samples: long, rate: long, seek_offsets: array<long>, damaged: long, whole: boolean, feature: string>"


def read_media(df: DataFrame, media_column: str = "media", out: str = "audio") -> DataFrame:
    """``df`` with ``out``: what the stored bytes hold (payload, frames, samples and rate, which give the
    exact duration, the frames' offsets, damage). Null media read as an empty file."""
    kind = pa.struct([("payload", pa.binary()), ("frames", pa.int64()), ("samples", pa.int64()), ("rate", pa.int64()), ("seek_offsets", pa.list_(pa.int64())), ("damaged", pa.int64()), ("whole", pa.bool_()), ("feature", pa.string())])

    def run(media: list[bytes | None]) -> pa.Array:
        rows = []
        for m in media:
            a = decode(m or b"")
            rows.append({"payload": a.payload, "frames": a.frames, "samples": a.samples, "rate": a.rate, "seek_offsets": a.offsets, "damaged": a.damaged, "whole": a.whole, "feature": a.feature})
        return pa.array(rows, kind)

    return append_column(df, F.col(media_column), run, out, READ)
