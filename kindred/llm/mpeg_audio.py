"""Media columns, MPEG audio: resynchronising frame parser, tags, variable-bitrate tables, checksums, seek offsets.

``with_media`` stores each text's payload losslessly in an MPEG-1 Layer III stream (48 kHz, mono, CRC-protected,
variable bitrate): every audio frame is silent (its side information is zero) and carries payload bytes where the
format allows ancillary data, after a two-byte count. The stream opens with an ID3v2.4 tag and a Xing frame with
its 100-entry table, and ends with an ID3v1 tag. ``with_media_info`` parses any MPEG-1/2/2.5 audio bytes.

Defined results: a null text is empty; an empty text makes a payload of 192 spaces; a null medium gives an empty
result (zero frames, empty payload); checksums of all three layers are verified where frames carry them; bytes that are no frame are skipped and counted; a repeated row gives a
repeated result; other columns of the input are not read, so their names cannot clash. Ids may be of any type and columns
have any name. Duration is exact: samples and rate as integers, without the delay and padding that an encoder names
beside its Xing or Info table. ID3 tags are read by their own version (2.2, 2.3, 2.4).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import only, slices, utf8

BLOCK = 192

# Fixed values of the format: kbit/s by (version 1 or 2, layer) for indices 1 to 14; Hz of MPEG-1 (halved, and
# quartered for MPEG-2.5); bytes of Layer III side information by (version is 1, mono).
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)
# Bits of a Layer II allocation by subband, for tables a, b, c, d of MPEG-1 and the one of MPEG-2.
ALLOCATION = {
    "a": (4,) * 11 + (3,) * 12 + (2,) * 4,
    "b": (4,) * 11 + (3,) * 12 + (2,) * 7,
    "c": (4,) * 2 + (3,) * 6,
    "d": (4,) * 2 + (3,) * 10,
    "lsf": (4,) * 4 + (3,) * 7 + (2,) * 19,
}
SIDE = {(True, True): 17, (True, False): 32, (False, True): 9, (False, False): 17}
CRC_POLYNOMIAL = 0x8005


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = (value << 1 ^ CRC_POLYNOMIAL if value & 0x8000 else value << 1) & 0xFFFF
        table.append(value)
    return table


_CRC = _crc_table()
_crc_of: dict[bytes, int] = {}


def crc16(data: bytes) -> int:
    """Checksum of MPEG audio (start 0xFFFF); silent frames repeat, so results are remembered."""
    found = _crc_of.get(data)
    if found is None:
        found = 0xFFFF
        for b in data:
            found = (found << 8 ^ _CRC[found >> 8 ^ b]) & 0xFFFF
        if len(_crc_of) < 4096:
            _crc_of[data] = found
    return found


@dataclass(frozen=True)
class Header:
    version: str
    layer: int
    protected: bool
    kbps: int
    rate: int
    size: int
    samples: int
    side: int
    mono: bool


_headers: dict[bytes, Header | None] = {}


def read_header(four: bytes) -> Header | None:
    """The frame header in ``four`` bytes, or None (free-format frames count as no header)."""
    if four in _headers:
        return _headers[four]
    out = None
    if len(four) == 4 and four[0] == 0xFF and four[1] & 0xE0 == 0xE0:
        version = {0: "2.5", 2: "2", 3: "1"}.get(four[1] >> 3 & 3)
        layer = 4 - (four[1] >> 1 & 3)
        index, at = four[2] >> 4, four[2] >> 2 & 3
        if version and layer < 4 and 0 < index < 15 and at < 3 and four[3] & 3 != 2:
            one = version == "1"
            kbps = BITRATES[1 if one else 2, layer][index - 1]
            rate = RATES[at] >> {"1": 0, "2": 1, "2.5": 2}[version]
            pad = four[2] >> 1 & 1
            mono = four[3] >> 6 == 3
            samples = 384 if layer == 1 else 576 if layer == 3 and not one else 1152
            size = (12000 * kbps // rate + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // rate + pad
            out = Header(version, layer, not four[1] & 1, kbps, rate, size, samples, SIDE[one, mono] if layer == 3 else 0, mono)
    if len(_headers) < 65536:
        _headers[four] = out
    return out


def crc16_bits(bits: str) -> int:
    """The same over any number of bits ("0" and "1")."""
    value = 0xFFFF
    for b in bits:
        value = (value << 1 ^ (CRC_POLYNOMIAL if (value >> 15) ^ (b == "1") else 0)) & 0xFFFF
    return value


def covered_bits(head: Header, frame: bytes) -> str | None:
    """The bits of a protected Layer I or II frame that its checksum covers: the header's last 16, the allocation and,
    in Layer II, the scale factor selection of each allocated subband; None: the frame is too short."""
    mono, joint = frame[3] >> 6 == 3, frame[3] >> 6 == 1
    channels = 1 if mono else 2
    if head.layer == 1:
        table = (4,) * 32
    elif head.version != "1":
        table = ALLOCATION["lsf"]
    else:
        each = head.kbps // channels
        low = each < 56
        table = ALLOCATION[("d" if head.rate == 32000 else "c") if low else "a" if head.rate == 48000 or each <= 80 else "b"]
    bound = 4 * ((frame[3] >> 4 & 3) + 1) if joint else 32
    bits = "".join(f"{b:08b}" for b in frame[6 : 6 + 256])
    at, selected = 0, 0
    for band, width in enumerate(table):
        for _ in range(channels if band < bound else 1):
            if "1" in bits[at : at + width]:
                selected += 1 if band < bound else channels
            at += width
    at += 2 * selected if head.layer == 2 else 0
    return f"{frame[2]:08b}{frame[3]:08b}{bits[:at]}" if at <= len(bits) else None


@dataclass
class AudioInfo:
    """What the parser found; offsets are positions of audio frames in the bytes."""

    version: str = ""
    layer: int = 0
    rate: int = 0
    frames: int = 0
    samples: int = 0
    crc_ok: int = 0
    crc_bad: int = 0
    crc_unchecked: int = 0
    skipped: int = 0
    kbps_sum: int = 0
    vbr: str = ""
    vbr_frames: int = 0
    vbr_bytes: int = 0
    toc: bytes = b""
    delay: int = 0
    padding: int = 0
    stretches: list[int] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    payload: bytes = b""

    def heard(self) -> int:
        """Samples without those that the encoder put before and after the sound."""
        return max(0, self.samples - self.delay - self.padding)

    def feature(self) -> str:
        seek = zlib.crc32(",".join(map(str, self.offsets)).encode())
        return (
            f"mpeg{self.version}-layer{self.layer};rate={self.rate};frames={self.frames};samples={self.samples}"
            f";crc={self.crc_ok}/{self.crc_bad}/{self.crc_unchecked};vbr={self.vbr}:{self.vbr_frames}:{self.vbr_bytes}"
            f";kbps={self.kbps_sum // self.frames if self.frames else 0};skipped={self.skipped};tags={len(self.tags)};seek={seek:08x}"
        )


def _syncsafe(value: int) -> bytes:
    return bytes(value >> s & 0x7F for s in (21, 14, 7, 0))


def _unsyncsafe(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


def _id3v2(tags: dict[str, str]) -> bytes:
    body = b"".join(b"TXXX" + _syncsafe(len(t := b"\x03" + k.encode() + b"\0" + v.encode())) + b"\0\0" + t for k, v in tags.items())
    return b"ID3\x04\0\0" + _syncsafe(len(body)) + body


def _frame_start(kbps: int, protected: bool = True) -> bytes:
    """Header of a 48 kHz mono Layer III frame, with the checksum of silent side information if protected."""
    index = BITRATES[1, 3].index(kbps) + 1
    head = bytes((0xFF, 0xFA if protected else 0xFB, index << 4 | 1 << 2, 0xC0))
    side = bytes(17)
    return head + (crc16(head[2:] + side).to_bytes(2, "big") if protected else b"") + side


_START = {k: _frame_start(k) for k in BITRATES[1, 3]}
#: Payload bytes that a frame of each bitrate can carry: 3 bytes per kbit/s, less header, checksum, side and count.
_ROOM = {k: 3 * k - 25 for k in BITRATES[1, 3]}
_FULL = _START[320] + _ROOM[320].to_bytes(2, "big")


def encode(payload: bytes) -> bytes:
    """MPEG audio stream that carries ``payload``."""
    room = _ROOM[320]
    whole = len(payload) // room * room
    frames = [_FULL + payload[i : i + room] for i in range(0, whole, room)]
    if rest := payload[whole:]:
        kbps = next(k for k in BITRATES[1, 3] if _ROOM[k] >= len(rest))
        frames.append((_START[kbps] + len(rest).to_bytes(2, "big") + rest).ljust(3 * kbps, b"\0"))
    sound = b"".join(frames)
    total = 288 + len(sound)
    toc = bytes(min(255, (288 + (p * len(frames) // 100) * 960) * 256 // total) for p in range(100))
    table = b"Xing\0\0\0\x07" + len(frames).to_bytes(4, "big") + total.to_bytes(4, "big") + toc
    xing = (_frame_start(96, False) + table).ljust(288, b"\0")
    last = b"TAG" + b"kindred payload".ljust(30, b"\0") + bytes(95)
    return _id3v2({"payload": str(len(payload))}) + xing + sound + last


def _text_of(body: bytes) -> list[str]:
    """Strings of a text frame: a byte for the encoding, then strings that a null ends."""
    name = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0] if body else 0, "latin-1")
    return [x.lstrip("\ufeff") for x in body[1:].decode(name, "replace").rstrip("\0").split("\0")]


def _read_id3(version: int, flags: int, body: bytes, tags: dict[str, str]) -> None:
    """Add the text frames of an ID3 tag to ``tags``. In version 2 names have 3 bytes and sizes 3; in 3 sizes are plain, in 4 of
    7 bits a byte. Unsynchronised bytes are put back, an extended header is passed over; other versions are skipped."""
    if version not in (2, 3, 4):
        return
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\0", b"\xff")
    wide, at = (3, 0) if version == 2 else (4, 0)
    if flags & 0x40 and version > 2:
        at = 4 + int.from_bytes(body[:4], "big") if version == 3 else _unsyncsafe(body[:4].ljust(4, b"\0"))
    head = 6 if version == 2 else 10
    while at + head <= len(body) and body[at : at + wide].strip(b"\0"):
        sized = body[at + wide : at + 2 * wide]
        n = _unsyncsafe(sized) if version == 4 else int.from_bytes(sized, "big")
        name, text = body[at : at + wide].decode("latin-1"), body[at + head : at + head + n]
        if version == 4 and body[at + 9] & 2:
            text = text.replace(b"\xff\0", b"\xff")
        if version == 4 and body[at + 9] & 1:
            text = text[4:]
        if name in ("TXXX", "TXX"):
            key, *rest = _text_of(text)
            tags[key] = "\0".join(rest)
        elif name[0] == "T":
            tags[name] = "\0".join(_text_of(text))
        at += head + n


def _lame_trim(data: bytes) -> tuple[int, int]:
    """(delay, padding) in samples of the encoder's part of a Xing or Info table: two numbers of 12 bits after the encoder's
    name and 12 bytes more; (0, 0) where no encoder is named."""
    if len(data) < 24 or data[:4] not in (b"LAME", b"Lavf", b"Lavc", b"L3.9"):
        return 0, 0
    both = int.from_bytes(data[21:24], "big")
    return both >> 12, both & 0xFFF


def _vbri_offsets(data: bytes, at: int) -> list[int]:
    """Sizes of the stretches of a VBRI table that starts at ``at``: entries, scale, entry width, frames of an entry, entries."""
    n, scale, width = (int.from_bytes(data[at + k : at + k + 2], "big") for k in (18, 20, 22))
    first = at + 26
    if not 1 <= width <= 4 or first + n * width > len(data):
        return []
    return [scale * int.from_bytes(data[first + k * width : first + (k + 1) * width], "big") for k in range(n)]


def parse(data: bytes) -> AudioInfo:
    """Tags, frames, tables, checksums and payload of an MPEG audio stream; resynchronises after foreign bytes."""
    info = AudioInfo()
    at, end = 0, len(data)
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        stop = min(end, at + 10 + _unsyncsafe(data[at + 6 : at + 10]))
        _read_id3(data[at + 3], data[at + 5], data[at + 10 : stop], info.tags)
        at = stop
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        info.tags["ID3v1"] = data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1")
    parts: list[bytes] = []
    first, synced = True, False
    while at + 4 <= end:
        head = read_header(data[at : at + 4])
        good = head is not None and at + head.size <= end
        if good and not synced:  # after foreign bytes a header counts if the next one agrees with it
            after = at + head.size
            follow = read_header(data[after : after + 4])
            good = after == end or follow is not None and (follow.version, follow.layer, follow.rate) == (head.version, head.layer, head.rate)
        if not good:
            nxt = data.find(b"\xff", at + 1, end)
            nxt = nxt if nxt >= 0 else end
            info.skipped += nxt - at
            at, synced = nxt, False
            continue
        synced = True
        side_at = at + (6 if head.protected else 4)
        body_at = side_at + head.side
        if first:
            first = False
            info.version, info.layer, info.rate = head.version, head.layer, head.rate
            mark = data[body_at : body_at + 4]
            if mark in (b"Xing", b"Info"):
                flags, p = int.from_bytes(data[body_at + 4 : body_at + 8], "big"), body_at + 8
                info.vbr = mark.decode().lower()
                if flags & 1:
                    info.vbr_frames, p = int.from_bytes(data[p : p + 4], "big"), p + 4
                if flags & 2:
                    info.vbr_bytes, p = int.from_bytes(data[p : p + 4], "big"), p + 4
                if flags & 4:
                    info.toc, p = data[p : p + 100], p + 100
                info.delay, info.padding = _lame_trim(data[p + 4 * (flags >> 3 & 1) : at + head.size])
            elif data[side_at + 32 : side_at + 36] == b"VBRI":
                info.vbr = "vbri"
                info.vbr_bytes, info.vbr_frames = (int.from_bytes(data[side_at + k : side_at + k + 4], "big") for k in (42, 46))
                info.stretches = _vbri_offsets(data[: at + head.size], side_at + 32)
            if info.vbr:
                at += head.size
                continue
        side = data[side_at:body_at]
        if not head.protected:
            info.crc_unchecked += 1
        else:
            if head.layer == 3:
                found: int | None = crc16(data[at + 2 : at + 4] + side)
            else:
                bits = covered_bits(head, data[at : at + head.size])
                found = None if bits is None else crc16_bits(bits)
            good = found == int.from_bytes(data[at + 4 : at + 6], "big")
            info.crc_ok += good
            info.crc_bad += not good
        if head.layer == 3 and not side.strip(b"\0"):
            n = int.from_bytes(data[body_at : body_at + 2], "big")
            parts.append(data[body_at + 2 : min(body_at + 2 + n, at + head.size)])
        info.offsets.append(at)
        info.frames += 1
        info.samples += head.samples
        info.kbps_sum += head.kbps
        at += head.size
    info.skipped += max(0, end - at)
    info.payload = b"".join(parts)
    return info


def with_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes long, media binary): each text's payload as an MPEG audio stream."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "1"):
            texts = utf8(b.column(1))
            media = [encode(t + b" " * (-len(t) % BLOCK if t else BLOCK)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    df = only(df, id_col, text_col)
    return df.toDF("0", "1").mapInArrow(store, StructType([df.schema[0], StructField("n_bytes", LongType()), StructField("media", BinaryType())]))


def with_media_info(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried columns, digests of the payload read back and of the medium, exact duration, seek offsets)."""
    df = only(df, id_col, media_col, *carry)
    kept = [f for k, f in enumerate(df.schema.fields) if k != 1]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "1"):
            media = [x or b"" for x in b.column(1).to_pylist()]
            infos = [parse(m) for m in media]
            cols = [
                b.column(0),
                *(b.column(2 + k) for k in range(len(carry))),
                pa.array((len(i.payload) for i in infos), pa.int64()),
                pa.array((hashlib.sha256(i.payload).hexdigest() for i in infos), pa.string()),
                pa.array((zlib.crc32(i.payload[-16:]) for i in infos), pa.int64()),
                pa.array(map(len, media), pa.int64()),
                pa.array((hashlib.sha256(m).hexdigest() for m in media), pa.string()),
                pa.array((i.feature() for i in infos), pa.string()),
                pa.array((i.heard() for i in infos), pa.int64()),
                pa.array((i.rate for i in infos), pa.int32()),
                pa.array((i.frames for i in infos), pa.int64()),
                pa.array((i.offsets for i in infos), pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, *carry, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration_samples", "sample_rate", "n_frames", "seek_offsets"])

    added = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_samples long, sample_rate int, n_frames long, seek_offsets array<bigint>"
    return df.toDF(*map(str, range(len(df.columns)))).mapInArrow(read, StructType([*kept, *StructType.fromDDL(added).fields]))
