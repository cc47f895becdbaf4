"""Layers, versions, tables and checksums that the stored form itself does not use."""

import random

import pytest

pytest.importorskip("kindred.llm")
from kindred.llm import mpeg_audio as M  # noqa: E402


def long_division(bits):
    """Checksum bit by bit: the remainder of the bits, the start value added to the first sixteen."""
    reg = [1] * 16
    for b in bits:
        out = reg.pop(0) ^ int(b)
        reg.append(0)
        if out:
            for k in (0, 13, 15):  # x^15, x^2, 1
                reg[k] ^= 1
    return int("".join(map(str, reg)), 2)


def frame(version, layer, index, mode, crc_of, fill=b""):
    """A protected 48 kHz (24 kHz) frame; ``crc_of`` takes the frame and gives the checksum."""
    head = bytes((0xFF, 0xF0 | (8 if version == 1 else 0) | (4 - layer) << 1, index << 4 | 1 << 2, mode << 6))
    info = M.read_header(head)
    body = bytearray((head + b"\0\0" + fill).ljust(info.size, b"\0")[: info.size])
    body[4:6] = crc_of(bytes(body)).to_bytes(2, "big")
    return bytes(body)


def bits(data):
    return "".join(f"{b:08b}" for b in data)


def test_layer_one_and_two_checksums():
    rng = random.Random(1)
    for mode, n in ((3, 16), (0, 32)):  # mono, stereo: 32 allocations of 4 bits for each channel
        fill = rng.randbytes(60)
        made = [frame(1, 1, 10, mode, lambda f, n=n: long_division(bits(f[2:4] + f[6 : 6 + n])), fill) for _ in range(3)]
        info = M.parse(b"".join(made))
        assert (info.layer, info.frames, info.samples, info.crc_ok, info.crc_bad) == (1, 3, 1152, 3, 0)
        broken = bytearray(made[1])
        broken[8] ^= 4
        assert M.parse(made[0] + bytes(broken) + made[2]).crc_bad == 1
    # Layer II, 192 kbit/s mono at 48 kHz: 27 subbands (88 bits); the first three are allocated: six bits of selection
    alloc = "0001" * 3 + "0" * 76
    fill = int((alloc + "011011").ljust(96, "1"), 2).to_bytes(12, "big")
    made = frame(1, 2, 10, 3, lambda f: long_division(bits(f[2:4]) + alloc + "011011"), fill)
    info = M.parse(made * 2)
    assert (info.layer, info.frames, info.samples, info.crc_ok) == (2, 2, 2304, 2)
    # MPEG-2 Layer II, 30 subbands (75 bits), nothing allocated
    made = frame(2, 2, 8, 3, lambda f: long_division(bits(f[2:4]) + "0" * 75))
    info = M.parse(made * 2)
    assert (info.version, info.rate, info.crc_ok) == ("2", 24000, 2)


def test_versions_vbri_and_unprotected_frames():
    for second, version, rate in ((0xFB, "1", 48000), (0xF3, "2", 24000), (0xE3, "2.5", 12000)):
        head = bytes((0xFF, second, 8 << 4 | 1 << 2, 0xC0))
        size = M.read_header(head).size
        plain = head.ljust(size, b"\0")
        table = head + bytes(32) + b"VBRI" + bytes(6) + (900).to_bytes(4, "big") + (3).to_bytes(4, "big")
        info = M.parse(table.ljust(size, b"\0") + plain * 3)
        assert (info.version, info.rate, info.vbr, info.vbr_bytes, info.vbr_frames) == (version, rate, "vbri", 900, 3)
        assert (info.frames, info.crc_unchecked, info.crc_bad) == (3, 3, 0)
        assert info.offsets == [size, 2 * size, 3 * size] and info.samples == 3 * (1152 if version == "1" else 576)


def test_seek_table_points_at_frames():
    data = M.encode(random.Random(2).randbytes(50_000))
    info = M.parse(data)
    first = info.offsets[0] - 288
    assert len(info.toc) == 100 and sorted(info.toc) == list(info.toc)
    for p in range(100):
        target = first + info.toc[p] * info.vbr_bytes // 256
        wanted = info.offsets[p * len(info.offsets) // 100]
        assert abs(target - wanted) <= 960 + info.vbr_bytes // 256


def tag(version, frames, flags=0):
    body = b"".join(frames)
    return b"ID3" + bytes((version, 0, flags)) + M._syncsafe(len(body)) + body


def test_id3_of_each_version():
    """Sizes: 3 bytes in version 2, plain in 3, seven bits a byte in 4; a title of 300 bytes, and one more frame after it."""
    sound = M.encode(b"x" * 500)
    sound = sound[10 + M._unsyncsafe(sound[6:10]) :]
    title = "t" * 300
    two = [b"TT2" + (301).to_bytes(3, "big") + b"\0" + title.encode(), b"TAL" + (3).to_bytes(3, "big") + b"\0ab"]
    three = [b"TIT2" + (301).to_bytes(4, "big") + b"\0\0\0" + title.encode(), b"TALB" + (7).to_bytes(4, "big") + b"\0\0\1" + "ab".encode("utf-16")]
    four = [b"TIT2" + M._syncsafe(301) + b"\0\0\3" + title.encode(), b"TALB" + M._syncsafe(5) + b"\0\0\2" + "ab".encode("utf-16-be")]
    for version, frames, names in ((2, two, ("TT2", "TAL")), (3, three, ("TIT2", "TALB")), (4, four, ("TIT2", "TALB"))):
        info = M.parse(tag(version, frames) + sound)
        assert [info.tags[n] for n in names] == [title, "ab"] and info.payload == b"x" * 500 and info.skipped == 0
    # an extended header of 10 bytes in version 3; bytes after FF put back; an unknown version is passed over
    more = bytes((0, 0, 0, 6)) + bytes(6)
    assert M.parse(tag(3, [more, *three], 0x40) + sound).tags["TALB"] == "ab"
    odd = b"TIT2" + (3).to_bytes(4, "big") + b"\0\0\0\xff\0\xe0"
    assert M.parse(tag(3, [odd], 0x80) + sound).tags["TIT2"] == "\xff\xe0"
    assert "TIT2" not in M.parse(tag(9, three) + sound).tags and M.parse(tag(9, three) + sound).payload == b"x" * 500
    assert M.parse(tag(3, [b"TIT2" + (10**6).to_bytes(4, "big") + b"\0\0\0short"]) + sound).tags["TIT2"] == "short"


def test_delay_padding_and_vbri_stretches():
    head = bytes((0xFF, 0xFB, 8 << 4 | 1 << 2, 0xC0))
    size = M.read_header(head).size
    plain = head.ljust(size, b"\0")
    lame = b"LAME3.100" + bytes(12) + (576 << 12 | 1000).to_bytes(3, "big")
    for flags in (0, 1, 15):
        fields = bytes(4 * (flags & 1) + 4 * (flags >> 1 & 1) + 100 * (flags >> 2 & 1) + 4 * (flags >> 3))
        info = M.parse((head + bytes(17) + b"Info" + flags.to_bytes(4, "big") + fields + lame).ljust(size, b"\0") + plain * 3)
        assert (info.vbr, info.delay, info.padding, info.samples, info.heard()) == ("info", 576, 1000, 3456, 1880)
    table = b"VBRI" + bytes(6) + (900).to_bytes(4, "big") + (3).to_bytes(4, "big") + b"\0\3\0\2\0\2\0\1" + b"\0\5\0\6\1\0"
    info = M.parse((head + bytes(32) + table).ljust(size, b"\0") + plain * 3)
    assert (info.vbr_frames, info.stretches, info.heard()) == (3, [10, 12, 512], 3456)


def test_ids_of_any_type_and_names_with_backticks(spark):
    rows = spark.createDataFrame([("a", "some text"), (None, None)], "`i``d` string, `te.xt` string")
    made = M.with_media(rows, "i`d", "te.xt")
    found = {r[0]: r for r in M.with_media_info(made, "i`d", "media", ("n_bytes",)).collect()}
    assert {k: (r.n_bytes, r.payload_bytes) for k, r in found.items()} == {"a": (9, 192), None: (0, 192)}
