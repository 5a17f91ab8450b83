"""Icon containers against a plain reader of their records."""

import random
import struct

import pytest

from tidemark.operators import icons, inventory

PNG_HEAD, PNG_TAIL = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR", b"\x00\x00\x00\x00IEND\xaeB`\x82"


def png(w, h):
    return PNG_HEAD + struct.pack(">II", w, h) + b"\x08\x06\x00\x00\x00" + b"body" * 3 + PNG_TAIL


def bitmap(w, h, bits=32, colors=0, header=40):
    palette = b"\0" * 4 * ((colors or 1 << bits) if bits <= 8 else 0)
    pixels = b"\1" * ((w * bits + 31) // 32 * 4 * h)
    mask = b"\2" * ((w + 31) // 32 * 4 * h)
    return struct.pack("<IiiHHIIiiII", header, w, 2 * h, 1, bits, 0, 0, 0, 0, colors, 0) + b"\0" * (header - 40) + palette + pixels + mask


def icon(*images, gap=0, spare=0, kind=1, tail=b""):
    at, records = 6 + 16 * len(images) + gap, b""
    for w, h, body in images:
        records += struct.pack("<BBBBHHII", w % 256, h % 256, 0, spare, 1, 32, len(body), at)
        at += len(body)
    return struct.pack("<HHH", 0, kind, len(images)) + records + b"\0" * gap + b"".join(b for *_, b in images) + tail


GOOD = [
    icon((16, 16, bitmap(16, 16))), icon((256, 256, png(256, 256))), icon((16, 16, bitmap(16, 16, 8)), (33, 7, bitmap(33, 7, 1)), (48, 48, png(48, 48))), icon((3, 5, bitmap(3, 5, 4, 9, 108))), icon((9, 9, bitmap(9, 9, 24, 0, 124))),
]
BAD = [
    None, b"", b"\0\0\1\0", icon(), icon((16, 16, bitmap(16, 16)), gap=1), icon((16, 16, bitmap(16, 16)), spare=1), icon((16, 16, bitmap(16, 16)), kind=2), icon((16, 16, bitmap(16, 16)), tail=b"x"), icon((16, 16, bitmap(16, 16))[:2] + (b"",)),
    icon((16, 17, bitmap(16, 16))), icon((15, 16, png(16, 16))), icon((16, 16, bitmap(16, 16, 5))), icon((16, 16, bitmap(16, 16, 4, 17))), icon((16, 16, bitmap(16, 16)[:-1])), icon((16, 16, bitmap(16, 16, header=41))), icon((16, 16, png(16, 16)[:-1] + b"x")),
    GOOD[2][:-1], GOOD[0][:30], struct.pack("<HHH", 0, 1, 300) + b"\0" * 6000, icon((16, 16, b"\x89PNG\r\n\x1a\n")),
]


def plain(c):
    """The same by reading records one after the other."""
    if c is None or len(c) < 6 or c[:4] != b"\0\0\1\0":
        return False
    n = struct.unpack_from("<H", c, 4)[0]
    if not 1 <= n <= 256 or 6 + 16 * n > len(c):
        return False
    ranges = []
    for k in range(n):
        w, h, _, spare, _, _, size, start = struct.unpack_from("<BBBBHHII", c, 6 + 16 * k)
        body, w, h = c[start : start + size], w or 256, h or 256
        if spare or not size or len(body) != size:
            return False
        if body[:8] == PNG_HEAD[:8]:
            ok = size >= 33 and body[:16] == PNG_HEAD and struct.unpack_from(">II", body, 16) == (w, h) and body.endswith(PNG_TAIL)
        elif size >= 40:
            header, bw, bh, planes, bits, packed, *_, colors, _ = struct.unpack_from("<IiiHHIIiiII", body)
            ok = header in (40, 108, 124) and (bw, bh, planes, packed) == (w, 2 * h, 1, 0) and bits in (1, 4, 8, 16, 24, 32) and colors <= (1 << bits if bits <= 8 else 0) and body[header:] != b"" and size == len(bitmap(w, h, bits, colors, header))
        else:
            ok = False
        if not ok:
            return False
        ranges.append((start, start + size))
    at = 6 + 16 * n
    for s, e in sorted(ranges):
        if s != at:
            return False
        at = e
    return at == len(c)


@pytest.fixture(scope="module")
def samples():
    rng, out = random.Random(9), [*GOOD, *BAD]
    for _ in range(400):  # one changed byte each, mostly among headers and records
        c = bytearray(rng.choice(GOOD))
        c[rng.randrange(min(len(c), 100))] = rng.choice([0, 1, 2, 4, 8, 16, 24, 40, 255])
        out.append(bytes(c))
    return out


def test_icons_agree_with_a_plain_reader(spark, samples):
    df = spark.createDataFrame([(k, None if c is None else bytearray(c)) for k, c in enumerate(samples)], "k int, content binary")
    got = {r.k: r.ok for r in df.select("k", icons.icon().alias("ok")).collect()}
    expected = {k: plain(c) for k, c in enumerate(samples)}
    assert got == expected
    assert all(got[k] for k in range(len(GOOD))) and not any(got[len(GOOD) + k] for k in range(len(BAD))) and 20 < sum(got.values()) < len(got) - 100


def test_icons_are_assets_and_broken_ones_possible_sources(spark):
    rows = [("a.ico", bytearray(GOOD[0])), ("b.ico", bytearray(GOOD[0][:-1])), ("c.py", bytearray(GOOD[0]))]
    df = spark.createDataFrame(rows, "relative_path string, content binary").select("relative_path", inventory.classified().alias("c"))
    assert {r.relative_path: r.c for r in df.collect()} == {"a.ico": "binary-asset", "b.ico": "possible-source", "c.py": "possible-source"}
