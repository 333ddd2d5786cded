import struct
import zlib

import pytest

from rasterloom.sources import headers

from .test_decode import chunk


def png(depth=8, colour=2, extra=b""):
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 300, 20, depth, colour, 0, 0, 0)) + extra + chunk(b"IDAT", b"") + chunk(b"IEND", b"")


def jpeg(n=3, frame=0xC0, before=b""):
    segment = lambda m, b: struct.pack(">BBH", 0xFF, m, len(b) + 2) + b
    icc = b"ICC_PROFILE\0\1\2" + b"x" * 50_000
    return b"\xff\xd8" + before + segment(0xE0, b"JFIF\0" + bytes(9)) + segment(0xE2, icc) + segment(0xE2, icc[:114]) + segment(0xC4, bytes(20)) + b"\xff" + segment(frame, struct.pack(">BHHB", 8, 20, 300, n) + bytes(3 * n)) + b"\xff\xda"


def tiff(e, tags, after=0, far=b""):
    body = b"".join(struct.pack(e + "HHI", t, kind, count) + (struct.pack(e + "HH", v, 0) if kind == 3 and count < 3 else struct.pack(e + "I", v)) for t, kind, count, v in tags)
    return (b"II*\0" if e == "<" else b"MM\0*") + struct.pack(e + "I", 8) + struct.pack(e + "H", len(tags)) + body + struct.pack(e + "I", after) + far


def gif(frames=1, clear=False):
    one = b"\x21\xf9\x04" + bytes([clear, 0, 0, 0]) + b"\0" + b"\x2c" + bytes(8) + b"\x80" + bytes(6) + b"\2\3abc\0"
    return b"GIF89a" + struct.pack("<HHBBB", 300, 20, 0x81, 0, 0) + bytes(12) + b"\x21\xfe\3hey\0" + one * frames + b"\x3b"


def webp(kind, body):
    return b"RIFF" + struct.pack("<I", len(body) + 12) + b"WEBP" + kind + struct.pack("<I", len(body)) + body


def vp8x(flags, more=b""):
    return webp(b"VP8X", bytes([flags, 0, 0, 0]) + (299).to_bytes(3, "little") + (19).to_bytes(3, "little")) + more


SIZE = [(256, 4, 1, 300), (257, 3, 1, 20)]
CASES = [
    (png(), "PNG", "RGB", False, False, 0),
    (png(1, 0), "PNG", "1", False, False, 0),
    (png(16, 0), "PNG", "I;16", False, False, 0),
    (png(8, 3, chunk(b"tRNS", b"\0")), "PNG", "P", True, False, 0),
    (png(8, 6, chunk(b"acTL", struct.pack(">II", 3, 0)) + chunk(b"iCCP", b"name\0\0" + zlib.compress(b"p" * 999))), "PNG", "RGBA", True, True, 999),
    (jpeg(), "JPEG", "RGB", False, False, 50_100),
    (jpeg(1, 0xC2, b"\xff\xd0"), "JPEG", "L", False, False, 50_100),
    (jpeg(4), "JPEG", "CMYK", False, False, 50_100),
    (gif(), "GIF", "P", False, False, 0),
    (gif(3, True), "GIF", "P", True, True, 0),
    (b"BM" + bytes(12) + struct.pack("<IiiHH", 40, 300, -20, 1, 24) + bytes(24), "BMP", "RGB", False, False, 0),
    (tiff("<", [*SIZE, (262, 3, 1, 2), (277, 3, 1, 3), (34675, 7, 5_000, 90)]), "TIFF", "RGB", False, False, 5_000),
    (tiff(">", [*SIZE, (258, 3, 4, 74), (262, 3, 1, 2), (277, 3, 1, 4)], 99, struct.pack(">4H", 8, 8, 8, 8)), "TIFF", "RGBA", True, True, 0),
    (tiff(">", [*SIZE, (258, 3, 1, 8), (262, 3, 1, 1)]), "TIFF", "L", False, False, 0),
    (tiff("<", [*SIZE, (262, 3, 1, 0)]), "TIFF", "1", False, False, 0),
    (webp(b"VP8 ", bytes(3) + b"\x9d\1\x2a" + struct.pack("<HH", 300 | 1 << 14, 20) + bytes(9)), "WEBP", "RGB", False, False, 0),
    (webp(b"VP8L", b"\x2f" + struct.pack("<I", 299 | 19 << 14 | 1 << 28)), "WEBP", "RGBA", True, False, 0),
    (vp8x(0x32, b"ICCP" + struct.pack("<I", 77) + bytes(78)), "WEBP", "RGBA", True, True, 77),
    (vp8x(0), "WEBP", "RGB", False, False, 0),
]


@pytest.mark.parametrize("case", CASES, ids=lambda c: f"{c[1]}-{c[2]}")
def test_header(case):
    content, *want = case
    h = headers.header(content)
    assert [h[k] for k in ("format", "mode", "has_alpha", "animated", "icc_bytes")] == want
    assert (h["width"], h["height"], h["error"]) == (300, 20, None)


def test_what_cannot_be_read():
    for content, *_ in CASES:
        for n in range(len(content)):
            h = headers.header(content[:n]) if n < 200 else None
            assert h is None or h["error"] or (h["width"], h["height"]) == (300, 20)
    for bad in (None, b"", b"text", b"\xff\xd8\xff\xda", jpeg().replace(b"\x01\x2c", b"\0\0"), tiff("<", [(256, 4, 1, 5)]), b"RIFF....WEBPVP9 ...."):
        assert headers.header(bad)["error"]


def test_headers_of_a_table(spark):
    rows = [(i, c[0], "w") for i, c in enumerate(CASES)] + [(99, None, "w"), (99, b"zz", "w")]
    got = headers.headers(spark.createDataFrame(rows, "id int, content binary, width string").repartition(3)).collect()
    assert len(got) == len(rows)
    for g in got:
        if g.id == 99:
            assert g.error and g.width is None
        else:
            assert (g.format, g.mode, g.width, g.height, g.error) == (*CASES[g.id][1:3], 300, 20, None)
    assert headers.headers(spark.createDataFrame([], "content binary")).count() == 0
