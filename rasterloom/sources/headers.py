"""What the headers of image files say, from a binary column: PNG, JPEG, GIF, BMP, TIFF and WEBP. No pixel is decoded."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = [("format", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("mode", pa.string()), ("has_alpha", pa.bool_()), ("animated", pa.bool_()), ("icc_bytes", pa.int64()), ("error", pa.string())]
#: A profile packed in a PNG is inflated to so many bytes at most.
MOST_PROFILE = 1 << 24

Found = dict[str, object]


def _png(c: bytes) -> Found:
    w, h, depth, colour = struct.unpack(">IIBB", c[16:26])
    mode = {0: {1: "1", 16: "I;16"}.get(depth, "L"), 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}[colour]
    at, clear, frames, profile = 8, False, 1, 0
    while at + 8 <= len(c):
        size, kind = struct.unpack(">I4s", c[at : at + 8])
        body = c[at + 8 : at + 8 + size]
        if kind in (b"IDAT", b"IEND"):
            break
        if kind == b"tRNS":
            clear = True
        elif kind == b"acTL":
            frames = struct.unpack(">I", body[:4])[0]
        elif kind == b"iCCP":
            profile = len(zlib.decompressobj().decompress(body[body.index(b"\0") + 2 :], MOST_PROFILE))
        at += 12 + size
    return {"width": w, "height": h, "mode": mode, "has_alpha": clear or mode in ("LA", "RGBA"), "animated": frames > 1, "icc_bytes": profile}


def _jpeg(c: bytes) -> Found:
    at, profile = 2, 0
    while True:
        while c[at] == 0xFF and c[at + 1] == 0xFF:
            at += 1
        mark = c[at + 1]
        if c[at] != 0xFF or mark in (0xD9, 0xDA):
            raise ValueError("no frame before the image data")
        if mark == 0x01 or 0xD0 <= mark <= 0xD8:
            at += 2
            continue
        size = struct.unpack(">H", c[at + 2 : at + 4])[0]
        if size < 2:
            raise ValueError("empty segment")
        body = c[at + 4 : at + 2 + size]
        if mark == 0xE2 and body.startswith(b"ICC_PROFILE\0"):
            profile += len(body) - 14
        # Frames are C0 to CF without the tables C4, C8 and CC.
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w, n = struct.unpack(">HHB", body[1:6])
            return {"width": w, "height": h, "mode": {1: "L", 3: "RGB", 4: "CMYK"}[n], "has_alpha": False, "animated": False, "icc_bytes": profile}
        at += 2 + size


def _gif(c: bytes) -> Found:
    w, h, flags = struct.unpack("<HHB", c[6:11])
    at, frames, clear = 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0), 0, False

    def past_blocks(at: int) -> int:
        while c[at]:
            at += c[at] + 1
        return at + 1

    while at < len(c) and c[at] != 0x3B and frames < 2:
        if c[at] == 0x21:
            if c[at + 1] == 0xF9 and not frames:
                clear = bool(c[at + 3] & 1)
            at = past_blocks(at + 2)
        elif c[at] == 0x2C:
            frames += 1
            local = c[at + 9]
            at = past_blocks(at + 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0))
        else:
            raise ValueError("unknown block")
    return {"width": w, "height": h, "mode": "P", "has_alpha": clear, "animated": frames > 1, "icc_bytes": 0}


def _bmp(c: bytes) -> Found:
    w, h, _, bits = struct.unpack("<iiHH", c[18:30])
    return {"width": w, "height": abs(h), "mode": {1: "1", 4: "P", 8: "P"}.get(bits, "RGB"), "has_alpha": False, "animated": False, "icc_bytes": 0}


def _tiff(c: bytes) -> Found:
    e = "<" if c[:2] == b"II" else ">"
    start = struct.unpack(e + "I", c[4:8])[0]
    n = struct.unpack(e + "H", c[start : start + 2])[0]
    tags: dict[int, tuple[int, int]] = {}
    for at in range(start + 2, start + 2 + 12 * n, 12):
        tag, kind, count = struct.unpack(e + "HHI", c[at : at + 8])
        size, code = {1: (1, "B"), 3: (2, "H"), 4: (4, "I")}.get(kind, (0, ""))
        # Values of more than four bytes stand elsewhere; of those the first is read.
        where = at + 8 if size * count <= 4 else struct.unpack(e + "I", c[at + 8 : at + 12])[0]
        tags[tag] = (count, struct.unpack(e + code, c[where : where + size])[0] if size else 0)
    after = struct.unpack(e + "I", c[start + 2 + 12 * n : start + 6 + 12 * n])[0]
    value = lambda tag, other: tags.get(tag, (0, other))[1]
    samples, kind, bits = value(277, 1), value(262, 1), value(258, 1)
    if kind <= 1:
        mode = "LA" if samples == 2 else {1: "1", 16: "I;16"}.get(bits, "L")
    else:
        mode = {2: "RGBA" if samples >= 4 else "RGB", 3: "P", 5: "CMYK"}.get(kind, "RGB")
    return {"width": tags[256][1], "height": tags[257][1], "mode": mode, "has_alpha": mode in ("LA", "RGBA"), "animated": after != 0, "icc_bytes": tags.get(34675, (0, 0))[0]}


def _webp(c: bytes) -> Found:
    kind, body = c[12:16], c[20:]
    found: Found = {"mode": "RGB", "animated": False, "icc_bytes": 0}
    if kind == b"VP8 ":
        w, h = struct.unpack("<HH", body[6:10])
        found |= {"width": w & 0x3FFF, "height": h & 0x3FFF}
    elif kind == b"VP8L":
        bits = struct.unpack("<I", body[1:5])[0]
        found |= {"width": (bits & 0x3FFF) + 1, "height": (bits >> 14 & 0x3FFF) + 1, "mode": "RGBA" if bits >> 28 & 1 else "RGB"}
    elif kind == b"VP8X":
        flags, w, h = body[0], int.from_bytes(body[4:7], "little") + 1, int.from_bytes(body[7:10], "little") + 1
        if len(body) < 10:
            raise ValueError("cut off")
        profile = struct.unpack("<I", body[14:18])[0] if flags & 0x20 and body[10:14] == b"ICCP" else 0
        found |= {"width": w, "height": h, "mode": "RGBA" if flags & 0x10 else "RGB", "animated": bool(flags & 2), "icc_bytes": profile}
    else:
        raise ValueError("unknown first chunk")
    return found | {"has_alpha": found["mode"] == "RGBA"}


#: (first bytes, bytes from place 8 on, format, reader)
KINDS = [(b"\x89PNG\r\n\x1a\n", b"", "PNG", _png), (b"\xff\xd8\xff", b"", "JPEG", _jpeg), (b"GIF8", b"", "GIF", _gif), (b"BM", b"", "BMP", _bmp), (b"II*\0", b"", "TIFF", _tiff), (b"MM\0*", b"", "TIFF", _tiff), (b"RIFF", b"WEBP", "WEBP", _webp)]


def header(content: bytes | None) -> Found:
    """The fields of one file; of one that can't be read, the error."""
    for first, then, name, read in KINDS:
        if content and content.startswith(first) and content[8:].startswith(then):
            try:
                found = read(content)
                if found["width"] <= 0 or found["height"] <= 0:
                    raise ValueError("no size")
                return {"format": name, **found, "error": None}
            except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
                return {"format": name, "error": f"unreadable {name}: {e}"}
    return {"error": "not an image that can be read"}


def headers(files: DataFrame, content: str = "content") -> DataFrame:
    """files (all columns but the content) with format, width, height, mode, has_alpha, animated, icc_bytes and error.

    Modes are 1, L, LA, I;16, P, RGB, RGBA or CMYK. A file that can't be read, a null or an empty one, has an error and nulls. Rows stay where
    they are; an empty table gives no rows; columns of the new names are replaced.
    """
    new = [n for n, _ in FIELDS]
    rest = [c for c in files.columns if c != content and c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [header(c.as_py()) for c in batch.column(len(rest))]
            columns = [pa.array([f.get(n) for f in found], t) for n, t in FIELDS]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(rest))), *columns], names=[*rest, *new])

    kinds = [f"`{c}` {files.schema[c].dataType.simpleString()}" for c in rest]
    return files.select(*rest, F.col(content).alias("__content")).mapInArrow(run, ", ".join([*kinds, "format string, width int, height int, mode string, has_alpha boolean, animated boolean, icc_bytes long, error string"]))
