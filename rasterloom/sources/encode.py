"""Image files from relations of pixels, strip by strip: baseline JPEG, PNG and TIFF.

All three formats can be cut into parts that are coded apart: JPEG has restart intervals, a deflate stream can be flushed and the checksums of its
parts be joined, TIFF has strips. So a strip of lines is a row and is coded in whatever task it lies; only the coded bytes of an image meet, as
its file is one value.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import color
from rasterloom.operators import tilework

#: Pixels of a strip (whole groups of eight lines, one at least).
STRIP = 1 << 18

# Fixed values of the JPEG format's annex: quantisation of luma and chroma at quality 50, line by line.
LUMA_STEPS = """
16 11 10 16 24 40 51 61
12 12 14 19 26 58 60 55
14 13 16 24 40 57 69 56
14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77
24 35 55 64 81 104 113 92
49 64 78 87 103 121 120 101
72 92 95 98 112 100 103 99
"""
CHROMA_STEPS = """
17 18 24 47 99 99 99 99
18 21 26 66 99 99 99 99
24 26 56 99 99 99 99 99
47 66 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
"""
# From red, green, blue to luma and the two chroma channels of JPEG files.
TO_YCC = np.array([[0.299, 0.587, 0.114], [-0.168735892, -0.331264108, 0.5], [0.5, -0.418687589, -0.081312411]])
#: The order in which a block's frequencies are written: diagonals, up and down in turn.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
#: The cosine transform of eight values.
COSINES = np.sqrt(np.where(np.arange(8) == 0, 1, 2) / 8)[:, None] * np.cos(np.pi * np.arange(8)[:, None] * (2 * np.arange(8) + 1) / 16)


def steps(table: str, quality: int) -> np.ndarray:
    """Quantisation steps (8 x 8) at a quality of 1 to 100."""
    q = min(100, max(1, quality))
    percent = 5000 // q if q < 50 else 200 - 2 * q
    return np.clip((np.array(table.split(), int) * percent + 50) // 100, 1, 255).reshape(8, 8)


def code_lengths(weights: dict[int, float]) -> dict[int, int]:
    """Lengths (16 at most) of a prefix code for symbols of these weights, with the code of ones alone left free."""
    least = min(weights.values())
    while True:
        heap = [(max(w, least), i, {s: 0}) for i, (s, w) in enumerate(weights.items())] + [(0.0, -1, {-1: 0})]
        heapq.heapify(heap)
        n = len(heap)
        while len(heap) > 1:
            a, _, x = heapq.heappop(heap)
            b, _, y = heapq.heappop(heap)
            heapq.heappush(heap, (a + b, n, {s: k + 1 for s, k in (x | y).items()}))
            n += 1
        found = heap[0][2]
        if max(found.values()) <= 16:
            return {s: k for s, k in found.items() if s >= 0}
        least *= 2


@lru_cache
def huffman(kind: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The table as a file holds it, and codes and lengths by symbol.

    Weights follow from a rule, so that all strips share one table and no pass over an image goes before: sizes of first values are likeliest
    at 2; of the others, each zero before a value and each bit of it makes it rarer.
    """
    if kind == "first":
        weights = {s: 2.0 ** -abs(s - 2) for s in range(12)}
    else:
        weights = {run << 4 | size: 2.0 ** -(0.45 * run + 1.1 * size) for run in range(16) for size in range(1, 11)}
        weights |= {0x00: 0.5, 0xF0: 2.0**-9}
    lengths = code_lengths(weights)
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    codes, bits = np.zeros(256, np.int64), np.zeros(256, np.int64)
    code = last = 0
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s], bits[s] = code, last
        code += 1
    return bytes(sum(k == n for k in lengths.values()) for n in range(1, 17)) + bytes(order), codes, bits


def _size(v: np.ndarray) -> np.ndarray:
    """Bits of the absolute values."""
    return np.frexp(np.abs(v).astype(float))[1].astype(np.int64)


def _entropy(z: np.ndarray) -> bytes:
    """Coded bytes of blocks (n, components, 64) of frequencies in the order of ZIGZAG."""
    return _entropies(z[None])[0]


def _entropies(z: np.ndarray) -> list[bytes]:
    """Coded bytes of each of several strips (strips, n, components, 64), coded at once."""
    strips = len(z)
    _, dc_codes, dc_bits = huffman("first")
    _, ac_codes, ac_bits = huffman("others")
    first = np.diff(z[..., 0], axis=1, prepend=0).reshape(-1)
    blocks = z.shape[1] * z.shape[2]
    z = z.reshape(-1, 64)
    signed = lambda v, n: v + np.where(v < 0, (1 << n) - 1, 0)  # noqa: E731  below zero: one less, so that the first bit is 0
    n = _size(first)
    codes, lengths = [dc_codes[n] << n | signed(first, n)], [dc_bits[n] + n]
    places = [np.arange(len(z)) * 65]
    block, at = np.nonzero(z[:, 1:])
    same = np.r_[False, block[1:] == block[:-1]]
    run = at - np.where(same, np.r_[-1, at[:-1]], -1) - 1
    # Each sixteen zeros are a symbol of their own before the value's.
    row = np.repeat(np.arange(len(run)), run // 16 + 1)
    value = np.r_[row[1:] != row[:-1], True][: len(row)]
    v = z[block, at + 1][row]
    n = np.where(value, _size(v), 0)
    symbol = np.where(value, (run[row] % 16) << 4 | n, 0xF0)
    codes.append(ac_codes[symbol] << n | np.where(value, signed(v, n), 0))
    lengths.append(ac_bits[symbol] + n)
    places.append(block[row] * 65 + at[row] + 1)
    # Blocks with zeros at their end say so.
    end = np.flatnonzero(z[:, 63] == 0)
    codes.append(np.full(len(end), ac_codes[0]))
    lengths.append(np.full(len(end), ac_bits[0]))
    places.append(end * 65 + 64)
    places = np.concatenate(places)
    order = np.argsort(places, kind="stable")
    codes, lengths = np.concatenate(codes)[order], np.concatenate(lengths)[order]
    # Each strip begins with a new byte; the last one of a strip is filled up with ones.
    strip = places[order] // (65 * blocks)
    size = np.bincount(strip, lengths, strips).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(-(-size // 8))])
    ends = np.cumsum(lengths) + (start[:-1] * 8 - np.concatenate([[0], np.cumsum(size)[:-1]]))[strip]
    below = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    bits = np.ones(start[-1] * 8, np.uint8)
    bits[np.repeat(ends - lengths, lengths) + below] = np.repeat(codes, lengths) >> (np.repeat(lengths, lengths) - 1 - below) & 1
    coded = np.packbits(bits).tobytes()
    return [coded[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]


def jpeg_strip(v: np.ndarray, quality: int) -> bytes:
    """The entropy-coded bytes of one restart interval: lines (h, w, 1 or 3) of 8 bits."""
    return jpeg_strips(v[None], quality)[0]


def jpeg_strips(v: np.ndarray, quality: int) -> list[bytes]:
    """jpeg_strip of each of several strips (strips, h, w, 1 or 3), coded at once."""
    strips, h, w, n = v.shape
    f = v.astype(float) - 128 if n == 1 else v @ TO_YCC.T - np.array([128, 0, 0])
    f = np.pad(f, ((0, 0), (0, -h % 8), (0, -w % 8), (0, 0)), mode="edge")
    f = f.reshape(strips, f.shape[1] // 8, 8, f.shape[2] // 8, 8, n).transpose(0, 1, 3, 5, 2, 4)
    step = np.stack([steps(LUMA_STEPS, quality)] + [steps(CHROMA_STEPS, quality)] * (n - 1))
    q = np.rint(COSINES @ f @ COSINES.T / step).astype(np.int64)
    return _entropies(q.reshape(strips, -1, n, 64)[..., ZIGZAG])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def jpeg_file(h: int, w: int, n: int, lines: int, strips: list[bytes], quality: int, icc: bytes | None = None, exif: bytes | None = None) -> bytes:
    """A file of strips of `lines` lines each; ICC profiles are split into segments, EXIF must fit into one."""
    if max(h, w) > 65535:
        raise ValueError("JPEG holds 65,535 pixels a side")
    out = [b"\xff\xd8", _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")]
    if exif:
        if len(exif) > 65527:
            raise ValueError("EXIF beyond one segment")
        out.append(_segment(0xE1, b"Exif\0\0" + exif))
    parts = [icc[i : i + 65519] for i in range(0, len(icc or b""), 65519)]
    if len(parts) > 255:
        raise ValueError("ICC profile beyond 255 segments")
    out += [_segment(0xE2, b"ICC_PROFILE\0" + bytes([i, len(parts)]) + p) for i, p in enumerate(parts, 1)]
    for i, table in enumerate([LUMA_STEPS, CHROMA_STEPS][: 1 + (n > 1)]):
        out.append(_segment(0xDB, bytes([i]) + bytes(steps(table, quality).reshape(-1)[ZIGZAG].tolist())))
    out.append(_segment(0xC0, struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes([c + 1, 0x11, c > 0]) for c in range(n))))
    out += [_segment(0xC4, b"\x00" + huffman("first")[0]), _segment(0xC4, b"\x10" + huffman("others")[0])]
    if len(strips) > 1:
        out.append(_segment(0xDD, struct.pack(">H", -(-w // 8) * (lines // 8))))
    out.append(_segment(0xDA, bytes([n]) + b"".join(bytes([c + 1, 0]) for c in range(n)) + b"\x00\x3f\x00"))
    for i, s in enumerate(strips):
        out += [s, bytes([0xFF, 0xD0 + i % 8]) if i + 1 < len(strips) else b"\xff\xd9"]
    return b"".join(out)


def png_strip(v: np.ndarray, last: bool) -> tuple[bytes, int, int]:
    """Deflated lines, their checksum and length; each line's filter is that of the least sum of absolute values."""
    return _deflated(png_lines(v[None])[0].tobytes(), last)


def _deflated(lines: bytes, last: bool) -> tuple[bytes, int, int]:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    return z.compress(lines) + z.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH), zlib.adler32(lines), len(lines)


def png_lines(v: np.ndarray) -> np.ndarray:
    """The filtered lines (strips, h, bytes) of several strips (strips, h, w, channels), each begun by the number of its filter."""
    strips, h, w, n = v.shape
    raw = v.reshape(strips, h, w * n).astype(np.int16)
    left = np.pad(raw, ((0, 0), (0, 0), (n, 0)))[..., : w * n]
    up, corner = (np.pad(x, ((0, 0), (1, 0), (0, 0)))[:, :h] for x in (raw, left))
    a, b, c = (np.abs(x) for x in (up - corner, left - corner, left + up - 2 * corner))
    closest = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
    kinds = np.stack([x.astype(np.uint8) for x in (raw, raw - left, raw - up, raw - ((left + up) >> 1), raw - closest)])
    cost = np.abs(kinds.view(np.int8).astype(np.int64)).sum(axis=3)
    cost[2:, :, 0] = np.iinfo(np.int64).max  # the line above lies in another strip
    best = cost.argmin(axis=0)
    lines = np.take_along_axis(kinds, best[None, ..., None], axis=0)[0]
    return np.concatenate([best[..., None].astype(np.uint8), lines], axis=2)


def joined_checksum(parts: list[tuple[int, int]]) -> int:
    """Adler-32 of joined parts from (checksum, length) of each."""
    low, high = 1, 0
    for sum_, n in parts:
        high = (high + (sum_ >> 16) + n * (low - 1)) % 65521
        low = (low + (sum_ & 0xFFFF) - 1) % 65521
    return high << 16 | low


def png_file(h: int, w: int, n: int, strips: list[bytes], sums: list[tuple[int, int]], icc: bytes | None = None, exif: bytes | None = None) -> bytes:
    chunk = lambda t, b: struct.pack(">I", len(b)) + t + b + struct.pack(">I", zlib.crc32(t + b))
    out = [b"\x89PNG\r\n\x1a\n", chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0))]
    if icc:
        out.append(chunk(b"iCCP", b"ICC\0\0" + zlib.compress(icc)))
    if exif:
        out.append(chunk(b"eXIf", exif))
    strips = [b"\x78\x9c" + strips[0], *strips[1:]]
    strips[-1] += struct.pack(">I", joined_checksum(sums))
    return b"".join([*out, *(chunk(b"IDAT", s) for s in strips), chunk(b"IEND", b"")])


def tiff_strip(v: np.ndarray) -> bytes:
    """Deflated differences of neighbouring pixels."""
    return zlib.compress(np.diff(v, axis=1, prepend=np.zeros_like(v[:, :1])).tobytes())


def tiff_file(h: int, w: int, n: int, lines: int, strips: list[bytes], icc: bytes | None = None) -> bytes:
    if sum(map(len, strips)) + len(icc or b"") > (1 << 32) - (1 << 20):
        raise ValueError("TIFF holds 4 GiB")
    sizes = [len(s) for s in strips]
    # Tags: number, bytes a value, values; values of more than four bytes lie behind the list.
    tags = [(256, 4, [w]), (257, 4, [h]), (258, 2, [8] * n), (259, 2, [8]), (262, 2, [2 if n > 2 else 1]), (273, 4, [8 + sum(sizes[:i]) for i in range(len(strips))])]
    tags += [(277, 2, [n]), (278, 4, [lines]), (279, 4, sizes), (284, 2, [1]), (317, 2, [2])]
    if n in (2, 4):
        tags.append((338, 2, [2]))
    if icc:
        tags.append((34675, 1, list(icc)))
    body = b"".join(strips)
    body += b"\0" * (len(body) % 2)
    at = 8 + len(body)
    behind = at + 2 + 12 * len(tags) + 4
    listed, more = struct.pack("<H", len(tags)), b""
    for tag, size, values in tags:
        packed = bytes(values) if size == 1 else struct.pack(f"<{len(values)}{'H' if size == 2 else 'I'}", *values)
        field = packed.ljust(4, b"\0") if len(packed) <= 4 else struct.pack("<I", behind + len(more))
        if len(packed) > 4:
            more += packed + b"\0" * (len(packed) % 2)
        listed += struct.pack("<HHI", tag, {1: 7, 2: 3, 4: 4}[size], len(values)) + field
    return b"II*\0" + struct.pack("<I", at) + body + listed + b"\0" * 4 + more


def _files(v: np.ndarray, fmt: str, quality: int, strip: int) -> list[bytes]:
    """The files of images (images, h, w, channels) of 8 bits and one size."""
    images, h, w, n = v.shape
    rows = max(1, strip // w // 8) * 8
    parts = [v[:, y : y + rows] for y in range(0, h, rows)]
    if fmt == "PNG":
        lines = [png_lines(p) for p in parts]
        coded = [[_deflated(p[i].tobytes(), k + 1 == len(parts)) for k, p in enumerate(lines)] for i in range(images)]
        return [png_file(h, w, n, [c[0] for c in one], [c[1:] for c in one]) for one in coded]
    if fmt == "JPEG":
        return [jpeg_file(h, w, n, rows, list(one), quality) for one in zip(*(jpeg_strips(p, quality) for p in parts), strict=True)]
    return [tiff_file(h, w, n, rows, [tiff_strip(p[i]) for p in parts]) for i in range(images)]


def _encode_rows(rows: DataFrame, fmt: str, quality: int, strip: int) -> DataFrame:
    """encode for images that are rows of arrays."""
    channels = [*"rgb", *(["a"] if "a" in rows.columns and fmt != "JPEG" else [])]

    def coded(ids: pa.Array, v: np.ndarray) -> pa.RecordBatch:
        levels = np.floor(np.clip(v, 0, 1) * 255.0 + 0.5).astype(np.uint8).transpose(1, 2, 3, 0)
        try:
            files, error = _files(levels, fmt, quality, strip), None
        except (ValueError, struct.error) as e:
            files, error = [None] * len(ids), str(e)
        return pa.RecordBatch.from_arrays([ids, pa.array([fmt] * len(ids)), pa.array(files, pa.binary()), pa.array([error] * len(ids), pa.string())], names=["image_id", "format", "content", "error"])

    return tilework.of_rows(rows, channels, coded, f"{tilework.schema_of(rows, ['image_id'])}, format string, content binary, error string")


def encode(px: DataFrame, fmt: str = "PNG", quality: int = 95, gray: bool = False, meta: DataFrame | None = None, strip: int = STRIP) -> DataFrame:
    """(image_id, format, content, error): the file of each image of px (image_id, h, w, y, x, r, g, b[, a]).

    Values are rounded to 8 bits, nulls to 0 (1 in a); gray keeps the luma. JPEG has no alpha. meta (image_id, icc, exif: binary) is carried along, EXIF not in
    TIFF. A pixel that isn't there is black and clear. An image that the format can't hold is a row with an error. No rows give no rows.
    Pixels are shuffled once, as one number each, to strips of `strip` pixels; a task holds one strip. Images that are rows of arrays (without nulls,
    gray and meta) are coded in their rows.
    """
    if fmt not in ("PNG", "JPEG", "TIFF"):
        raise ValueError(f"no encoder for {fmt}")
    if tilework.by_rows(px):
        if gray or meta is not None:
            raise ValueError("rows of arrays are coded in colour and without meta")
        return _encode_rows(px, fmt, quality, strip)
    level = lambda c, none: F.floor(color.clip01(F.coalesce(c, F.lit(none))) * 255.0 + 0.5).cast("long")
    channels = [level(color.luminance(), 0.0)] if gray else [level(F.col(c), 0.0) for c in "rgb"]
    if "a" in px.columns and fmt != "JPEG":
        channels.append(level(F.col("a"), 1.0))
    n = len(channels)
    kind = px.schema["image_id"].dataType
    lines = F.greatest(F.lit(1), F.floor(F.lit(strip) / F.col("w") / 8)).cast("int") * 8
    d = px.select("image_id", F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *(c.alias(f"c{i}") for i, c in enumerate(channels)))
    packed = sum((F.col(f"c{i}") * (1 << 8 * i) for i in range(1, n)), F.col("c0"))
    d = d.select("image_id", "h", "w", F.floor(F.col("y") / lines).cast("int").alias("strip"), (((F.col("y") % lines) * F.col("w") + F.col("x")).cast("long") * (1 << 32) + packed).alias("p"))
    d = d.groupBy("image_id", "h", "w", "strip").agg(F.collect_list("p").alias("p"))
    d = d.select("image_id", "h", "w", lines.alias("lines"), "strip", "p")
    rest = ["image_id", "h", "w", "lines", "strip"]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(*(batch.column(c).to_pylist() for c in ("h", "w", "lines", "strip")), strict=True)
            content, sums, lengths = [], [], []
            for i, (h, w, rows, s) in enumerate(sizes):
                p = batch.column("p")[i].values.to_numpy(zero_copy_only=False)
                v = np.zeros((min(rows, h - s * rows), w, n), np.uint8)
                v.reshape(-1, n)[p >> 32] = (p[:, None] >> 8 * np.arange(n)) & 255
                sum_, length = 0, 0
                if fmt == "PNG":
                    b, sum_, length = png_strip(v, (s + 1) * rows >= h)
                else:
                    b = jpeg_strip(v, quality) if fmt == "JPEG" else tiff_strip(v)
                content.append(b)
                sums.append(sum_)
                lengths.append(length)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(content, pa.binary()), pa.array(sums, pa.int64()), pa.array(lengths, pa.int64())], names=[*rest, "coded", "sum", "length"])

    schema = d.select(*rest).schema.add("coded", "binary").add("sum", "long").add("length", "long")
    s = d.mapInArrow(coded, schema)
    files = s.groupBy("image_id", "h", "w", "lines").agg(F.sort_array(F.collect_list(F.struct("strip", "coded", "sum", "length"))).alias("strips"))
    if meta is None:
        files = files.withColumns({"icc": F.lit(None).cast("binary"), "exif": F.lit(None).cast("binary")})
    else:
        files = files.join(meta.groupBy("image_id").agg(F.first("icc", ignorenulls=True).alias("icc"), F.first("exif", ignorenulls=True).alias("exif")), "image_id", "left")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, errors = [], []
            for i in range(batch.num_rows):
                h, w, rows, strips, icc, exif = (batch.column(c)[i].as_py() for c in ("h", "w", "lines", "strips", "icc", "exif"))
                try:
                    # A strip without any pixel is missing here; such an image can't be written.
                    if [x["strip"] for x in strips] != list(range(-(-h // rows))):
                        raise ValueError("lines are missing")
                    parts = [x["coded"] for x in strips]
                    if fmt == "PNG":
                        b = png_file(h, w, n, parts, [(x["sum"], x["length"]) for x in strips], icc, exif)
                    else:
                        b = jpeg_file(h, w, n, rows, parts, quality, icc, exif) if fmt == "JPEG" else tiff_file(h, w, n, rows, parts, icc)
                    content.append(b)
                    errors.append(None)
                except (ValueError, struct.error) as e:
                    content.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), pa.array([fmt] * batch.num_rows), pa.array(content, pa.binary()), pa.array(errors, pa.string())], names=["image_id", "format", "content", "error"])

    return files.mapInArrow(whole, f"image_id {kind.simpleString()}, format string, content binary, error string")
