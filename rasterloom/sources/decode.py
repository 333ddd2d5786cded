"""Images from a binary column, of any table: PNG (all colour types, depths and filters, interlaced too) and uncompressed BMP."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the PNG format: channels by colour type; first column, first line and steps of the seven interlaced passes.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
#: Pixels that one image may have, so that a small file can't ask for any memory.
MOST_PIXELS = 1 << 28


def unfiltered(kind: np.ndarray, lines: np.ndarray, step: int) -> np.ndarray:
    """The bytes of lines (h, n) whose filters (0 to 4) are kind; step: bytes of a pixel.

    A byte depends on those to its left, above and above left. Lines without filters of the two kinds that need all three are sums; otherwise
    all pixels of a diagonal are worked out at once, so that there are h + w steps and not h times w.
    """
    h, n = lines.shape
    if h == 0 or n == 0 or not kind.any():
        return lines
    if (kind > 4).any():
        raise ValueError("unknown line filter")
    w = -(-n // step)
    px = np.zeros((h, w, step), np.int64)
    px.reshape(h, -1)[:, :n] = lines
    if (kind <= 1).all():
        px[kind == 1] = np.cumsum(px[kind == 1], axis=1)
        return (px & 255).astype(np.uint8).reshape(h, -1)[:, :n]
    if ((kind == 0) | (kind == 2)).all():
        # Each stretch of lines that add to the one above is summed from its first line.
        sums = np.cumsum(px, axis=0)
        start = np.maximum.accumulate(np.where(kind == 0, np.arange(h), 0))
        before = np.where((start > 0)[:, None, None], sums[start - 1], 0)
        return ((sums - before) & 255).astype(np.uint8).reshape(h, -1)[:, :n]
    out = np.zeros((h + 1, w + 1, step), np.int64)  # a line above and a pixel to the left of 0
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x, k = d - y, kind[y][:, None]
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        near = left + up - corner
        a, b, c = np.abs(near - left), np.abs(near - up), np.abs(near - corner)
        closest = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        add = np.where(k == 1, left, np.where(k == 2, up, np.where(k == 3, (left + up) >> 1, np.where(k == 4, closest, 0))))
        out[y + 1, x + 1] = (px[y, x] + add) & 255
    return out[1:, 1:].astype(np.uint8).reshape(h, -1)[:, :n]


def _samples(data: np.ndarray, w: int, h: int, depth: int, channels: int) -> tuple[np.ndarray, int]:
    """Samples (h, w, channels) of the filtered lines at the start of data, and how many bytes these took."""
    n = -(-w * depth * channels // 8)
    took = h * (n + 1)
    if len(data) < took:
        raise ValueError("not all lines are there")
    rows = data[:took].reshape(h, n + 1)
    lines = unfiltered(rows[:, 0], rows[:, 1:], max(1, depth * channels // 8))
    if depth == 16:
        values = np.ascontiguousarray(lines).view(">u2").astype(np.int64)
    elif depth == 8:
        values = lines.astype(np.int64)
    else:
        bits = np.unpackbits(lines, axis=1).reshape(h, -1, depth)
        values = bits @ (1 << np.arange(depth)[::-1])
    return values[:, : w * channels].reshape(h, w, channels), took


def png(content: bytes) -> tuple[np.ndarray, str]:
    """Values (h, w, 1 to 4 channels) in 0..1 and the mode (L, LA, RGB, RGBA, P or PA)."""
    at, found, idat = 8, {}, []
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if len(body) < size:
            raise ValueError("cut off")
        if kind == b"IDAT":
            idat.append(body)
        else:
            found.setdefault(kind, body)
        if kind == b"IEND":
            break
        at += 12 + size
    w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", found[b"IHDR"])
    if colour not in CHANNELS or not 0 < w * h <= MOST_PIXELS:
        raise ValueError("header out of range")
    channels = CHANNELS[colour]
    # No more is inflated than the lines need.
    data = np.frombuffer(zlib.decompressobj().decompress(b"".join(idat), h * (2 + w * channels * 2) + 16 * (h + w)), np.uint8)
    v = np.zeros((h, w, channels), np.int64)
    if interlaced:
        for x0, y0, dx, dy in PASSES:
            part = v[y0::dy, x0::dx]
            if part.size:
                part[...], took = _samples(data, part.shape[1], part.shape[0], depth, channels)
                data = data[took:]
    else:
        v, _ = _samples(data, w, h, depth, channels)
    clear = found.get(b"tRNS")
    if colour == 3:
        palette = np.frombuffer(found[b"PLTE"], np.uint8).reshape(-1, 3) / 255.0
        index = v[..., 0]
        if index.max() >= len(palette):
            raise ValueError("index beyond the palette")
        if clear is None:
            return palette[index], "P"
        alpha = np.ones(len(palette))
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(palette)] / 255.0
        return np.concatenate([palette[index], alpha[index][..., None]], axis=2), "PA"
    out = v / (2.0**depth - 1)
    if clear is not None and colour in (0, 2):
        key = np.frombuffer(clear, ">u2").astype(np.int64)[:channels]
        out = np.concatenate([out, (v != key).any(axis=2, keepdims=True).astype(float)], axis=2)
    return out, {1: "L", 2: "LA", 3: "RGB", 4: "RGBA"}[out.shape[2]]


def bmp(content: bytes) -> tuple[np.ndarray, str]:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits."""
    start, head, w, h, _, bits, packed = struct.unpack("<IIiiHHI", content[10:34])
    if packed not in (0, 3) or bits not in (8, 24, 32) or w <= 0 or not 0 < w * abs(h) <= MOST_PIXELS:
        raise ValueError("a kind of BMP that isn't read")
    n = (w * bits // 8 + 3) // 4 * 4
    lines = np.frombuffer(content, np.uint8, n * abs(h), start).reshape(abs(h), n)[:: -1 if h > 0 else 1, : w * bits // 8]
    v = lines.reshape(abs(h), w, bits // 8)
    if bits == 8:
        palette = np.frombuffer(content, np.uint8, start - 14 - head, 14 + head).reshape(-1, 4)[:, 2::-1] / 255.0
        return palette[v[..., 0]], "P"
    return v[..., 2::-1] / 255.0, "RGB"


def decoded(content: bytes | None) -> tuple[np.ndarray | None, str | None, str | None]:
    """(values, mode, error) of the bytes of a file."""
    try:
        if content and content[:8] == b"\x89PNG\r\n\x1a\n":
            return (*png(content), None)
        if content and content[:2] == b"BM":
            return (*bmp(content), None)
        return None, None, "not a PNG or BMP"
    except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
        return None, None, f"unreadable: {e}"


def decode(files: DataFrame, image_id: str = "image_id", content: str = "content") -> DataFrame:
    """Pixels (image_id, h, w, y, x, r, g, b, a, mode, error) of a binary column.

    Grey images have r = g = b; a is null without alpha. A file that can't be read, a null or an empty one, is one row with an error and nulls
    else. Bytes are read where they lie: nothing is shuffled, and a task holds one image at a time.
    """
    kind = files.schema[image_id].dataType.simpleString()
    names = ["image_id", "h", "w", "y", "x", "r", "g", "b", "a", "mode", "error"]

    def joined(parts: Iterator[pa.RecordBatch], least: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        """Small images together, so that a batch isn't as small as one of them."""
        held, n = [], 0
        for part in parts:
            held.append(part)
            n += part.num_rows
            if n >= least:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return joined(images(batches))

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                v, mode, error = decoded(batch.column(1)[i].as_py())
                one = batch.column(0).slice(i, 1)
                if v is None:
                    nothing = lambda t: pa.nulls(1, t)
                    yield pa.RecordBatch.from_arrays([one, *(nothing(pa.int32()) for _ in range(4)), *(nothing(pa.float64()) for _ in range(4)), nothing(pa.string()), pa.array([error])], names=names)
                    continue
                h, w, n = v.shape
                rows = max(1, (1 << 18) // w)
                for lo in range(0, h, rows):
                    p = v[lo : lo + rows].reshape(-1, n)
                    colours = [p[:, 0]] * 3 if n < 3 else [p[:, c] for c in range(3)]
                    size = len(p)
                    y, x = np.divmod(np.arange(size, dtype=np.int32), np.int32(w))
                    fixed = lambda value, t: pa.array([value], t).take(pa.array(np.zeros(size, np.int32)))
                    alpha = pa.array(p[:, n - 1]) if n in (2, 4) else pa.nulls(size, pa.float64())
                    yield pa.RecordBatch.from_arrays([one.take(pa.array(np.zeros(size, np.int32))), fixed(h, pa.int32()), fixed(w, pa.int32()), pa.array(y + np.int32(lo)), pa.array(x), *(pa.array(np.ascontiguousarray(c)) for c in colours), alpha, fixed(mode, pa.string()), pa.nulls(size, pa.string())], names=names)

    schema = f"image_id {kind}, h int, w int, y int, x int, r double, g double, b double, a double, mode string, error string"
    return files.select(F.col(image_id).alias("image_id"), F.col(content).alias("content")).mapInArrow(run, schema)
