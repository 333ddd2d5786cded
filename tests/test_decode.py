import random
import struct
import zlib

import numpy as np
import pytest

from rasterloom.plans import pipeline, phase
from rasterloom.sources import decode

from .test_pipeline_fitted import picture


def one_by_one(kind, lines, step):
    """The filters as they are defined, byte by byte."""
    h, n = lines.shape
    out = np.zeros((h, n), int)
    for y in range(h):
        for i in range(n):
            a = out[y, i - step] if i >= step else 0
            b = out[y - 1, i] if y else 0
            c = out[y - 1, i - step] if y and i >= step else 0
            p = a + b - c
            nearest = min((abs(p - v), k, v) for k, v in enumerate((a, b, c)))[2]
            out[y, i] = (int(lines[y, i]) + [0, a, b, (a + b) // 2, nearest][kind[y]]) % 256
    return out.astype(np.uint8)


def test_filters():
    r = np.random.default_rng(1)
    for h, n, step in [(1, 1, 1), (5, 7, 1), (9, 12, 3), (4, 24, 8), (12, 10, 4)]:
        lines = r.integers(0, 256, (h, n)).astype(np.uint8)
        for some in ([0], [1], [0, 1], [2], [0, 2], [3], [4], [0, 1, 2, 3, 4]):
            kind = r.choice(some, h)
            assert (decode.unfiltered(kind, lines, step) == one_by_one(kind, lines, step)).all(), (h, n, step, some)
    with pytest.raises(ValueError):
        decode.unfiltered(np.array([5]), np.zeros((1, 3), np.uint8), 1)


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def packed(v, depth):
    h = len(v)
    if depth == 16:
        return v.astype(">u2").reshape(h, -1).view(np.uint8)
    bits = (v.reshape(h, -1)[:, :, None] >> np.arange(depth)[::-1]) & 1
    return np.packbits(bits.reshape(h, -1).astype(np.uint8), axis=1)


def filtered(lines, step, r):
    """Lines behind random filters, made from the raw neighbours."""
    out = []
    raw = lines.astype(int)
    for y, line in enumerate(raw):
        k = r.randrange(5)
        left = np.concatenate([np.zeros(step, int), line])[: len(line)]
        up = raw[y - 1] if y else np.zeros(len(line), int)
        corner = np.concatenate([np.zeros(step, int), up])[: len(line)]
        p = left + up - corner
        pick = [min((abs(q - v), i, v) for i, v in enumerate(t))[2] for q, t in zip(p, zip(left, up, corner, strict=True), strict=True)]
        out.append(bytes([k]) + ((line - [0 * line, left, up, (left + up) // 2, np.array(pick, int)][k]) % 256).astype(np.uint8).tobytes())
    return b"".join(out)


def written(v, depth, colour, r, interlaced=False, extra=b""):
    step = max(1, depth * v.shape[2] // 8)
    parts = [v[y::dy, x::dx] for x, y, dx, dy in decode.PASSES] if interlaced else [v]
    data = b"".join(filtered(packed(p, depth), step, r) for p in parts if p.size)
    head = struct.pack(">IIBBBBB", v.shape[1], v.shape[0], depth, colour, 0, 0, interlaced)
    z = zlib.compress(data)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + extra + chunk(b"tEXt", b"any") + chunk(b"IDAT", z[:7]) + chunk(b"IDAT", z[7:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [False, True])
def test_all_kinds(interlaced):
    r, g = random.Random(2), np.random.default_rng(2)
    for colour, depths in [(0, (1, 2, 4, 8, 16)), (2, (8, 16)), (4, (8, 16)), (6, (8, 16))]:
        for depth in depths:
            v = g.integers(0, 2**depth, (9, 13, decode.CHANNELS[colour]))
            got, mode = decode.png(written(v, depth, colour, r, interlaced))
            assert np.allclose(got, v / (2**depth - 1)) and mode == {0: "L", 2: "RGB", 4: "LA", 6: "RGBA"}[colour]
            if colour in (0, 2):
                got, mode = decode.png(written(v, depth, colour, r, interlaced, chunk(b"tRNS", v[3, 4].astype(">u2").tobytes())))
                assert mode == {0: "LA", 2: "RGBA"}[colour] and (got[..., -1] == (v != v[3, 4]).any(axis=2)).all()
    for depth in (1, 2, 4, 8):
        palette = g.integers(0, 256, (2**depth, 3)).astype(np.uint8)
        v = g.integers(0, 2**depth, (5, 11, 1))
        table = chunk(b"PLTE", palette.tobytes())
        got, mode = decode.png(written(v, depth, 3, r, interlaced, table))
        assert mode == "P" and np.allclose(got * 255, palette[v[..., 0]])
        got, mode = decode.png(written(v, depth, 3, r, interlaced, table + chunk(b"tRNS", b"\x07")))
        assert mode == "PA" and np.allclose(got[..., 3] * 255, np.where(v[..., 0] == 0, 7, 255))


def test_bmp_and_what_cannot_be_read():
    v = np.random.default_rng(3).integers(0, 256, (4, 5, 3)).astype(np.uint8)
    for up in (1, -1):
        body = b"".join(line[:, ::-1].tobytes() + b"\0" for line in v[:: -up])
        file = b"BM" + struct.pack("<IHHIIiiHHIIiiII", 0, 0, 0, 54, 40, 5, 4 * up, 1, 24, 0, 0, 0, 0, 0, 0) + body
        assert (decode.bmp(file)[0] * 255 == v).all()
    good = written(v.astype(int), 8, 2, random.Random(1))
    for bad in (None, b"", b"GIF89a", good[:40], good[:-30], b"\x89PNG\r\n\x1a\n", good.replace(struct.pack(">II", 5, 4), struct.pack(">II", 1 << 30, 1 << 30)), file[:60], good[:60] + b"\xff" * 9 + good[69:]):
        values, mode, error = decode.decoded(bad)
        assert values is None and mode is None and error


def test_bytes_to_bytes(spark):
    r, g = random.Random(5), np.random.default_rng(5)
    files = {"grey": written(g.integers(0, 256, (6, 7, 1)), 8, 0, r), "colour": written(g.integers(0, 256, (5, 9, 3)), 8, 2, r), "clear": written(g.integers(0, 65536, (4, 4, 4)), 16, 6, r, True), "bad": b"nothing", "none": None}
    df = spark.createDataFrame([(k, v, 1) for k, v in files.items()], "name string, content binary, h int")
    opts = pipeline.Options(scale=2.0, backend="nearest", detail=0.0, alpha_mode="nearest")
    out = {x.image_id: x for x in pipeline.enhance_bytes(df, opts, "name").collect()}
    assert set(out) == set(files)
    for k in ("grey", "colour", "clear"):
        was, mode = decode.png(files[k])
        got, now = decode.png(bytes(out[k].png))
        assert now == mode and out[k].error is None
        assert np.abs(got - was.repeat(2, 0).repeat(2, 1)).max() <= 0.5 / 255 + 1e-9
    assert out["bad"].png is None and out["bad"].error and out["none"].error
    assert decode.decode(df.limit(0), "name").count() == 0


def test_phase_bound(spark):
    px = picture(spark, [(4, 5)]).withColumnRenamed("r", "v")
    with pytest.raises(Exception, match="more than 50 pixels"):
        phase.enlarge(px, 2.0, keep_topology=False, max_pixels=50).collect()


def test_memory_guard_of_results(spark):
    px = picture(spark, [(10, 10)]).drop("a")
    opts = pipeline.Options(scale=4.0, detail=0.0)
    assert pipeline.enhance(px, opts, limit_bytes=40 * 40 * 12).count() == 1_600
    with pytest.raises(Exception, match="over the limit"):
        pipeline.enhance(px, opts, limit_bytes=40 * 40 * 12 - 1).collect()
