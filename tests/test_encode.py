import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.sources import decode, encode, headers

from .test_pipeline_fitted import picture


def smooth(spark, sizes):
    """Images without hard edges: ramps and waves."""
    rows = [(i, h, w, y, x, x / max(1, w - 1), 0.5 + 0.4 * float(np.sin((x * y) / 90.0)), y / max(1, h - 1), (x + y) / (h + w)) for i, (h, w) in enumerate(sizes) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id long, h int, w int, y int, x int, r double, g double, b double, a double")


def arrays(px, channels):
    p = px.toPandas()
    out = {}
    for i, g in p.groupby("image_id"):
        v = np.zeros((int(g.h.iloc[0]), int(g.w.iloc[0]), len(channels)))
        v[g.y, g.x] = g[channels].to_numpy()
        out[i] = np.floor(v * 255 + 0.5)
    return out


def by_jvm(spark, files, folder, extension):
    """The images as Spark's own reader decodes them."""
    folder.mkdir()
    for r in files.collect():
        assert r.error is None
        (folder / f"{r.image_id}.{extension}").write_bytes(bytes(r.content))
    out = {}
    for r in spark.read.format("image").load(str(folder)).select("image.*").collect():
        v = np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, r.nChannels).astype(float)
        out[int(r.origin.rsplit("/", 1)[1].split(".")[0])] = v[..., [2, 1, 0, 3][: r.nChannels]] if r.nChannels > 2 else v
    return out


SIZES = [(1, 1), (8, 8), (9, 23), (40, 17), (70, 33)]


@pytest.mark.parametrize("strip", [64, 1 << 18])
def test_lossless(spark, tmp_path, strip):
    px = picture(spark, SIZES)
    want = arrays(px, ["r", "g", "b", "a"])
    for fmt, ext in (("PNG", "png"), ("TIFF", "tif")):
        got = by_jvm(spark, encode.encode(px, fmt, strip=strip), tmp_path / ext, ext)
        assert all((got[i] == want[i]).all() for i in want) and len(got) == len(want)
        plain = by_jvm(spark, encode.encode(px.drop("a"), fmt, strip=strip), tmp_path / f"{ext}3", ext)
        assert all((plain[i] == want[i][..., :3]).all() for i in want)
    grey = encode.encode(px, "PNG", gray=True, strip=strip)
    for r in grey.collect():
        v, mode = decode.png(bytes(r.content))
        assert mode == "LA"
        p = px.where(F.col("image_id") == r.image_id).toPandas()
        lum = 0.299 * p.r + 0.587 * p.g + 0.114 * p.b
        assert np.abs(v[p.y, p.x, 0] - lum).max() <= 0.5 / 255 + 1e-9


@pytest.mark.parametrize("strip", [64, 1 << 18])
def test_jpeg(spark, tmp_path, strip):
    px = smooth(spark, SIZES)
    want = arrays(px, ["r", "g", "b"])
    size = {}
    for quality in (100, 95, 50):
        # A frequency is off by half a step at most, and the transform keeps sums of squares; one more for the rounding of colours.
        bound = np.array([np.sqrt((encode.steps(t, quality) ** 2.0).mean()) / 2 + 1 for t in (encode.LUMA_STEPS, encode.CHROMA_STEPS, encode.CHROMA_STEPS)])
        files = encode.encode(px, "JPEG", quality, strip=strip)
        size[quality] = files.agg(F.sum(F.length("content"))).first()[0]
        got = by_jvm(spark, files, tmp_path / str(quality), "jpg")
        assert set(got) == set(want)
        for i in want:
            off = (got[i] - want[i]) @ encode.TO_YCC.T
            assert got[i].shape == want[i].shape and (np.sqrt((off**2).mean(axis=(0, 1))) <= bound).all(), (quality, i, off)
    assert size[50] < size[95] < size[100]
    # Noise: long codes, stuffed bytes, runs of zeros.
    noise = picture(spark, [(64, 50)])
    got = by_jvm(spark, encode.encode(noise, "JPEG", 100, strip=strip), tmp_path / "noise", "jpg")
    assert np.sqrt(((got[0] - arrays(noise, ["r", "g", "b"])[0]) ** 2).mean()) <= 1.5
    grey = by_jvm(spark, encode.encode(px, "JPEG", gray=True, strip=strip), tmp_path / "grey", "jpg")
    lum = {i: v @ [0.299, 0.587, 0.114] for i, v in want.items()}
    bound = np.sqrt((encode.steps(encode.LUMA_STEPS, 95) ** 2.0).mean()) / 2 + 1
    assert all(v.shape[2] == 1 and np.sqrt(((v[..., 0] - lum[i]) ** 2).mean()) <= bound for i, v in grey.items())


def test_entropy_code_of_rare_blocks():
    """Blocks with long runs, a last value that isn't zero, and the greatest sizes, read back bit by bit."""
    z = np.zeros((4, 1, 64), np.int64)
    z[0, 0, [0, 63]] = 1000, -1
    z[1, 0, [0, 17, 50]] = -1000, 1023, -1023
    z[3, 0, :] = np.arange(64) - 32
    data = encode._entropy(z).replace(b"\xff\x00", b"\xff")
    bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
    at = 0

    def symbol(kind):
        nonlocal at
        _, codes, lengths = encode.huffman(kind)
        known = {(int(n), int(c)): s for s, (c, n) in enumerate(zip(codes, lengths, strict=True)) if n}
        code = n = 0
        while (n, code) not in known:
            code, n, at = code << 1 | bits[at], n + 1, at + 1
            assert n <= 16
        return known[n, code]

    def value(n):
        nonlocal at
        v = int("".join(map(str, bits[at : at + n])) or "0", 2)
        at += n
        return v if n == 0 or v >> (n - 1) else v - (1 << n) + 1

    before = 0
    for block in z[:, 0]:
        got = [before := before + value(symbol("first"))]
        while len(got) < 64:
            s = symbol("others")
            if s == 0:
                got += [0] * (64 - len(got))
            else:
                got += [0] * (s >> 4)
                got.append(value(s & 15))
        assert got == block.tolist()
    assert len(bits) - at < 8 and all(bits[at:])


def test_codes_are_prefix_codes():
    for kind in ("first", "others"):
        table, codes, lengths = encode.huffman(kind)
        used = [(int(n), int(c)) for c, n in zip(codes, lengths, strict=True) if n]
        assert len(used) == sum(table[:16]) == len(table) - 16 == len(set(used)) and max(n for n, _ in used) <= 16
        words = sorted(f"{c:0{n}b}" for n, c in used)
        assert not any(b.startswith(a) for a, b in zip(words, words[1:])) and not any(set(x) == {"1"} for x in words)


def test_checksums_join():
    parts = [bytes(range(256)) * 300, b"", b"\xff" * 70_000, b"x"]
    assert encode.joined_checksum([(zlib.adler32(p), len(p)) for p in parts]) == zlib.adler32(b"".join(parts))


def test_profiles_errors_and_empty_tables(spark):
    px = smooth(spark, [(9, 10), (4, 4)])
    icc, exif = bytes(range(256)) * 600, b"II*\0" + struct.pack("<IHI", 8, 0, 0)
    meta = spark.createDataFrame([(0, icc, exif), (7, b"x", None)], "image_id long, icc binary, exif binary")
    for fmt in ("PNG", "JPEG", "TIFF"):
        files = encode.encode(px, fmt, meta=meta, strip=64)
        found = {r.image_id: r for r in headers.headers(files.select("image_id", "content")).collect()}
        assert (found[0].format, found[0].width, found[0].height, found[0].icc_bytes) == (fmt, 10, 9, len(icc))
        content = {r.image_id: bytes(r.content) for r in files.collect()}
        assert set(content) == {0, 1}
        assert (exif in content[0]) == (fmt != "TIFF") and exif not in content[1]
        if fmt == "TIFF":
            assert icc in content[0]
    long_ = spark.createDataFrame([(0, 1, 70_000, 0, 0, 0.5, 0.5, 0.5)], "image_id long, h int, w int, y int, x int, r double, g double, b double")
    row = encode.encode(long_, "JPEG").first()
    assert row.content is None and "65,535" in row.error
    gap = px.where("image_id = 0 and y < 8")
    assert encode.encode(gap, "TIFF", strip=64).first().error == "lines are missing"
    nulls = px.where("image_id = 1").withColumn("r", F.lit(None).cast("double"))
    v, _ = decode.png(bytes(encode.encode(nulls).first().content))
    assert (v[..., 0] == 0).all()
    assert encode.encode(px.limit(0), "JPEG").count() == 0
    with pytest.raises(ValueError):
        encode.encode(px, "WEBP")
