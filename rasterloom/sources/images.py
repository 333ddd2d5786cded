"""Image files as relations: listing, header probes, decoding to pixels and encoding back.

Spark's binaryFile and image readers do the I/O; PNG is encoded here, other formats as far as the JVM decodes them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators import tilework

# Extensions and aliases of formats.
FORMATS = {"jpg": "JPEG", "jpeg": "JPEG", "jpe": "JPEG", "png": "PNG", "webp": "WEBP", "tif": "TIFF", "tiff": "TIFF", "bmp": "BMP", "avif": "AVIF"}
SAVE = {"JPEG": {"quality": "q", "subsampling": "0"}, "PNG": {"compress_level": "6"}, "WEBP": {"quality": "q", "method": "4"}, "TIFF": {"compression": "deflate"}, "AVIF": {"quality": "q"}}


def normalize_format(name: Column, fallback: str = "PNG") -> Column:
    """Canonical format of an extension or alias; unknown ones in upper case, empty ones the fallback."""
    key = F.lower(F.ltrim(F.trim(name), F.lit(".")))
    table = F.create_map(*(F.lit(x) for kv in FORMATS.items() for x in kv))
    return F.when(F.coalesce(key, F.lit("")) == "", fallback).otherwise(F.coalesce(F.try_element_at(table, key), F.upper(key)))


def save_options(fmt: Column, quality: int = 95) -> Column:
    """map<string, string> of encoder options by format."""
    out = F.create_map().cast("map<string,string>")
    for name, opts in SAVE.items():
        m = F.create_map(*(F.lit(str(quality) if x == "q" else x) for kv in opts.items() for x in kv))
        out = F.when(fmt == name, m).otherwise(out)
    return out


def list_files(spark: SparkSession, paths: list[str], extensions: tuple[str, ...] = tuple(FORMATS), recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length) of image files under paths (files, folders, globs), each once."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(paths).select("path", "modificationTime", "length")
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return d.where(ext.isin(*extensions)).dropDuplicates(["path"])


def probe(files: DataFrame) -> DataFrame:
    """width, height, mode, format and error of files (path, content) from their headers alone, by column expressions."""
    c = F.col("content")
    number = lambda at, n: F.conv(F.hex(F.substring(c, at, n)), 16, 10).cast("int")
    little = lambda at: F.conv(F.concat(*(F.hex(F.substring(c, at + i, 1)) for i in (3, 2, 1, 0))), 16, 10).cast("int")
    start = F.hex(F.substring(c, 1, 8))
    png, bmp, gif = start == "89504E470D0A1A0A", start.startswith("424D"), start.startswith("474946383")
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}.items() for x in kv)), number(26, 1))
    fmt = F.when(png, "PNG").when(bmp, "BMP").when(gif, "GIF").when(start.startswith("FFD8FF"), "JPEG")
    two = lambda at: F.conv(F.concat(F.hex(F.substring(c, at + 1, 1)), F.hex(F.substring(c, at, 1))), 16, 10).cast("int")
    return files.select(
        *(x for x in files.columns if x != "content"),
        fmt.alias("format"),
        F.when(png, number(17, 4)).when(bmp, little(19)).when(gif, two(7)).alias("width"),
        F.when(png, number(21, 4)).when(bmp, F.abs(little(23))).when(gif, two(9)).alias("height"),
        F.when(png, kind).alias("mode"),
        F.when(png, number(26, 1).isin(4, 6)).alias("has_alpha"),
        F.when(fmt.isNull(), "not an image that can be read").alias("error"),
    )


def plain_path(path: Column | str) -> Column:
    """A path without the ways in which readers spell a local one."""
    return F.regexp_replace(path, "^file:/+", "/")


def load(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Pixels (image_id, path, h, w, y, x, r, g, b, a) of image files; a is null without an alpha channel.

    The JVM decodes to rows of bytes in the order blue, green, red[, alpha]. image_id is a hash of the path. Files that
    can't be decoded give no rows; probe tells which.
    """
    d = spark.read.format("image").option("dropInvalid", True).load(paths).select("image.*")
    d = d.select(F.xxhash64(plain_path("origin")).alias("image_id"), plain_path("origin").alias("path"), F.col("height").alias("h"), F.col("width").alias("w"), F.col("nChannels").alias("n"), "data")
    d = d.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1)))
    d = d.withColumn("line", F.hex(F.substring("data", F.col("y") * F.col("w") * F.col("n") + 1, F.col("w") * F.col("n")))).drop("data")
    d = d.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    at = lambda k: F.conv(F.substring("line", (F.col("x") * F.col("n") + k) * 2 + 1, F.lit(2)), 16, 10).cast("int") / 255.0
    grey = F.col("n") == 1
    return d.select("image_id", "path", "h", "w", "y", "x", F.when(grey, at(0)).otherwise(at(2)).alias("r"), F.when(grey, at(0)).otherwise(at(1)).alias("g"), at(0).alias("b"), F.when(F.col("n") == 4, at(3)).alias("a"))


def _png(pixels: np.ndarray) -> bytes:
    h, w, n = pixels.shape
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[n]
    chunk = lambda t, b: struct.pack(">I", len(b)) + t + b + struct.pack(">I", zlib.crc32(t + b))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, w * n)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def encode_png(px: DataFrame, gray: bool = False) -> DataFrame:
    """(image_id, png): one file for each image of px (h, w, y, x, r, g, b[, a]); values are rounded to 8 bits.

    The bytes of an image meet in one task, as its file needs them; gray keeps one colour channel. Images that are rows of arrays are coded in their rows.
    """
    channels = (["r"] if gray else ["r", "g", "b"]) + (["a"] if "a" in px.columns else [])
    kind = f"image_id {px.schema['image_id'].dataType.simpleString()}, png binary"
    if tilework.by_rows(px):

        def coded(ids: pa.Array, v: np.ndarray) -> pa.RecordBatch:
            levels = np.floor(np.clip(v * 255.0 + 0.5, 0, 255)).astype(np.uint8).transpose(1, 2, 3, 0)
            return pa.RecordBatch.from_arrays([ids, pa.array([_png(one) for one in levels], pa.binary())], names=["image_id", "png"])

        return tilework.of_rows(px, channels, coded, kind)
    u8 = [F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col(c) * 255.0 + 0.5))).cast("int").alias(c) for c in channels]

    def one(p: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((int(p.h.iloc[0]), int(p.w.iloc[0]), len(channels)), np.uint8)
        out[p.y, p.x] = p[channels].to_numpy(np.uint8)
        return pd.DataFrame({"image_id": [p.image_id.iloc[0]], "png": [_png(out)]})

    return px.select("image_id", "h", "w", "y", "x", *u8).groupBy("image_id").applyInPandas(one, kind)


def save_files(files: DataFrame, folder: str, name: str = "image_id", content: str = "png", extension: str = ".png") -> DataFrame:
    """(name) of each row whose bytes were written to folder (a shared one) under its name: first to a temporary name, then moved,
    so that no file is ever half there. Files are written when the result is read, and again if it is read again."""

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        for p in batches:
            for n, c in zip(p["name"], p["content"], strict=True):
                path = os.path.join(folder, f"{n}{extension}")
                part = f"{path}.{os.getpid()}.part"
                try:
                    with open(part, "wb") as f:
                        f.write(c)
                    os.replace(part, path)
                finally:
                    if os.path.exists(part):
                        os.remove(part)
            yield p[["name"]]

    return files.select(F.col(name).cast("string").alias("name"), F.col(content).alias("content")).mapInPandas(save, "name string")


def write_files(files: DataFrame, folder: str, name: str = "image_id", content: str = "png", extension: str = ".png") -> int:
    """Writes as save_files does, in one pass; returns how many."""
    return save_files(files, folder, name, content, extension).count()


def outputs(inputs: DataFrame, suffix: str = "_upscaled", extension: str | None = None) -> DataFrame:
    """Adds target, the output name of path: stem, suffix and extension (the input's own by default)."""
    stem, ext = F.regexp_extract("path", r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract("path", r"^(.*?)(\.[^./]*)?$", 2)
    return inputs.withColumn("target", F.concat(stem, F.lit(suffix), F.lit(extension) if extension else F.when(ext == "", ".png").otherwise(ext)))


def pending(inputs: DataFrame, existing: DataFrame) -> DataFrame:
    """Those of inputs (target) whose target isn't in existing (path)."""
    e = existing.select(F.col("path").alias("target")).distinct()
    return inputs.join(e, "target", "left_anti")


def batch_plan(inputs: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds status: skipped if the target is there, else pending."""
    e = existing.select(F.col("path").alias("target")).distinct().withColumn("__there", F.lit(True))
    return inputs.join(e, "target", "left").withColumn("status", F.when(F.col("__there"), "skipped").otherwise("pending")).drop("__there")
