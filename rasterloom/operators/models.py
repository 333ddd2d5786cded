"""Model backends: tiles of images go through a model inside tasks; a session is opened once for each task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import kernels, tilework, tiling

# Execution providers by their names, and the order in which auto tries them.
PROVIDERS = {
    "tensorrt": "TensorrtExecutionProvider",
    "trt": "TensorrtExecutionProvider",
    "cuda": "CUDAExecutionProvider",
    "gpu": "CUDAExecutionProvider",
    "dml": "DmlExecutionProvider",
    "directml": "DmlExecutionProvider",
    "rocm": "ROCMExecutionProvider",
    "coreml": "CoreMLExecutionProvider",
    "openvino": "OpenVINOExecutionProvider",
    "openvino-cpu": "OpenVINOExecutionProvider",
    "cpu": "CPUExecutionProvider",
}
AUTO = ["TensorrtExecutionProvider", "CUDAExecutionProvider", "DmlExecutionProvider", "ROCMExecutionProvider", "CoreMLExecutionProvider", "OpenVINOExecutionProvider", "CPUExecutionProvider"]

Process = Callable[[np.ndarray], np.ndarray]


def normalize_provider(name: str | None) -> str | None:
    """Canonical provider of an alias; auto and nothing are None."""
    if not name or name.lower() == "auto":
        return None
    if name.lower() in PROVIDERS:
        return PROVIDERS[name.lower()]
    if name in PROVIDERS.values():
        return name
    raise ValueError(f"unknown provider {name}")


def resolve_providers(name: str | None, installed: list[str]) -> list[str]:
    """The wanted provider if it is installed, or all known ones in the order of AUTO, with the CPU last."""
    one = normalize_provider(name)
    cpu = PROVIDERS["cpu"]
    if one and one not in installed:
        raise ValueError(f"{one} isn't installed")
    first = [one] if one else [p for p in AUTO if p in installed]
    return [*(p for p in first if p != cpu), cpu]


def to_input(tile: np.ndarray, align: int = 1) -> np.ndarray:
    """h x w x 3 to 1 x 3 x H x W, mirrored up to multiples of align."""
    h, w, _ = tile.shape
    ph, pw = -h % align, -w % align
    mode = "reflect" if h > ph and w > pw else "edge"
    return np.pad(tile, ((0, ph), (0, pw), (0, 0)), mode=mode).transpose(2, 0, 1)[None].astype(np.float32)


def from_output(raw: np.ndarray, h: int, w: int) -> np.ndarray:
    """1 x 3 x H x W to h x w x 3 in 0..1; outputs in 0..255 or -1..1 are recognised by their extremes."""
    x = raw[0].transpose(1, 2, 0)[:h, :w].astype(np.float64)
    if x.max(initial=0) > 1.5:
        x = x / 255
    elif x.min(initial=0) < -0.05:
        x = (x + 1) / 2
    return np.clip(x, 0, 1)


def range_rule(low: Column, high: Column) -> Column:
    """The rule of from_output as a column: bytes, signed or unit."""
    return F.when(high > 1.5, "bytes").when(low < -0.05, "signed").otherwise("unit")


def onnx_session(path: str, provider: str | None = None, threads: int = 1) -> Process:
    """A function that runs an ONNX model of one image input on tiles."""
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = threads
    session = onnxruntime.InferenceSession(path, options, providers=resolve_providers(provider, onnxruntime.get_available_providers()))
    name = session.get_inputs()[0].name
    return lambda x: session.run(None, {name: x})[0]


def _feather(start: int, end: int, total: int, overlap: int) -> np.ndarray:
    """The weights of a tile along one axis, as tiling.feather has them."""
    n = min(overlap, (end - start) // 2)
    w = np.ones(end - start)
    if n > 1:
        rise = 0.5 - 0.5 * np.cos(np.pi * (np.arange(n) + 0.5) / n)
        if start > 0:
            w[:n] *= rise
        if end < total:
            w[-n:] *= rise[::-1]
    return w


def _ranges(lo: int, hi: int, tile: int, overlap: int) -> list[tuple[int, int]]:
    """Windows of a tile's side that cover lo to hi; the last is moved back."""
    if hi - lo <= tile:
        return [(lo, hi)]
    ends = [min(lo + k + tile, hi) for k in range(0, hi - lo, max(1, tile - 2 * overlap))]
    return [(e - tile, e) for e in dict.fromkeys(ends)]


def tile_parts(process: Process, v: np.ndarray, part: kernels.Part, h: int, w: int, scale: int, overlap: int, align: int = 1, least: int = 64) -> Iterator[tuple[kernels.Part, np.ndarray]]:
    """(part of the output, its channels times weights, and the weights) of a tile (3, h, w) of an h x w image through a model.

    A tile for which there isn't the memory is cut into overlapping ones of half the side, down to least; only this tile is done again.
    """
    y0, y1, x0, x1 = part
    try:
        out = from_output(process(to_input(v.transpose(1, 2, 0), align)), (y1 - y0) * scale, (x1 - x0) * scale)
    except MemoryError:
        side = max(y1 - y0, x1 - x0) // 2
        if side < least:
            raise
        less = min(overlap, max(4, side // 32), side // 2)
        for a0, a1 in _ranges(y0, y1, side, less):
            for b0, b1 in _ranges(x0, x1, side, less):
                yield from tile_parts(process, v[:, a0 - y0 : a1 - y0, b0 - x0 : b1 - x0], (a0, a1, b0, b1), h, w, scale, less, align, least)
        return
    if out.shape[:2] != ((y1 - y0) * scale, (x1 - x0) * scale):
        raise ValueError(f"the model returned {out.shape} for a tile of {y1 - y0} x {x1 - x0} at scale {scale}")
    weight = _feather(y0 * scale, y1 * scale, h * scale, overlap * scale)[:, None] * _feather(x0 * scale, x1 * scale, w * scale, overlap * scale)
    yield (y0 * scale, y1 * scale, x0 * scale, x1 * scale), np.concatenate([out.transpose(2, 0, 1) * weight, weight[None]])


def on_tiles(px: DataFrame, opener: Callable[[], Process], scale: int, tile: int, overlap: int, pad: int, align: int = 1, keys: list[str] = [], least: int = 64) -> DataFrame:  # noqa: B006
    """px (image_id, h, w, y, x, r, g, b, keys) enlarged scale times by a model, in tiles; keys are the same for all pixels of an image.

    Images with a side over tile are mirrored by pad pixels at their edges, cut into tiles that overlap, and what the tiles say of a pixel is
    averaged by their weights, summed before the shuffle. opener is called once for each task.
    """
    rgb, held = ["r", "g", "b"], ["__h0", "__w0", "__p0"]
    large = tiling.should_tile(F.col("h"), F.col("w"), F.lit(tile))
    p = F.when(large, F.least(F.lit(pad), F.greatest(F.lit(1), F.least("h", "w") - 1))).otherwise(0)
    d = px.withColumns({"__h0": F.col("h"), "__w0": F.col("w"), "__p0": p})
    cut = tiling.cut_fixed(tiling.reflect_pad(d, F.col("__p0")), tile, overlap).withColumn("wt", F.lit(1.0))
    opened: list[Process] = []

    def work(v: np.ndarray, part: kernels.Part, own: tuple) -> Iterator[tuple[kernels.Part, np.ndarray, int, int]]:
        if not opened:
            opened.append(opener())
        h, w = own[:2]
        for i in range(v.shape[1]):
            for to, out in tile_parts(opened[0], v[:3, i], part, h, w, scale, overlap, align, least):
                yield to, i, out[:, None], h * scale, w * scale

    out = tilework.worked(cut, [*rgb, "wt"], [*held, *keys], work, [*held, *keys], one_by_one=True)
    d = out.groupBy("image_id", "y", "x", *held, *keys).agg(*(F.sum(c).alias(c) for c in (*rgb, "wt")))
    at = lambda c: (F.col(c) - F.col("__p0") * scale).cast("int")
    d = d.select("image_id", (F.col("__h0") * scale).alias("h"), (F.col("__w0") * scale).alias("w"), at("y").alias("y"), at("x").alias("x"), *((F.col(c) / F.greatest("wt", F.lit(1e-6))).alias(c) for c in rgb), *keys)
    return d.where((F.col("y") >= 0) & (F.col("y") < F.col("h")) & (F.col("x") >= 0) & (F.col("x") < F.col("w")))


def catalogue(spark) -> DataFrame:
    """The known models: names, kinds and shapes. Files are looked for by join with a listing, see presence."""
    rows = [("x4plus", "rrdb", 4, 23), ("x4plus-anime", "rrdb", 4, 6), ("general-x4v3", "srvgg", 4, 32), ("general-wdn-x4v3", "srvgg", 4, 32), ("animevideov3", "srvgg", 4, 16)]
    return spark.createDataFrame(rows, "name string, arch string, scale int, depth int")


def presence(models: DataFrame, files: DataFrame) -> DataFrame:
    """Adds onnx and weights: the file (path) of each model, name.onnx before name_fp16.onnx, or null."""
    base = F.regexp_extract("path", r"([^/]+)$", 1)
    f = files.select(base.alias("file"), "path").dropDuplicates(["file"])

    def of(suffix: str) -> DataFrame:
        return f.where(F.col("file").endswith(suffix)).select(F.expr(f"substring(file, 1, length(file) - {len(suffix)})").alias("name"), F.col("path").alias(suffix))

    d = models
    for s in ("_fp16.onnx", ".onnx", ".pth"):
        d = d.join(of(s), "name", "left")
    return d.select(*models.columns, F.coalesce(F.col("`.onnx`"), F.col("`_fp16.onnx`")).alias("onnx"), F.col("`.pth`").alias("weights"))


def checksums(files: DataFrame) -> DataFrame:
    """(path, sha256) of files with their content, as Spark's binaryFile source lists them (it leaves empty files out)."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def disk_usage(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
