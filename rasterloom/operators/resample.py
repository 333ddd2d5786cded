"""Resampling without joins: each source pixel is sent to the output pixels that it weighs in, and weights are summed.

The sizes are columns, so images of different sizes go through one plan, and partial sums are formed before the shuffle. Where all
images grow by the same scale, enlarge gives the same values from tiles as arrays, which costs a fraction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.color import clip01
from rasterloom.operators import kernels, tilework

RADIUS = 3.0
#: Output pixels along a side of a block, and bytes of input files for which there is a partition of blocks.
BLOCK, FILE_BYTES = 128, 128 << 10


def lanczos(d: Column, a: float = RADIUS) -> Column:
    """sinc(d) sinc(d / a) for |d| < a, else 0."""
    x = F.lit(math.pi) * d
    near = F.abs(d) < 1e-12
    safe = F.when(near, F.lit(1.0)).otherwise(x)
    return F.when(F.abs(d) >= a, 0.0).when(near, 1.0).otherwise(F.sin(safe) / safe * F.sin(safe / a) / (safe / a))


def lanczos_taps(spark, n_in: int, n_out: int, a: float = RADIUS) -> DataFrame:
    """(o, i, w): weights of the inputs i of each output o, summing to 1."""
    s = n_in / n_out
    t = spark.range(n_out).select(F.col("id").cast("int").alias("o")).withColumn("c", (F.col("o") + 0.5) * s - 0.5)
    t = t.withColumn("i", F.explode(F.sequence(F.greatest(F.lit(0), F.floor(F.col("c") - a).cast("int")), F.least(F.lit(n_in - 1), F.ceil(F.col("c") + a).cast("int")))))
    t = t.withColumn("w", lanczos(F.col("c") - F.col("i"), a)).where(F.abs(F.col("c") - F.col("i")) < a)
    total = t.groupBy("o").agg(F.sum("w").alias("total"))
    return t.join(F.broadcast(total), "o").select("o", "i", (F.col("w") / F.greatest(F.col("total"), F.lit(1e-8))).alias("w"))


def _reached(at: str, size: str, out: str, a: float, stretch: bool) -> tuple[Column, Column, Column, Column]:
    """The first and last output that a pixel may weigh in, pixels for each output, and how far the kernel is stretched."""
    s = F.col(size) / F.col(out).cast("double")
    k = F.greatest(F.lit(1.0), s) if stretch else F.lit(1.0)
    i = F.col(at).cast("double")
    low = F.greatest(F.lit(0), F.floor((i - a * k + 0.5) / s - 0.5).cast("int"))
    high = F.least(F.col(out) - 1, F.ceil((i + a * k + 0.5) / s - 0.5).cast("int"))
    return low, high, s, k


def _side(size: str, out: str) -> Column:
    """Outputs along a block, so that they and the pixels that they lie over are BLOCK at most."""
    return F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK) * F.col(out) / F.col(size)).cast("int")))


def _in_blocks(df: DataFrame, a: float) -> DataFrame:
    """Pixels sent to the blocks of outputs (__ty, __tx) that they weigh in: both axes are then summed where they lie.

    The number of partitions grows with the files that df is read from, so that the sums of one task don't.
    """
    for at, size, out, block in (("y", "h", "__oh", "__ty"), ("x", "w", "__ow", "__tx")):
        low, high, _, _ = _reached(at, size, out, a, False)
        n = _side(size, out)
        df = df.where(low <= high).withColumn(block, F.explode(F.sequence(F.floor(low / n).cast("int"), F.floor(high / n).cast("int"))))
    spark = df.sparkSession
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in set(df.inputFiles())]
    read = sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in paths)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-read // FILE_BYTES))
    # A column of its own, as an image_id that is a literal would be left out of the sums' keys but not of those here.
    return df.withColumn("__tb", F.xxhash64("image_id", "__ty", "__tx")).repartition(n, "__tb")


def _axis(df: DataFrame, values: list[str], at: str, size: str, out: str, a: float, stretch: bool) -> DataFrame:
    """One axis: at and size (pixels along it) become those of the column out."""
    low, high, s, k = _reached(at, size, out, a, stretch)
    if (block := f"__t{at}") in df.columns:
        n = _side(size, out)
        low, high = F.greatest(low, F.col(block) * n), F.least(high, (F.col(block) + 1) * n - 1)
    # Other columns than the place, the sizes and the values don't survive: they have no meaning between pixels.
    rest = [c for c in df.columns if (c in ("image_id", "h", "w", "y", "x") or c.startswith("__")) and c not in (*values, at, size)]
    d = df.where(low <= high).withColumn("__o", F.explode(F.sequence(low, high)))
    dist = ((F.col("__o") + 0.5) * s - 0.5 - F.col(at).cast("double")) / k
    d = d.withColumn("__w", lanczos(dist, a)).where(F.abs(dist) < a)
    d = d.groupBy(*rest, "__o").agg(*(F.sum(F.col(c) * F.col("__w")).alias(c) for c in values), F.sum("__w").alias("__t"))
    return d.select(*rest, F.col("__o").alias(at), F.col(out).alias(size), *((F.col(c) / F.greatest(F.col("__t"), F.lit(1e-8))).alias(c) for c in values))


def resize(df: DataFrame, values: list[str], out_w: Column, out_h: Column, a: float = RADIUS, antialias: bool = False) -> DataFrame:
    """Lanczos to out_w x out_h, height first. By default the kernel isn't stretched when an image shrinks; antialias stretches it.

    A stretched kernel weighs any number of pixels, so there sums are formed before the shuffle instead of in blocks.
    """
    d = df.withColumns({"__ow": out_w.cast("int"), "__oh": out_h.cast("int")})
    if not antialias:
        d = _in_blocks(d, a)
    d = _axis(d, values, "y", "h", "__oh", a, antialias)
    d = _axis(d, values, "x", "w", "__ow", a, antialias)
    return d.drop("__ow", "__oh", "__ty", "__tx", "__tb")


def steps_for(ratio: float, most: float = 2.0) -> int:
    """How many steps of at most `most` times an enlargement takes."""
    n = 1
    while ratio > most + 1e-6:
        ratio /= most
        n += 1
    return n


def resize_to(df: DataFrame, values: list[str], out_w: Column, out_h: Column, ratio: float, most: float = 2.0) -> DataFrame:
    """To out_w x out_h by steps of at most `most` times; ratio is the greatest enlargement of any image."""
    d = df.withColumns({"__tw": out_w, "__th": out_h})
    for k in range(steps_for(ratio, most), 0, -1):
        far = F.greatest(F.col("__tw") / F.col("w"), F.col("__th") / F.col("h")) > most + 1e-6
        step = lambda size, to: F.when(far, F.least(F.col(to), F.greatest(F.col(size) + 1, F.ceil(F.col(size) * most).cast("int")))).otherwise(F.col(to))
        d = resize(d, values, step("w", "__tw") if k > 1 else F.col("__tw"), step("h", "__th") if k > 1 else F.col("__th"))
    return d.drop("__tw", "__th")


def enlarge(df: DataFrame, values: list[str], scale: float, tile: int = 512) -> DataFrame:
    """(image_id, h, w, y, x, values): what resize_chained gives, on tiles with a margin as arrays: each pixel is shuffled once, whatever the steps."""
    size = lambda n: max(1, int(np.rint(n * scale)))
    side = max(kernels.LEAST, min(tile, int(kernels.MOST**0.5 / max(1.0, scale))))
    margin = math.ceil(4 * (steps_for(scale) + 2) / min(1.0, scale))

    def work(v: np.ndarray, part: kernels.Part, own: tuple) -> Iterator[tuple[kernels.Part, np.ndarray, int, int]]:
        h, w, ty, tx = own
        to_h, to_w = size(h), size(w)
        want = (*kernels.core(ty, side, h, to_h), *kernels.core(tx, side, w, to_w))
        if want[0] < want[1] and want[2] < want[3]:
            for to, out in kernels.worked(v, part, kernels.resizes(h, w, to_h, to_w), want):
                yield to, out, to_h, to_w

    return tilework.worked(tilework.cut_with_margin(df, F.lit(side), F.lit(margin)), values, [], work)


def resize_chained(df: DataFrame, values: list[str], scale: float, most: float = 2.0) -> DataFrame:
    """Enlarges by steps of at most `most` times. The target is the rounded size times scale. Images that are rows of arrays stay in their rows."""
    if tilework.by_rows(df):
        side = lambda n: max(1, int(np.rint(n * scale)))

        def change(v: np.ndarray) -> np.ndarray:
            h, w = v.shape[-2:]
            part = (0, h, 0, w)
            for s in kernels.resizes(h, w, side(h), side(w), most):
                v, part = s.run(v, part, (0, s.to_h, 0, s.to_w)), (0, s.to_h, 0, s.to_w)
            return v

        return tilework.changed(df, values, change, most=max(1, int(tilework.STACK / max(1.0, scale) ** 2)))
    size = lambda c: F.greatest(F.lit(1), F.rint(F.col(c) * scale).cast("int"))
    return resize_to(df, values, size("w"), size("h"), scale, most)


def nearest(df: DataFrame, out_w: Column, out_h: Column) -> DataFrame:
    """Output pixel o takes input min(o * n div n_out, n - 1): each pixel is repeated where it stands, without a shuffle."""
    d = df.withColumns({"__ow": out_w.cast("int"), "__oh": out_h.cast("int")})
    for at, size, out in (("y", "h", "__oh"), ("x", "w", "__ow")):
        first = lambda i: F.ceil(i * F.col(out).cast("double") / F.col(size)).cast("int")
        low, high = first(F.col(at)), first(F.col(at) + 1) - 1
        d = d.where(low <= high).withColumn(at, F.explode(F.sequence(low, high))).withColumn(size, F.col(out))
    return d.drop("__ow", "__oh")


def resize_alpha(df: DataFrame, value: str, scale: float, mode: str = "lanczos") -> DataFrame:
    """Alpha by nearest or Lanczos, clipped."""
    if mode == "nearest":
        return nearest(df, F.rint(F.col("w") * scale), F.rint(F.col("h") * scale))
    if tilework.by_rows(df):
        return resize_chained(df, [value], scale).withColumn(value, F.transform(value, clip01))
    return resize_chained(df, [value], scale).withColumn(value, clip01(F.col(value)))
