"""Filters over neighbouring pixels as window frames along rows and columns.

A frame along x needs the pixels of a row together, one along y those of a column. All columns that need means share
one window, and means along different axes can change places: all passes along one axis run before those along the
other, and the second half of a guided filter starts with the axis on which the first ended. A blur takes two exchanges and a
guided filter three, however many channels and passes there are; none where whole images lie together (by_image). Lines too
long for one task are cut into blocks (block=..., see scans), for an exchange a pass. Images that are rows of arrays (tilework.by_rows)
are filtered in their rows, by detail_enhance, unsharp, denoise and chroma_denoise: no sort and no exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.color import clip01, rgb_to_ycbcr, ycbcr_to_rgb
from rasterloom.functions.sizing import box_radius
from rasterloom.operators import kernels, scans, tilework


def by_image(df: DataFrame) -> DataFrame:
    """Deals out pixels by image, for relations of many small images: what follows then needs no exchange. Not for one large image."""
    return df.repartition("image_id")


def _box_axis(df: DataFrame, values: list[str], radius: int, along: str, across: str, size: str) -> DataFrame:
    """Means of 2r+1 samples along an axis; the first and last sample repeat beyond the edges; r is at most size - 1."""
    line = Window.partitionBy("image_id", across).orderBy(along)
    frame, whole = line.rowsBetween(-radius, radius), line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    r = F.least(F.lit(radius), F.col(size) - 1).cast("double")
    at, last = F.col(along).cast("double"), (F.col(size) - 1).cast("double")
    before, after = F.greatest(F.lit(0.0), r - at), F.greatest(F.lit(0.0), at + r - last)

    def mean(c: str) -> Column:
        return (F.sum(c).over(frame) + before * F.first(c).over(whole) + after * F.last(c).over(whole)) / (2 * r + 1)

    return df.withColumns({c: mean(c) for c in values})


def box_blur(df: DataFrame, values: list[str], radius: int, passes: int = 1, axes: str = "yx", block: int | None = None) -> DataFrame:
    """Mean over a square, passes times; a radius below 1 changes nothing. axes: the order of axes, which only moves exchanges.

    block: lines are cut into blocks of so many pixels, so that neither a long line nor a wide radius makes a large task.
    """
    for axis in axes if radius >= 1 else "":
        line = ("y", "x", "h") if axis == "y" else ("x", "y", "w")
        if block is not None:
            df = scans.box(df, values, radius, passes, *line, block)
            continue
        for _ in range(passes):
            df = _box_axis(df, values, radius, *line)
    return df


def gaussian_blur(df: DataFrame, values: list[str], sigma: float, block: int | None = None) -> DataFrame:
    """Three passes of a box; sigma at or below 0 changes nothing."""
    return box_blur(df, values, box_radius(sigma), 3, block=block) if sigma > 0 else df


def guided_filter(df: DataFrame, guides: list[str], sources: list[str], radius: int, eps: float, block: int | None = None) -> DataFrame:
    """Each source smoothed where its guide is flat; results replace the sources."""
    pairs = list(zip(guides, sources, strict=True))
    need = {}
    for i, (g, s) in enumerate(pairs):
        need |= {f"__i{i}": F.col(g), f"__p{i}": F.col(s), f"__ii{i}": F.col(g) * F.col(g), f"__ip{i}": F.col(g) * F.col(s)}
    df = box_blur(df.withColumns(need), list(need), radius, block=block)
    lines = {}
    for i, _ in enumerate(pairs):
        mi, mp = F.col(f"__i{i}"), F.col(f"__p{i}")
        a = (F.col(f"__ip{i}") - mi * mp) / (F.col(f"__ii{i}") - mi * mi + eps)
        lines |= {f"__a{i}": a, f"__b{i}": mp - a * mi}
    df = box_blur(df.withColumns(lines).drop(*need), list(lines), radius, axes="xy", block=block)
    return df.withColumns({s: F.col(f"__a{i}") * F.col(g) + F.col(f"__b{i}") for i, (g, s) in enumerate(pairs)}).drop(*lines)


def _self_guided(df: DataFrame, values: list[str], radius: int, eps: float) -> DataFrame:
    """Adds the smoothed columns as __base_*."""
    df = df.withColumns({f"__base_{c}": F.col(c) for c in values})
    return guided_filter(df, values, [f"__base_{c}" for c in values], radius, eps)


def detail_enhance(df: DataFrame, values: list[str], radius: int = 4, eps: float = 1e-3, strength: float = 0.35) -> DataFrame:
    """Enlarges what a guided filter takes away by strength; strength at or below 0 changes nothing."""
    if strength <= 0:
        return df
    if tilework.by_rows(df):
        return tilework.changed(df, values, lambda v: kernels.detail(v, radius, eps, strength))
    df = _self_guided(df, values, radius, eps)
    base = lambda c: F.col(f"__base_{c}")
    return df.withColumns({c: clip01(base(c) + (F.col(c) - base(c)) * (1 + strength)) for c in values}).drop(*(f"__base_{c}" for c in values))


def unsharp(df: DataFrame, values: list[str], amount: float, radius: float = 1.0, threshold: float = 0.004) -> DataFrame:
    """Adds the high-pass part, softly cut below threshold, times one and a half amounts."""
    if amount <= 0:
        return df
    if tilework.by_rows(df):
        return tilework.changed(df, values, lambda v: kernels.unsharp(v, amount, box_radius(radius) if radius > 0 else 0, threshold))
    df = gaussian_blur(df.withColumns({f"__low_{c}": F.col(c) for c in values}), [f"__low_{c}" for c in values], radius)

    def sharp(c: str) -> Column:
        high = F.col(c) - F.col(f"__low_{c}")
        if threshold > 0:
            high = high * clip01((F.abs(high) - threshold) / threshold)
        return clip01(F.col(c) + 1.5 * amount * high)

    return df.withColumns({c: sharp(c) for c in values}).drop(*(f"__low_{c}" for c in values))


def denoise(df: DataFrame, values: list[str], radius: float = 3.0, sigma: float = 0.04) -> DataFrame:
    r, eps = max(1, round(radius)), sigma * sigma + 1e-6
    if tilework.by_rows(df):
        return tilework.changed(df, values, lambda v: kernels.self_guided(v, r, eps).clip(0, 1))
    df = _self_guided(df, values, r, eps)
    return df.withColumns({c: clip01(F.col(f"__base_{c}")) for c in values}).drop(*(f"__base_{c}" for c in values))


def chroma_denoise(df: DataFrame, sigma: float = 2.0) -> DataFrame:
    """Blurs chroma and leaves luma."""
    if sigma <= 0:
        return df
    if tilework.by_rows(df):
        return tilework.changed(df, ["r", "g", "b"], lambda v: kernels.chroma_blur(v, box_radius(sigma)))
    out = ycbcr_to_rgb(gaussian_blur(rgb_to_ycbcr(df), ["cb", "cr"], sigma))
    return out.withColumns({c: clip01(F.col(c)) for c in ("r", "g", "b")})


def gradient(df: DataFrame, value: str) -> DataFrame:
    """Adds gx, gy (central differences, one-sided at edges) and their magnitude."""

    def along(axis: str, across: str, size: str) -> Column:
        line = Window.partitionBy("image_id", across).orderBy(axis)
        here, before, after = F.col(value), F.lag(value).over(line), F.lead(value).over(line)
        return F.when(F.col(size) == 1, F.lit(0.0)).when(F.col(axis) == 0, after - here).when(F.col(axis) == F.col(size) - 1, here - before).otherwise((after - before) / 2)

    df = df.withColumn("gy", along("y", "x", "h")).withColumn("gx", along("x", "y", "w"))
    return df.withColumn("magnitude", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))


def orient_smooth(df: DataFrame, value: str, theta: str, radius: int) -> DataFrame:
    """Mean of value over nearest-pixel steps -radius..radius along theta, clamped to the image, with Gaussian weights whose sigma is the radius."""
    steps = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    s = df.select("image_id", "h", "w", "y", "x", theta, steps.alias("step"))
    near = lambda at, size, d: F.greatest(F.lit(0), F.least(F.col(size) - 1, F.rint(F.col(at) + F.col("step") * d).cast("int")))
    s = s.select("image_id", "y", "x", F.col("step"), near("y", "h", F.sin(theta)).alias("ny"), near("x", "w", F.cos(theta)).alias("nx"))
    other = df.select("image_id", F.col("y").alias("ny"), F.col("x").alias("nx"), F.col(value).alias("__v"))
    weight = F.exp(-0.5 * F.col("step") * F.col("step") / max(radius * radius, 1e-6))
    m = s.join(other, ["image_id", "ny", "nx"]).groupBy("image_id", "y", "x").agg((F.sum(F.col("__v") * weight) / F.sum(weight)).alias("smooth"))
    return df.join(m, ["image_id", "y", "x"])
