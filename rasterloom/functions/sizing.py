"""Sizes of images and tiles: scalar column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _whole(v: Column) -> Column:
    """Rounded half to even, at least 1."""
    return F.greatest(F.lit(1), F.rint(v).cast("int"))


def resolve_target(src_w: Column, src_h: Column, scale: Column, width: Column, height: Column, longest: Column, keep: Column) -> Column:
    """struct<w, h>: width and height, else width, else height, else the longest side, else scale (4 if null)."""
    sw, sh = src_w.cast("double"), src_h.cast("double")
    by = lambda f: F.struct(_whole(sw * f).alias("w"), _whole(sh * f).alias("h"))
    both = F.struct(F.greatest(F.lit(1), width).alias("w"), F.greatest(F.lit(1), height).alias("h"))
    by_w = F.struct(F.greatest(F.lit(1), width).alias("w"), F.when(keep, _whole(sh * width / sw)).otherwise(src_h).alias("h"))
    by_h = F.struct(F.when(keep, _whole(sw * height / sh)).otherwise(src_w).alias("w"), F.greatest(F.lit(1), height).alias("h"))
    long_ = by(longest / F.greatest(sw, sh))
    return F.when(width.isNotNull() & height.isNotNull(), both).when(width.isNotNull(), by_w).when(height.isNotNull(), by_h).when(longest.isNotNull(), long_).otherwise(by(F.coalesce(scale, F.lit(4.0))))


def fit_within(w: Column, h: Column, budget: Column) -> Column:
    """struct<w, h>: shrunk by the root of budget over pixels where there are more pixels than the budget."""
    f = F.sqrt(budget.cast("double") / (w.cast("double") * h.cast("double")))
    fits = w.cast("long") * h.cast("long") <= budget
    cut = lambda v: F.when(fits, v).otherwise(F.greatest(F.lit(1), F.floor(v * f).cast("int")))
    return F.struct(cut(w).alias("w"), cut(h).alias("h"))


def megapixels(w: Column, h: Column) -> Column:
    return w.cast("double") * h / 1e6


def scale_factor(src_w: Column, dst_w: Column) -> Column:
    return F.when(src_w == 0, 0.0).otherwise(F.try_divide(dst_w.cast("double"), src_w.cast("double")))


def requested_scale(sx: Column, sy: Column) -> Column:
    return F.greatest(sx, sy)


def uniform_scale(sx: Column, sy: Column) -> Column:
    """The mean of both scales if they agree to one hundredth, else null."""
    return F.when(F.abs(sx - sy) <= 0.01 * F.greatest(sx, sy), (sx + sy) / 2)


def tile_memory(tile: Column, scale: Column, channels: int = 3) -> Column:
    return tile.cast("double") * tile * channels * 4 * scale * scale


def suggest_tile(budget: Column, scale: Column, channels: int = 3) -> Column:
    """The largest tile side whose output fits a budget of bytes, in 64..2048; 0 without a budget."""
    side = F.floor(F.sqrt(budget.cast("double") / (channels * 4 * scale * scale))).cast("int")
    return F.when(F.coalesce(budget, F.lit(0)) <= 0, 0).otherwise(F.greatest(F.lit(64), F.least(F.lit(2048), side)))


def human_size(size: Column) -> Column:
    """Bytes as text with one decimal: B, KB, MB, GB, TB."""
    v = size.cast("double")
    out = None
    for i, unit in enumerate(("B", "KB", "MB", "GB")):
        text = F.format_string(f"%.1f {unit}", v / 1024.0**i)
        cond = v < 1024.0 ** (i + 1)
        out = F.when(cond, text) if out is None else out.when(cond, text)
    return out.otherwise(F.format_string("%.1f TB", v / 1024.0**4))


def box_radius(sigma: float) -> int:
    """Radius of the box of which three passes come near a Gaussian of sigma."""
    return max(1, round((math.sqrt(4 * sigma * sigma + 1) - 1) / 2))
