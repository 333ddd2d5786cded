"""Pointwise colour arithmetic: column expressions on r, g, b in 0..1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rec. 601 luma and the chroma scales.
LUMA = (0.299, 0.587, 0.114)
CB, CR = 0.564, 0.713


def clip01(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def luminance(r: Column | str = "r", g: Column | str = "g", b: Column | str = "b") -> Column:
    r, g, b = (F.col(c) if isinstance(c, str) else c for c in (r, g, b))
    return LUMA[0] * r + LUMA[1] * g + LUMA[2] * b


def luminance_rows(rows: DataFrame, name: str) -> DataFrame:
    """Adds the luma of images that are rows of arrays."""
    rg = F.zip_with("r", "g", lambda r, g: LUMA[0] * r + LUMA[1] * g)
    return rows.withColumn(name, F.zip_with(rg, "b", lambda rg, b: rg + LUMA[2] * b))


def rgb_to_ycbcr(df: DataFrame) -> DataFrame:
    """Replaces r, g, b by luma, cb, cr."""
    y = luminance()
    return df.withColumns({"luma": y, "cb": (F.col("b") - y) * CB + 0.5, "cr": (F.col("r") - y) * CR + 0.5}).drop("r", "g", "b")


def ycbcr_to_rgb(df: DataFrame) -> DataFrame:
    """Replaces luma, cb, cr by r, g, b; green solves the luma equation."""
    y = F.col("luma")
    r, b = y + (F.col("cr") - 0.5) / CR, y + (F.col("cb") - 0.5) / CB
    return df.withColumns({"r": r, "g": (y - LUMA[0] * r - LUMA[2] * b) / LUMA[1], "b": b}).drop("luma", "cb", "cr")


def adjust_color(df: DataFrame, contrast: float = 0.0, saturation: float = 1.0, gamma: float = 1.0) -> DataFrame:
    """Gamma, then contrast by luma, then saturation about luma, then clip. Neutral steps don't enter the plan."""
    rgb = ["r", "g", "b"]
    if gamma != 1.0:
        df = df.withColumns({c: F.pow(clip01(F.col(c)), F.lit(1.0 / gamma)) for c in rgb})
    if contrast != 0.0:
        lift = (luminance() - 0.5) * contrast
        df = df.withColumns({c: F.col(c) + lift for c in rgb})
    if saturation != 1.0:
        y = luminance()
        df = df.withColumns({c: y + (F.col(c) - y) * saturation for c in rgb})
    return df.withColumns({c: clip01(F.col(c)) for c in rgb})


def auto_levels(df: DataFrame, low: float = 0.5, high: float = 99.5, strength: float = 1.0) -> DataFrame:
    """Stretches each image so that its luma percentiles low and high become 0 and 1, blended by strength.

    The percentiles are a table of one row for each image; images whose range is below 1e-4 stay as they are.
    """
    p = df.groupBy("image_id").agg(F.percentile(luminance(), F.array(F.lit(low / 100), F.lit(high / 100))).alias("p"))
    span = F.col("p")[1] - F.col("p")[0]
    gain = F.when(span >= 1e-4, 1 / F.greatest(span, F.lit(1e-4)))
    p = p.select("image_id", F.coalesce(1 + (gain - 1) * strength, F.lit(1.0)).alias("__g"), F.coalesce(-F.col("p")[0] * gain * strength, F.lit(0.0)).alias("__b"), gain.isNotNull().alias("__on"))
    out = df.join(p, "image_id")
    return out.withColumns({c: F.when(F.col("__on"), clip01(F.col(c) * F.col("__g") + F.col("__b"))).otherwise(F.col(c)) for c in ("r", "g", "b")}).drop("__g", "__b", "__on")


def to_u8(v: Column) -> Column:
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), v * 255.0 + 0.5))).cast("int")


def alpha_to_unit(value: Column, bits: Column) -> Column:
    """Alpha of 8 or 16 bits, or already in 0..1, to 0..1."""
    return F.when(bits == 8, value / 255.0).when(bits == 16, value / 65535.0).otherwise(clip01(value))
