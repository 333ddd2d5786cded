"""Phase transport: bands are carried to a finer grid by phasors, as a grouped sum over four taps of each output pixel."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8


def orientation(bands: DataFrame) -> DataFrame:
    """(image_id, h, w, y, x, theta): half the angle of the sum over bands of weight times (cos 2 theta, sin 2 theta) of (rx, ry).

    bands has b, rx, ry; the weight is the root of b^2 + rx^2 + ry^2.
    """
    t = F.atan2("ry", "rx")
    wt = F.sqrt(F.col("b") * F.col("b") + F.col("rx") * F.col("rx") + F.col("ry") * F.col("ry"))
    d = bands.groupBy("image_id", "h", "w", "y", "x").agg(F.sum(wt * F.sin(2 * t)).alias("s"), F.sum(wt * F.cos(2 * t)).alias("c"))
    return d.select("image_id", "h", "w", "y", "x", (0.5 * F.atan2("s", "c")).alias("theta"))


def amplitude_phase(bands: DataFrame) -> DataFrame:
    """Adds r (the Riesz part along theta), amp and phi to bands with b, rx, ry, theta."""
    r = F.col("rx") * F.cos("theta") + F.col("ry") * F.sin("theta")
    d = bands.withColumn("r", r)
    return d.withColumns({"amp": F.hypot("b", "r"), "phi": F.atan2("r", "b")})


def dominant_orientation(bands: DataFrame) -> DataFrame:
    """As orientation, of analysed bands (theta, amp), weighted by amplitude."""
    d = bands.groupBy("image_id", "h", "w", "y", "x").agg(F.sum(F.col("amp") * F.sin(2 * F.col("theta"))).alias("s"), F.sum(F.col("amp") * F.cos(2 * F.col("theta"))).alias("c"))
    return d.select("image_id", "h", "w", "y", "x", (0.5 * F.atan2("s", "c")).alias("theta"))


def coherence(bands: DataFrame) -> DataFrame:
    """(image_id, y, x, kappa): how far the bands' phasors agree, 0 to 1."""
    d = bands.groupBy("image_id", "y", "x").agg(F.sum(F.col("amp") * F.cos("phi")).alias("c"), F.sum(F.col("amp") * F.sin("phi")).alias("s"), F.sum("amp").alias("a"))
    return d.select("image_id", "y", "x", (F.hypot("c", "s") / F.greatest("a", F.lit(EPS))).alias("kappa"))


def diagnostics(bands: DataFrame) -> DataFrame:
    return bands.groupBy("image_id", "band").agg(F.avg("amp").alias("energy"), (F.max("phi") - F.min("phi")).alias("phase_span"))


def axis_coords(u: Column, scale: float, n: Column) -> Column:
    """Place of output pixel u among n input pixels, by pixel centres, kept within them."""
    return F.greatest(F.lit(0.0), F.least((n - 1).cast("double"), (u + 0.5) / scale - 0.5))


def transport(bands: DataFrame, scale: float, gain: float = 1.0, gamma: float = 1.0, power: float = 0.5, anisotropy: float = 0.55, sigma_normal: float = 0.6, sigma_tangent: float = 1.8) -> DataFrame:
    """(image_id, band, h, w, y, x, v): bands (band, theta, amp, phi, gx, gy) carried to the size times scale, each with mean 0.

    Each input pixel is sent to the output pixels it is a tap of, so no tap table is joined.
    """
    d = bands.withColumns({"oh": F.greatest(F.lit(1), F.rint(F.col("h") * scale).cast("int")), "ow": F.greatest(F.lit(1), F.rint(F.col("w") * scale).cast("int"))})
    for at, size, out, u, q in (("y", "h", "oh", "uy", "qy"), ("x", "w", "ow", "ux", "qx")):
        # Outputs whose place is less than one pixel away; the edges take all that lie beyond.
        low = F.when(F.col(at) == 0, 0).otherwise(F.greatest(F.lit(0), F.floor((F.col(at) - 0.5) * scale - 0.5).cast("int")))
        high = F.when(F.col(at) == F.col(size) - 1, F.col(out) - 1).otherwise(F.least(F.col(out) - 1, F.ceil((F.col(at) + 1.5) * scale - 0.5).cast("int")))
        d = d.where(low <= high).withColumn(u, F.explode(F.sequence(low, high))).withColumn(q, axis_coords(F.col(u), scale, F.col(size))).where(F.abs(F.col(q) - F.col(at)) < 1)
    dx, dy = F.col("x") - F.col("qx"), F.col("y") - F.col("qy")
    cell = (1 - F.abs(dx)) * (1 - F.abs(dy))
    along, across = dx * F.cos("theta") + dy * F.sin("theta"), dy * F.cos("theta") - dx * F.sin("theta")
    tangent = sigma_normal + anisotropy * (sigma_tangent - sigma_normal)
    kernel = F.exp(-0.5 * (across * across / sigma_normal**2 + along * along / tangent**2))
    advance = F.col("phi") + gain * (F.col("gx") * -dx + F.col("gy") * -dy)
    wt = cell * kernel
    a = F.greatest(F.col("amp"), F.lit(EPS))
    d = d.withColumns({"wa": wt * F.pow(a, F.lit(gamma)), "wf": wt * F.pow(a, F.lit(gamma - 1.0)), "advance": advance})
    d = d.groupBy("image_id", "band", F.col("oh").alias("h"), F.col("ow").alias("w"), F.col("uy").alias("y"), F.col("ux").alias("x")).agg(
        F.sum(F.col("wa") * F.cos("advance")).alias("re"), F.sum(F.col("wa") * F.sin("advance")).alias("im"), F.sum("wa").alias("mass"), F.sum("wf").alias("flat")
    )
    kappa = F.hypot("re", "im") / F.greatest("mass", F.lit(1e-12))
    v = F.col("mass") / F.greatest("flat", F.lit(1e-12)) * F.pow(kappa, F.lit(power)) * F.cos(F.atan2("im", "re"))
    d = d.select("image_id", "band", "h", "w", "y", "x", v.alias("v"))
    mean = d.groupBy("image_id", "band").agg(F.avg("v").alias("__m"))
    return d.join(mean, ["image_id", "band"]).withColumn("v", F.col("v") - F.col("__m")).drop("__m")


def frequency_bank(spark, h: int, w: int, bands: int = 3, top: float = 0.22, sigma: float = 1.6) -> DataFrame:
    """(band, fy, fx, g): log-Gabor transfers of a half spectrum; band -1 is the low pass, and the bands sum to at most 1."""
    half = w // 2 + 1
    d = spark.range(h * half).select((F.col("id") / half).cast("int").alias("fy"), (F.col("id") % half).cast("int").alias("fx"))
    y = F.when(F.col("fy") < (h + 1) // 2, F.col("fy")).otherwise(F.col("fy") - h) / float(h)
    x = F.col("fx") / float(w)
    r = F.greatest(F.sqrt(x * x + y * y), F.lit(1e-6))
    raw = [F.exp(-0.5 * F.pow(F.log(r / (top * 2.0**-k)) / math.log(sigma), F.lit(2.0))) for k in range(bands)]
    total = raw[0]
    for g in raw[1:]:
        total = total + g
    d = d.withColumns({"r": r, "total": total, **{f"g{k}": g for k, g in enumerate(raw)}})
    peak = F.broadcast(d.agg(F.greatest(F.lit(1.0), F.max("total")).alias("peak")))
    d = d.join(peak)  # one row
    stacked = F.explode(F.array(*(F.struct(F.lit(k).alias("band"), (F.col(f"g{k}") / F.col("peak")).alias("g")) for k in range(bands)), F.struct(F.lit(-1).alias("band"), F.greatest(F.lit(0.0), 1 - F.col("total") / F.col("peak")).alias("g"))))
    return d.select("fy", "fx", stacked.alias("s")).select("s.band", "fy", "fx", "s.g")
