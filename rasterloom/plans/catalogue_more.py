"""More registered queries: tiles, topology, phase transport and jobs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from rasterloom.functions import color
from rasterloom.operators import phasors, tilework, tiling, topology, transport
from rasterloom.plans import catalogue as base
from rasterloom.plans import phase
from rasterloom.plans import sqltext as sql
from rasterloom.sources import tables

register, rounded, RGB = base.register, base.rounded, base.RGB

# Tiles
_RANGES = """SELECT *, CASE WHEN tile <= 0 OR tile >= total THEN 1 ELSE GREATEST(1, tile - 2 * LEAST(overlap, tile // 2)) END AS stride, CASE WHEN tile <= 0 OR tile >= total THEN 0 ELSE CAST(CEIL((total - tile) / CAST(GREATEST(1, tile - 2 * LEAST(overlap, tile // 2)) AS DOUBLE)) AS INT) END AS last FROM ({q})"""
_R = "SELECT o_orderkey, CAST(1 + o_orderkey % 1000 AS INT) AS total, CAST(o_custkey % 5 * 32 AS INT) AS tile, CAST(o_custkey % 3 * 8 AS INT) AS overlap FROM orders"
register(
    "axis_ranges",
    lambda s, d: tiling.axis_ranges(tables.read(s, d, "orders").select("o_orderkey", (1 + F.col("o_orderkey") % 1000).cast("int").alias("total"), (F.col("o_custkey") % 5 * 32).cast("int").alias("tile"), (F.col("o_custkey") % 3 * 8).cast("int").alias("overlap")), "total", "tile", "overlap").groupBy("o_orderkey").agg(F.count("*").alias("n"), F.max("end").alias("end"), F.sum(F.col("start").cast("long") * (F.col("k") + 1)).alias("check")),
    f"""WITH r AS ({_RANGES.format(q=_R)}), k AS (SELECT *, UNNEST(range(0, last + 1)) AS k FROM r), e AS (SELECT *, CASE WHEN tile <= 0 OR tile >= total THEN total ELSE LEAST(k * stride + tile, total) END AS en FROM k)
SELECT o_orderkey, count(*) AS n, CAST(max(en) AS INT) AS "end", CAST(sum(CASE WHEN tile <= 0 OR tile >= total THEN 0 ELSE GREATEST(0, en - tile) END * (k + 1)) AS BIGINT) AS "check" FROM e GROUP BY o_orderkey""",
)
TILE, OVERLAP = 5, 1
_T = "SELECT image_id, h, w, ty, tx, y0, LEAST(y0 + 5, h) AS y1, x0, LEAST(x0 + 5, w) AS x1 FROM (SELECT DISTINCT image_id, h, w FROM ({q})) i, (VALUES (0, 0), (1, 3)) a(ty, y0), (VALUES (0, 0), (1, 3)) b(tx, x0)"
_images = lambda s, d: tables.part_images(s, d).select("image_id", "h", "w").distinct()
register("plan_tiles", lambda s, d: tiling.plan_tiles(_images(s, d), TILE, OVERLAP), _T.format(q=tables.PART_IMAGES))
register("tile_stats", lambda s, d: tiling.stats(tiling.plan_tiles(_images(s, d), TILE, OVERLAP)), f"SELECT image_id, count(*) AS tiles, CAST(max((y1 - y0) * (x1 - x0)) AS INT) AS max_tile_px FROM ({_T.format(q=tables.PART_IMAGES)}) GROUP BY image_id")


def _feather(at: str, lo: str, hi: str, n: str, o: str) -> str:
    m = f"LEAST({o}, ({hi} - {lo}) // 2)"
    ramp = lambda i: f"0.5e0 - 0.5e0 * COS(PI() * ({i} + 0.5e0) / {m})"
    return f"(CASE WHEN {m} > 1 AND {lo} > 0 AND {at} - {lo} < {m} THEN {ramp(f'({at} - {lo})')} ELSE 1e0 END * CASE WHEN {m} > 1 AND {hi} < {n} AND {hi} - 1 - {at} < {m} THEN {ramp(f'({hi} - 1 - {at})')} ELSE 1e0 END)"


def _tiled(values: dict[str, str], overlap: int) -> str:
    t = f"SELECT image_id, h, w, ty, tx, y0, LEAST(y0 + 6, h) AS y1, x0, LEAST(x0 + 6, w) AS x1 FROM (SELECT DISTINCT image_id, h, w FROM ({tables.PART_IMAGES})) i, (VALUES (0, 0), (1, 2)) a(ty, y0), (VALUES (0, 0), (1, 2)) b(tx, x0)"
    q = f"SELECT p.*, t.* EXCLUDE (image_id, h, w), {_feather('p.y', 'y0', 'y1', 'p.h', str(overlap))} * {_feather('p.x', 'x0', 'x1', 'p.w', str(overlap))} AS wt FROM ({tables.PART_IMAGES}) p JOIN ({t}) t ON p.image_id = t.image_id AND p.y >= y0 AND p.y < y1 AND p.x >= x0 AND p.x < x1"
    return f"SELECT image_id, y, x, {', '.join(f'SUM(wt * ({e})) / GREATEST(SUM(wt), 1e-6) AS {c}' for c, e in values.items())} FROM ({q}) GROUP BY image_id, y, x"


def _tile_rows(s, d, change):
    # 6 wide, 2 of overlap: strides of 2, so 8 pixels take two tiles an axis
    return tilework.as_pixels(tiling.blended_rows(tables.part_rows(s, d), RGB, 6, 2, change), RGB)


register("tiled_equals_whole", lambda s, d: rounded(_tile_rows(s, d, lambda v, ty, tx: v), base.AT, RGB), sql.rounded(tables.PART_IMAGES, base.AT, RGB))
_shade = {c: f"{c} + 0.01e0 * (tx + 2 * ty)" for c in RGB}
register("feather_blend", lambda s, d: rounded(_tile_rows(s, d, lambda v, ty, tx: v + 0.01 * (tx + 2 * ty)), base.AT, RGB), sql.rounded(_tiled(_shade, 2), base.AT, RGB))
register(
    "reflect_pad",
    lambda s, d: tiling.reflect_pad(tables.part_images(s, d), 3).groupBy("image_id", "h", "w").agg(F.count("*").alias("n"), F.round(F.sum(F.col("r") * (F.col("y") * 17 + F.col("x"))), 4).alias("check")),
    f"""WITH o AS (SELECT CAST(i AS INT) AS i, CASE WHEN i < 3 THEN 3 - i WHEN i > 10 THEN 14 - (i - 3) ELSE i - 3 END AS j FROM range(0, 14) t(i))
SELECT image_id, 14 AS h, 14 AS w, count(*) AS n, ROUND(SUM(r * (a.i * 17 + b.i)), 4) AS "check" FROM ({tables.PART_IMAGES}) p JOIN o a ON p.y = a.j JOIN o b ON p.x = b.j GROUP BY image_id""",
)
register(
    "pad_then_crop",
    lambda s, d: rounded(tiling.crop(tiling.reflect_pad(tables.part_images(s, d), 3), F.lit(3), F.lit(tables.SIDE), F.lit(tables.SIDE)), base.AT, RGB),
    sql.rounded(tables.PART_IMAGES, base.AT, RGB),
)

# Topology
register(
    "pool_max",
    lambda s, d: topology.pool_max(tables.embedding_field(s, d), "v", 5000).select("image_id", "factor", "py", "px", F.round("v", 6).alias("v")),
    f"WITH f AS (SELECT *, CASE WHEN h * w <= 5000 THEN 1 ELSE GREATEST(2, CAST(CEIL(SQRT(h * w / 5000e0)) AS INT)) END AS factor FROM ({tables.EMBEDDING_FIELD})) SELECT image_id, factor, CAST(y // factor AS INT) AS py, CAST(x // factor AS INT) AS px, ROUND(MAX(v), 6) AS v FROM f GROUP BY 1, 2, 3, 4",
)
register("persistence_threshold", lambda s, d: topology.persistence_threshold(tables.part_images(s, d), "r", 0.18).select("image_id", F.round("tau", 6).alias("tau")), f"SELECT image_id, ROUND(0.18e0 * GREATEST(quantile_cont(r, 0.99) - quantile_cont(r, 0.01), 0e0), 6) AS tau FROM ({tables.PART_IMAGES}) GROUP BY image_id")
# Extrema given as rows: customers as points
_P = "SELECT CAST(c_nationkey AS BIGINT) AS image_id, CASE WHEN c_custkey % 2 = 0 THEN 'peak' ELSE 'pit' END AS kind, CAST(c_custkey % 300 AS INT) AS y, CAST(c_custkey * 7 % 311 AS INT) AS x, ABS(c_acctbal) / 10000e0 AS persistence FROM customer"


def customer_points(s, d):
    k = F.col("c_custkey")
    return tables.read(s, d, "customer").select(F.col("c_nationkey").cast("long").alias("image_id"), F.when(k % 2 == 0, "peak").otherwise("pit").alias("kind"), (k % 300).cast("int").alias("y"), (k * 7 % 311).cast("int").alias("x"), (F.abs("c_acctbal") / 10000.0).alias("persistence"))


register(
    "signature_from_extrema",
    lambda s, d: topology.signature(customer_points(s, d)).select("image_id", "peaks", "pits", "total", F.round(F.col("spectrum")[0], 6).alias("first"), F.size("spectrum").alias("kept"), F.round("sum_persistence", 6).alias("sum_persistence")),
    f"SELECT image_id, count(*) FILTER (kind = 'peak') AS peaks, count(*) FILTER (kind = 'pit') AS pits, count(*) AS total, ROUND(max(persistence), 6) AS first, CAST(LEAST(32, count(*)) AS INT) AS kept, ROUND(sum(persistence), 6) AS sum_persistence FROM ({_P}) GROUP BY image_id",
)
register(
    "budget_matches",
    lambda s, d: customer_points(s, d).groupBy("image_id").agg(F.sum(F.when(F.col("kind") == "peak", F.col("persistence")).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("kind") == "pit", F.col("persistence")).otherwise(0.0)).alias("b")).select("image_id", topology.matches(F.col("a"), F.col("b")).alias("ok")),
    f"WITH p AS (SELECT image_id, sum(CASE WHEN kind = 'peak' THEN persistence ELSE 0e0 END) AS a, sum(CASE WHEN kind = 'pit' THEN persistence ELSE 0e0 END) AS b FROM ({_P}) GROUP BY image_id) SELECT image_id, CASE WHEN a <= 0 THEN b <= 1e-9 ELSE b <= a * 1.25e0 END AS ok FROM p",
)
register(
    "unmatched_peaks",
    lambda s, d: topology.unmatched(customer_points(s, d).where("kind = 'peak'"), customer_points(s, d).where("kind = 'pit'"), 10, 9.0).select("image_id", "y", "x"),
    f"WITH p AS ({_P}) SELECT image_id, y, x FROM p c WHERE kind = 'peak' AND NOT EXISTS (SELECT 1 FROM p r WHERE r.kind = 'pit' AND r.image_id = c.image_id AND (r.y - c.y) * (r.y - c.y) + (r.x - c.x) * (r.x - c.x) <= 81)",
)
register(
    "stamp_mask",
    lambda s, d: topology.stamp(customer_points(s, d).withColumns({"h": F.lit(300), "w": F.lit(311)}), 3).select("image_id", "y", "x", F.round("mask", 6).alias("mask")),
    f"""WITH s AS (SELECT image_id, GREATEST(0, LEAST(299, y + a.d)) AS y, GREATEST(0, LEAST(310, x + b.d)) AS x, EXP(-(a.d * a.d + b.d * b.d) / 4.5e0) AS wt FROM ({_P}), range(-3, 4) a(d), range(-3, 4) b(d))
SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, ROUND(LEAST(1e0, SUM(wt)), 6) AS mask FROM s WHERE wt >= 1e-3 GROUP BY 1, 2, 3""",
)
register("extrema_of_events", lambda s, d: topology.extrema(tables.event_raster(s, d), "v").union(topology.extrema(tables.event_raster(s, d), "v", "pit")))

# Phase: closed-form bands on the part images
_B = f"SELECT image_id, h, w, y, x, band, (band + 1) * (r - 0.4e0) AS b, (g - 0.5e0) / (band + 1) AS rx, (b - 0.5e0) + 0.1e0 * band AS ry FROM ({tables.PART_IMAGES}), (VALUES (0), (1)) v(band)"


def part_bands(s, d):
    p = tables.part_images(s, d).withColumn("band", F.explode(F.array(F.lit(0), F.lit(1))))
    k = F.col("band")
    return p.select("image_id", "h", "w", "y", "x", "band", ((k + 1) * (F.col("r") - 0.4)).alias("b"), ((F.col("g") - 0.5) / (k + 1)).alias("rx"), ((F.col("b") - 0.5) + 0.1 * k).alias("ry"))


# An angle is compared by the cosine and sine of its double: theta and theta + pi are the same direction.
_double = lambda d: d.select(*base.AT, (F.round(F.cos(2 * F.col("theta")), 6) + 0.0).alias("c2"), (F.round(F.sin(2 * F.col("theta")), 6) + 0.0).alias("s2"))
_TH = f"SELECT image_id, y, x, 0.5e0 * ATAN2(SUM(SQRT(b*b + rx*rx + ry*ry) * SIN(2 * ATAN2(ry, rx))), SUM(SQRT(b*b + rx*rx + ry*ry) * COS(2 * ATAN2(ry, rx)))) AS theta FROM ({_B}) GROUP BY image_id, y, x"
register("orientation", lambda s, d: _double(transport.orientation(part_bands(s, d))), f"SELECT image_id, y, x, ROUND(COS(2 * theta), 6) + 0e0 AS c2, ROUND(SIN(2 * theta), 6) + 0e0 AS s2 FROM ({_TH})")
_AN = f"SELECT *, SQRT(b * b + rr * rr) AS amp, ATAN2(rr, b) AS phi FROM (SELECT p.*, 0.3e0 AS theta, rx * COS(0.3e0) + ry * SIN(0.3e0) AS rr FROM ({_B}) p)"
_analysed = lambda s, d: transport.amplitude_phase(part_bands(s, d).withColumn("theta", F.lit(0.3)))
register("amplitude_phase", lambda s, d: rounded(_analysed(s, d), [*base.AT, "band"], ["amp", "phi"]), sql.rounded(_AN, [*base.AT, "band"], ["amp", "phi"]))
register("coherence", lambda s, d: rounded(transport.coherence(_analysed(s, d)), base.AT, ["kappa"]), sql.rounded(f"SELECT image_id, y, x, SQRT(POW(SUM(amp * COS(phi)), 2) + POW(SUM(amp * SIN(phi)), 2)) / GREATEST(SUM(amp), 1e-8) AS kappa FROM ({_AN}) GROUP BY image_id, y, x", base.AT, ["kappa"]))
register("dominant_orientation", lambda s, d: _double(transport.dominant_orientation(_analysed(s, d).withColumn("theta", F.col("theta") + F.col("band")))), f"SELECT image_id, y, x, ROUND(COS(2 * t), 6) + 0e0 AS c2, ROUND(SIN(2 * t), 6) + 0e0 AS s2 FROM (SELECT image_id, y, x, 0.5e0 * ATAN2(SUM(amp * SIN(2 * (theta + band))), SUM(amp * COS(2 * (theta + band)))) AS t FROM ({_AN}) GROUP BY image_id, y, x)")
register("band_diagnostics", lambda s, d: rounded(transport.diagnostics(_analysed(s, d)), ["image_id", "band"], ["energy", "phase_span"]), sql.rounded(f"SELECT image_id, band, AVG(amp) AS energy, MAX(phi) - MIN(phi) AS phase_span FROM ({_AN}) GROUP BY image_id, band", ["image_id", "band"], ["energy", "phase_span"]))
_W = f"SELECT image_id, h, w, y, x, 0 AS band, 0.3e0 AS theta, 0.2e0 + r AS amp, 0.8e0 * x + 0.3e0 * y AS phi, 0.8e0 AS gx, 0.3e0 AS gy FROM ({tables.PART_IMAGES})"


def part_waves(s, d):
    x, y = F.col("x"), F.col("y")
    return tables.part_images(s, d).select("image_id", "h", "w", "y", "x", F.lit(0).alias("band"), F.lit(0.3).alias("theta"), (0.2 + F.col("r")).alias("amp"), (0.8 * x + 0.3 * y).alias("phi"), F.lit(0.8).alias("gx"), F.lit(0.3).alias("gy"))


def part_wave_rows(s, d):
    """part_waves as rows of arrays."""
    wave = lambda v: np.broadcast_to(0.8 * np.arange(v.shape[-1]) + 0.3 * np.arange(v.shape[-2])[:, None], v.shape[1:])

    def bands(v):
        return np.stack([np.full(v.shape[1:], 0.3), 0.2 + v[0], wave(v), np.full(v.shape[1:], 0.8), np.full(v.shape[1:], 0.3)])

    return tilework.changed(tables.part_rows(s, d).select("image_id", "h", "w", "r"), ["r"], bands, ["theta", "amp", "phi", "gx", "gy"]).drop("r")


def moved_rows(rows, scale):
    """A band of images that are rows of arrays at scale times the size: (image_id, h, w, y, x, v)."""
    names = ["theta", "amp", "phi", "gx", "gy"]
    return tilework.as_pixels(tilework.changed(rows, names, lambda v: phasors.transported(*v, scale=scale)[None], ["v"], phase._MOST), ["v"])


_Q = lambda u, n: f"GREATEST(0e0, LEAST({n} - 1e0, ({u} + 0.5e0) / 2e0 - 0.5e0))"
register(
    "phase_transport",
    lambda s, d: rounded(moved_rows(part_wave_rows(s, d), 2.0), base.AT, ["v"]),
    f"""WITH b AS ({_W}), t AS (SELECT b.*, u.u AS uy, v.u AS ux, {_Q('v.u', 'w')} - x AS fx, {_Q('u.u', 'h')} - y AS fy FROM b, range(0, 16) u(u), range(0, 16) v(u) WHERE ABS({_Q('v.u', 'w')} - x) < 1 AND ABS({_Q('u.u', 'h')} - y) < 1),
k AS (SELECT *, (1 - ABS(fx)) * (1 - ABS(fy)) * EXP(-0.5e0 * (POW(-fy * COS(theta) + fx * SIN(theta), 2) / 0.36e0 + POW(-fx * COS(theta) - fy * SIN(theta), 2) / POW(0.6e0 + 0.55e0 * 1.2e0, 2))) AS wt, phi + gx * fx + gy * fy AS adv FROM t),
o AS (SELECT image_id, uy, ux, SUM(wt * amp * COS(adv)) AS re, SUM(wt * amp * SIN(adv)) AS im, SUM(wt * amp) AS mass, SUM(wt) AS flat FROM k GROUP BY 1, 2, 3),
v AS (SELECT image_id, CAST(uy AS INT) AS y, CAST(ux AS INT) AS x, mass / flat * SQRT(SQRT(re * re + im * im) / mass) * COS(ATAN2(im, re)) AS v FROM o)
SELECT image_id, y, x, ROUND(v - AVG(v) OVER (PARTITION BY image_id), 6) + 0e0 AS v FROM v""",
)
_BANK = """WITH f AS (SELECT CAST(a AS INT) AS fy, CAST(b AS INT) AS fx, GREATEST(SQRT(POW(b / 50e0, 2) + POW(CASE WHEN a < 20 THEN a ELSE a - 40 END / 40e0, 2)), 1e-6) AS r FROM range(0, 40) t(a), range(0, 26) s(b)),
g AS (SELECT fy, fx, band, EXP(-0.5e0 * POW(LN(r / (0.22e0 / POW(2e0, band))) / LN(1.6e0), 2)) AS g FROM f, (VALUES (0), (1), (2)) v(band)),
t AS (SELECT fy, fx, SUM(g) AS total FROM g GROUP BY fy, fx), p AS (SELECT GREATEST(1e0, MAX(total)) AS peak FROM t)
SELECT band, fy, fx, ROUND(g / peak, 6) + 0e0 AS g FROM g, p UNION ALL SELECT -1, fy, fx, ROUND(GREATEST(0e0, 1 - total / peak), 6) + 0e0 FROM t, p"""
register("log_gabor_bank", lambda s, d: transport.frequency_bank(s, 40, 50).select("band", "fy", "fx", (F.round("g", 6) + 0.0).alias("g")), _BANK)
register("partition_of_unity", lambda s, d: transport.frequency_bank(s, 40, 50).groupBy("fy", "fx").agg((F.sum("g") <= 1 + 1e-9).alias("within"), (F.abs(F.sum("g") - 1) < 1e-9).alias("whole")), "SELECT CAST(a AS INT) AS fy, CAST(b AS INT) AS fx, true AS within, true AS whole FROM range(0, 40) t(a), range(0, 26) s(b)")
