"""The registered queries over relations of pixels and their SQL. Each query reads whole tables; doubles are rounded to 6 places (and -0 is 0)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import color, sizing
from rasterloom.operators import neighbourhood as near
from rasterloom.operators import kernels, resample, tilework
from rasterloom.plans import sqltext as sql
from rasterloom.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AT, RGB = ["image_id", "y", "x"], ["r", "g", "b"]


def rounded(df: DataFrame, keep: list[str], cols: list[str]) -> DataFrame:
    return df.select(*keep, *((F.round(c, 6) + 0.0).alias(c) for c in cols))


def register(name: str, query: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


def _image(name: str, source, source_sql: str, change, change_sql, keep: list[str], cols: list[str]) -> None:
    """A query that changes pixels and returns them rounded."""
    register(name, lambda s, d: rounded(change(source(s, d)), keep, cols), sql.rounded(change_sql(source_sql), keep, cols))


def _parts(name: str, change, change_sql, cols: list[str] = RGB, keep: list[str] = AT) -> None:
    _image(name, tables.part_images, tables.PART_IMAGES, change, change_sql, keep, cols)


def _field(name: str, change, change_sql, cols: tuple[str, ...] = ("v",), keep: list[str] = AT) -> None:
    _image(name, tables.embedding_field, tables.EMBEDDING_FIELD, change, change_sql, keep, list(cols))


def _rows(name: str, change, change_sql, cols: list[str] = RGB, keep: list[str] = AT) -> None:
    """As _parts, of images that are rows of arrays until they are changed."""
    _image(name, tables.part_rows, tables.PART_IMAGES, lambda d: tilework.as_pixels(change(d), cols), change_sql, keep, cols)


# Pointwise
_parts("luma", lambda d: d.withColumn("luma", color.luminance()), lambda q: sql.add(q, {"luma": sql.LUMA}), ["luma"])
_parts("ycbcr_forward", color.rgb_to_ycbcr, sql.ycbcr, ["luma", "cb", "cr"])
_parts("ycbcr_roundtrip", lambda d: color.ycbcr_to_rgb(color.rgb_to_ycbcr(d)), lambda q: sql.rgb(sql.ycbcr(q)))
_parts("color_adjust", lambda d: color.adjust_color(d, 0.2, 1.3, 1.2), lambda q: sql.adjust(q, 0.2, 1.3, 1.2))
_rows("auto_levels", lambda d: tilework.changed(d, RGB, lambda v: kernels.levels(v, 0.8, None, 0.5, 99.5)), lambda q: sql.levels(q, 0.5, 99.5, 0.8))
register(
    "to_u8",
    lambda s, d: tables.part_images(s, d).groupBy(color.to_u8(F.round("r", 9)).alias("level")).agg(F.count("*").alias("pixels")),
    f"SELECT CAST(FLOOR(GREATEST(0e0, LEAST(255e0, ROUND(r, 9) * 255e0 + 0.5e0))) AS INT) AS level, count(*) AS pixels FROM ({tables.PART_IMAGES}) GROUP BY 1",
)
register(
    "alpha_to_unit",
    lambda s, d: tables.read(s, d, "part").select("p_partkey", F.round(color.alpha_to_unit(F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") * 5).when(F.col("p_partkey") % 3 == 1, F.col("p_size") * 1300).otherwise(F.col("p_size") / 40.0).cast("double"), F.when(F.col("p_partkey") % 3 == 0, 8).when(F.col("p_partkey") % 3 == 1, 16).otherwise(32)), 6).alias("alpha")),
    "SELECT p_partkey, ROUND(CASE p_partkey % 3 WHEN 0 THEN p_size * 5 / 255e0 WHEN 1 THEN p_size * 1300 / 65535e0 ELSE GREATEST(0e0, LEAST(1e0, p_size / 40e0)) END, 6) AS alpha FROM part",
)

# Sizes, from the keys of orders
_O = "SELECT o_orderkey, CAST(16 + o_orderkey % 1900 AS INT) AS w, CAST(16 + o_custkey % 1100 AS INT) AS h, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 1 + CAST(o_custkey % 7 AS DOUBLE) / 2 END AS scale, CASE WHEN o_orderkey % 4 = 1 THEN CAST(o_custkey % 900 AS INT) END AS tw, CASE WHEN o_orderkey % 6 = 1 THEN CAST(o_custkey % 700 AS INT) END AS th, CASE WHEN o_orderkey % 7 = 2 THEN CAST(100 + o_custkey % 800 AS INT) END AS side, o_orderkey % 2 = 0 AS keep, CAST(o_totalprice * 100 AS BIGINT) AS budget FROM orders"


def order_sizes(s: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return tables.read(s, d, "orders").select(
        "o_orderkey",
        (16 + k % 1900).cast("int").alias("w"),
        (16 + c % 1100).cast("int").alias("h"),
        F.when(k % 5 != 0, 1 + (c % 7).cast("double") / 2).alias("scale"),
        F.when(k % 4 == 1, (c % 900).cast("int")).alias("tw"),
        F.when(k % 6 == 1, (c % 700).cast("int")).alias("th"),
        F.when(k % 7 == 2, (100 + c % 800).cast("int")).alias("side"),
        (k % 2 == 0).alias("keep"),
        F.floor(F.round(F.col("o_totalprice") * 100, 0)).cast("long").alias("budget"),
    )


register(
    "resolve_target_matrix",
    lambda s, d: order_sizes(s, d).withColumn("t", sizing.resolve_target(*(F.col(c) for c in ("w", "h", "scale", "tw", "th", "side", "keep")))).select("o_orderkey", F.col("t.w").alias("out_w"), F.col("t.h").alias("out_h")),
    f"""WITH o AS ({_O}), f AS (SELECT *, CASE WHEN side IS NOT NULL THEN side / CAST(GREATEST(w, h) AS DOUBLE) ELSE coalesce(scale, 4e0) END AS k FROM o)
SELECT o_orderkey,
  CASE WHEN tw IS NOT NULL AND th IS NOT NULL THEN GREATEST(1, tw) WHEN tw IS NOT NULL THEN GREATEST(1, tw) WHEN th IS NOT NULL THEN CASE WHEN keep THEN GREATEST(1, CAST(round_even(w * th / CAST(h AS DOUBLE), 0) AS INT)) ELSE w END ELSE GREATEST(1, CAST(round_even(w * k, 0) AS INT)) END AS out_w,
  CASE WHEN tw IS NOT NULL AND th IS NOT NULL THEN GREATEST(1, th) WHEN tw IS NOT NULL THEN CASE WHEN keep THEN GREATEST(1, CAST(round_even(h * tw / CAST(w AS DOUBLE), 0) AS INT)) ELSE h END WHEN th IS NOT NULL THEN GREATEST(1, th) ELSE GREATEST(1, CAST(round_even(h * k, 0) AS INT)) END AS out_h FROM f""",
)
register(
    "fit_within",
    lambda s, d: order_sizes(s, d).withColumn("t", sizing.fit_within(F.col("w"), F.col("h"), F.col("o_orderkey") % 300000 + 1000)).select("o_orderkey", F.col("t.w").alias("out_w"), F.col("t.h").alias("out_h")),
    f"WITH o AS (SELECT *, o_orderkey % 300000 + 1000 AS b FROM ({_O})) SELECT o_orderkey, CASE WHEN w * h <= b THEN w ELSE GREATEST(1, CAST(FLOOR(w * SQRT(CAST(b AS DOUBLE) / (CAST(w AS DOUBLE) * h))) AS INT)) END AS out_w, CASE WHEN w * h <= b THEN h ELSE GREATEST(1, CAST(FLOOR(h * SQRT(CAST(b AS DOUBLE) / (CAST(w AS DOUBLE) * h))) AS INT)) END AS out_h FROM o",
)
register(
    "tile_budget",
    lambda s, d: order_sizes(s, d).select("o_orderkey", sizing.suggest_tile(F.col("o_orderkey") * 1000, F.lit(4)).alias("tile"), sizing.tile_memory(F.col("w"), F.lit(4)).cast("long").alias("bytes"), sizing.human_size(F.col("o_orderkey") * 12345).alias("size"), F.round(sizing.megapixels(F.col("w"), F.col("h")), 6).alias("megapixels")),
    f"""SELECT o_orderkey, CASE WHEN o_orderkey * 1000 <= 0 THEN 0 ELSE GREATEST(64, LEAST(2048, CAST(FLOOR(SQRT(o_orderkey * 1000e0 / 192)) AS INT))) END AS tile, CAST(w AS BIGINT) * w * 192 AS bytes,
  CASE WHEN o_orderkey * 12345 < 1024 THEN printf('%.1f B', o_orderkey * 12345e0) WHEN o_orderkey * 12345 < 1048576 THEN printf('%.1f KB', o_orderkey * 12345e0 / 1024) WHEN o_orderkey * 12345 < 1073741824 THEN printf('%.1f MB', o_orderkey * 12345e0 / 1048576) ELSE printf('%.1f GB', o_orderkey * 12345e0 / 1073741824) END AS size, ROUND(w * CAST(h AS DOUBLE) / 1e6, 6) AS megapixels FROM ({_O})""",
)
register(
    "scale_checks",
    lambda s, d: order_sizes(s, d).withColumn("sx", F.col("w") / 500.0).withColumn("sy", F.col("h") / 500.0).select("o_orderkey", F.round(sizing.uniform_scale(F.col("sx"), F.col("sy")), 6).alias("uniform"), F.round(sizing.requested_scale(F.col("sx"), F.col("sy")), 6).alias("requested"), F.round(sizing.scale_factor(F.col("o_orderkey") % 4, F.col("w")), 6).alias("factor")),
    f"WITH o AS (SELECT *, w / 500e0 AS sx, h / 500e0 AS sy FROM ({_O})) SELECT o_orderkey, ROUND(CASE WHEN ABS(sx - sy) <= 0.01e0 * GREATEST(sx, sy) THEN (sx + sy) / 2 END, 6) AS uniform, ROUND(GREATEST(sx, sy), 6) AS requested, ROUND(CASE WHEN o_orderkey % 4 = 0 THEN 0e0 ELSE w / CAST(o_orderkey % 4 AS DOUBLE) END, 6) AS factor FROM o",
)

# Filters
_field("box_blur_r4", lambda d: near.box_blur(d, ["v"], 4), lambda q: sql.box(q, ["v"], 4))
_field("gauss_s2", lambda d: near.gaussian_blur(d, ["v"], 2.0), lambda q: sql.gauss(q, ["v"], 2.0))
_field("guided_r4", lambda d: near.guided_filter(d, ["v"], ["v"], 4, 1e-3), lambda q: sql.drop(sql.replace(sql.guided(q, ["v"], ["v"], 4, 1e-3), {"v": "t0"}), ["t0"]))
_parts("box_blur_wide", lambda d: near.box_blur(d, RGB, 12, 2), lambda q: sql.box(q, RGB, 12, 2))
_field("box_blur_blocks", lambda d: near.box_blur(d, ["v"], 12, 2, block=64), lambda q: sql.box(q, ["v"], 12, 2))
_field("guided_blocks", lambda d: near.guided_filter(d, ["v"], ["v"], 4, 1e-3, block=64), lambda q: sql.drop(sql.replace(sql.guided(q, ["v"], ["v"], 4, 1e-3), {"v": "t0"}), ["t0"]))
_image("box_blur_long_line", tables.event_line, tables.EVENT_LINE, lambda d: near.box_blur(d, ["v"], 500, axes="x", block=256), lambda q: sql.box(q, ["v"], 500), AT, ["v"])
_rows("detail", lambda d: near.detail_enhance(d, RGB, 2, 1e-3, 0.35), lambda q: sql.detail(q, RGB, 2, 1e-3, 0.35))
_parts("unsharp", lambda d: near.unsharp(d, RGB, 0.8, 1.0, 0.004), lambda q: sql.unsharp(q, RGB, 0.8, 1.0, 0.004))
_rows("denoise", lambda d: near.denoise(d, RGB, 3.0, 0.04), lambda q: sql.denoise(q, RGB, 3.0, 0.04))
_parts("chroma_denoise", lambda d: near.chroma_denoise(d, 2.0), lambda q: sql.chroma_denoise(q, 2.0))
_GRAD = lambda at, across, size, out: f"CASE WHEN {size} = 1 THEN 0e0 WHEN {at} = 0 THEN LEAD(v) OVER (PARTITION BY image_id, {across} ORDER BY {at}) - v WHEN {at} = {size} - 1 THEN v - LAG(v) OVER (PARTITION BY image_id, {across} ORDER BY {at}) ELSE (LEAD(v) OVER (PARTITION BY image_id, {across} ORDER BY {at}) - LAG(v) OVER (PARTITION BY image_id, {across} ORDER BY {at})) / 2 END"
_field("gradient", lambda d: near.gradient(d, "v"), lambda q: sql.add(sql.add(q, {"gx": _GRAD("x", "y", "w", "gx"), "gy": _GRAD("y", "x", "h", "gy")}), {"magnitude": "SQRT(gx * gx + gy * gy)"}), ("gx", "gy", "magnitude"))
_field(
    "orient_smooth",
    lambda d: near.orient_smooth(d.withColumn("theta", 0.1 + (F.col("x") % 31).cast("double") / 10), "v", "theta", 2),
    lambda q: f"""WITH f AS (SELECT *, 0.1e0 + CAST(x % 31 AS DOUBLE) / 10 AS theta FROM ({q})),
s AS (SELECT image_id, y, x, t.step, GREATEST(0, LEAST(h - 1, CAST(round_even(y + t.step * SIN(theta), 0) AS INT))) AS ny, GREATEST(0, LEAST(w - 1, CAST(round_even(x + t.step * COS(theta), 0) AS INT))) AS nx FROM f, range(-2, 3) t(step))
SELECT s.image_id, s.y, s.x, SUM(f.v * EXP(-0.5e0 * step * step / 4)) / SUM(EXP(-0.5e0 * step * step / 4)) AS smooth FROM s JOIN f ON f.image_id = s.image_id AND f.y = ny AND f.x = nx GROUP BY s.image_id, s.y, s.x""",
    ("smooth",),
)

# Resampling
_SIZED = [*AT, "h", "w"]
_field("resample_2x", lambda d: resample.enlarge(d, ["v"], 2.0).withColumn("v", color.clip01(F.col("v"))), lambda q: sql.replace(sql.resize(q, ["v"], "w * 2", "h * 2"), {"v": sql.clip01("v")}), keep=_SIZED)
_field("resample_2x_pixels", lambda d: resample.resize(d, ["v"], F.col("w") * 2, F.col("h") * 2).withColumn("v", color.clip01(F.col("v"))), lambda q: sql.replace(sql.resize(q, ["v"], "w * 2", "h * 2"), {"v": sql.clip01("v")}), keep=_SIZED)
_field("resample_down", lambda d: resample.resize(d, ["v"], F.lit(20), F.lit(37)), lambda q: sql.resize(q, ["v"], "20", "37"), keep=_SIZED)
_field("resample_nonuniform", lambda d: resample.resize(d, ["v"], F.lit(96), F.floor(F.col("h") * 0.7)), lambda q: sql.resize(q, ["v"], "96", "FLOOR(h * 0.7e0)"), keep=_SIZED)
_rows("resample_3x_chained", lambda d: resample.resize_chained(d, RGB, 3.0), lambda q: sql.chained(q, RGB, 3.0, 2), RGB, _SIZED)
_parts("nearest_2x", lambda d: resample.nearest(d, F.col("w") * 2, F.col("h") * 3), lambda q: sql.nearest(q, "w * 2", "h * 3"), RGB, _SIZED)
_parts("nearest_down", lambda d: resample.nearest(d, F.lit(5), F.lit(3)), lambda q: sql.nearest(q, "5", "3"), RGB, _SIZED)
_rows("alpha_resample", lambda d: resample.resize_alpha(d.select("image_id", "h", "w", "a"), "a", 2.0), lambda q: sql.replace(sql.chained(q, ["a"], 2.0, 1), {"a": sql.clip01("a")}), ["a"], _SIZED)
register(
    "lanczos_taps",
    lambda s, d: resample.lanczos_taps(s, 64, 150).select("o", "i", F.round("w", 6).alias("w")),
    f"WITH t AS (SELECT CAST(o AS INT) AS o, CAST(i AS INT) AS i, {sql.kernel('(o + 0.5e0) * (64 / 150e0) - 0.5e0 - i')} AS w FROM range(0, 150) a(o), range(0, 64) b(i) WHERE ABS((o + 0.5e0) * (64 / 150e0) - 0.5e0 - i) < 3) SELECT o, i, ROUND(w / GREATEST(SUM(w) OVER (PARTITION BY o), 1e-8), 6) AS w FROM t",
)
