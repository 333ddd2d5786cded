"""Registered queries of pipelines, spectral analysis, files and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import color
from rasterloom.operators import models, percentiles, spectral, tilework, topology
from rasterloom.plans import catalogue as base
from rasterloom.plans import config, phase, pipeline
from rasterloom.plans import sqltext as sql
from rasterloom.sources import decode, encode, headers, images, tables
from rasterloom.streaming import jobs

register, rounded, RGB = base.register, base.rounded, base.RGB


def per_image(df, cols=tuple(RGB)):
    """(image_id, n, and the mean, least and greatest of each column)."""
    parts = [f(c).alias(f"{c}_{n}") for c in cols for n, f in (("mean", F.avg), ("least", F.min), ("most", F.max))]
    d = df.groupBy("image_id").agg(F.count("*").alias("n"), *parts)
    return rounded(d, ["image_id", "n"], [x for x in d.columns if x not in ("image_id", "n")])


def per_image_sql(q: str, cols=tuple(RGB)) -> str:
    return f"SELECT image_id, count(*) AS n, {', '.join(f'ROUND({f}({c}), 6) + 0e0 AS {c}_{n}' for c in cols for n, f in (('mean', 'avg'), ('least', 'min'), ('most', 'max')))} FROM ({q}) GROUP BY image_id"


# Pipelines
_fast = pipeline.with_options("fast")
register("pipeline_fast", lambda s, d: per_image(pipeline.enhance(tables.part_images(s, d).drop("a"), _fast)), per_image_sql(sql.detail(sql.chained(tables.PART_IMAGES, RGB, 2.0, 1), RGB, 2, 1e-3, 0.25)))
_quality = pipeline.with_options("quality", scale=2.0, sharpen=0.5, contrast=0.1, saturation=1.1)
_q = sql.levels(sql.denoise(tables.PART_IMAGES, RGB, 3.0, 0.035), 0.5, 99.5, 0.25)
_q = sql.chroma_denoise(sql.chained(_q, RGB, 2.0, 1), 2.4)
_q = sql.adjust(sql.unsharp(sql.detail(_q, RGB, 2, 8e-4, 0.40), RGB, 0.5, 0.5, 0.004), 0.1, 1.1, 1.0)
register("pipeline_quality", lambda s, d: per_image(pipeline.enhance(tables.part_images(s, d).drop("a"), _quality)), per_image_sql(_q))
register("pipeline_pixels", lambda s, d: per_image(tilework.as_pixels(pipeline._by_pixels(tables.part_rows(s, d).drop("a"), _quality, None), RGB)), per_image_sql(_q))
# One image of vectors, on tiles of 24 pixels with a margin
_TINTED = f"SELECT image_id, h, w, y, x, v AS r, 1e0 - v AS g, v * v AS b FROM ({tables.EMBEDDING_FIELD})"


def tinted(s, d):
    v = F.col("v")
    return tables.embedding_field(s, d).select("image_id", "h", "w", "y", "x", v.alias("r"), (1 - v).alias("g"), (v * v).alias("b"))


def by_row(df):
    """(image_id, y, n, and the mean, least and greatest of each channel of the row)."""
    parts = [f(c).alias(f"{c}_{n}") for c in RGB for n, f in (("mean", F.avg), ("least", F.min), ("most", F.max))]
    d = df.groupBy("image_id", "y").agg(F.count("*").alias("n"), *parts)
    return d.select("image_id", "y", "n", *((F.round(c, 6) + 0.0).alias(c) for c in d.columns[3:]))


def by_row_sql(q: str) -> str:
    parts = ", ".join(f"ROUND({f}({c}), 6) + 0e0 AS {c}_{n}" for c in RGB for n, f in (("mean", "avg"), ("least", "min"), ("most", "max")))
    return f"SELECT image_id, CAST(y AS INT) AS y, count(*) AS n, {parts} FROM ({q}) GROUP BY image_id, y"


_tiles = pipeline.with_options("quality", scale=2.0, tile=24, sharpen=0.5, contrast=0.1, saturation=1.1)
_t = sql.chroma_denoise(sql.chained(sql.levels(sql.denoise(_TINTED, RGB, 3.0, 0.035), 0.5, 99.5, 0.25), RGB, 2.0, 1), 2.4)
_t = sql.adjust(sql.unsharp(sql.detail(_t, RGB, 2, 8e-4, 0.40), RGB, 0.5, 0.5, 0.004), 0.1, 1.1, 1.0)
register("pipeline_tiled", lambda s, d: by_row(pipeline.enhance(tinted(s, d), _tiles)), by_row_sql(_t))


def repeating():
    """Stands for a model of scale 2 that fails for want of memory on tiles of over 30 pixels."""

    def process(x):
        if max(x.shape[2:]) > 30:
            raise MemoryError
        return x.repeat(2, axis=2).repeat(2, axis=3)

    return process


# The model works on floats: channels are brought to multiples of 1/64, of which sums are exact.
_DOUBLED = f"SELECT image_id, CAST(2 * y + i AS INT) AS y, SUM(r) AS r, SUM(g) AS g, SUM(b) AS b, count(*) AS n FROM (SELECT image_id, y, FLOOR(r * 64) / 64 AS r, FLOOR(g * 64) / 64 AS g, FLOOR(b * 64) / 64 AS b FROM ({_TINTED})), range(0, 2) a(i), range(0, 2) b(j) GROUP BY 1, 2"


def coarse(s, d):
    return tinted(s, d).withColumns({c: F.floor(F.col(c) * 64) / 64 for c in RGB})


_model = pipeline.Options(scale=2.0, tile=48, tile_overlap=6, tile_pad=4, detail=0.0, pre_downscale=False)
register("pipeline_model_tiles", lambda s, d: rounded(pipeline.enhance(coarse(s, d), _model, pipeline.TileBackend(repeating, 2, 4, 16)).groupBy("image_id", "y").agg(*(F.sum(c).alias(c) for c in RGB), F.count("*").alias("n")), ["image_id", "y", "n"], RGB), sql.rounded(_DOUBLED, ["image_id", "y", "n"], RGB))
_ENDS = {"p1": 0.01, "p50": 0.5, "p99": 0.99}
register(
    "levels_by_histogram",
    lambda s, d: rounded(percentiles.percentiles(tables.embedding_field(s, d).unionByName(tables.part_images(s, d).select("image_id", "h", "w", "y", "x", F.col("r").alias("v")).where("image_id > 0")), "v", _ENDS), ["image_id"], list(_ENDS)),
    f"SELECT image_id, {', '.join(f'ROUND(quantile_cont(v, {q}), 6) + 0e0 AS {n}' for n, q in _ENDS.items())} FROM (SELECT image_id, v FROM ({tables.EMBEDDING_FIELD}) UNION ALL SELECT image_id, r FROM ({tables.PART_IMAGES}) WHERE image_id > 0) GROUP BY image_id",
)
register("pipeline_alpha", lambda s, d: per_image(pipeline.enhance(tables.part_images(s, d), pipeline.with_options("fast", detail=0.0, backend="nearest")), (*RGB, "a")), per_image_sql(f"SELECT n.image_id, n.y, n.x, n.r, n.g, n.b, t.a FROM ({sql.nearest(tables.PART_IMAGES, 'w * 2', 'h * 2')}) n JOIN ({sql.replace(sql.chained(tables.PART_IMAGES, ['a'], 2.0, 1), {'a': sql.clip01('a')})}) t USING (image_id, y, x)", (*RGB, "a")))
_side = tables.SIDE * 3 // 2
register("pipeline_fitted", lambda s, d: per_image(pipeline.enhance(tables.part_images(s, d), pipeline.with_options("fast", longest_side=_side, detail_radius=5)), (*RGB, "a")), per_image_sql(f"SELECT n.image_id, n.y, n.x, n.r, n.g, n.b, t.a FROM ({sql.detail(sql.chained(tables.PART_IMAGES, RGB, 1.5, 1), RGB, 2, 1e-3, 0.25)}) n JOIN ({sql.replace(sql.chained(tables.PART_IMAGES, ['a'], 1.5, 1), {'a': sql.clip01('a')})}) t USING (image_id, y, x)", (*RGB, "a")))
_most = tables.SIDE * tables.SIDE * 2
_cut = int(tables.SIDE * 3 * (_most / (tables.SIDE * 3) ** 2) ** 0.5)
register("pipeline_max_pixels", lambda s, d: per_image(pipeline.enhance(tables.part_images(s, d).drop("a"), pipeline.with_options("fast", scale=3.0, max_pixels=_most, detail=0.0, backend="nearest"))), per_image_sql(sql.nearest(tables.PART_IMAGES, f"{_cut}", f"{_cut}")))
register(
    "pipeline_target",
    lambda s, d: pipeline.target(base.order_sizes(s, d).select("o_orderkey", "w", "h"), pipeline.Options(longest_side=1500, max_pixels=1_000_000)).select("o_orderkey", "out_w", "out_h", F.size("notes").alias("n_notes")),
    f"""WITH o AS (SELECT o_orderkey, GREATEST(1, CAST(round_even(w * (1500 / CAST(GREATEST(w, h) AS DOUBLE)), 0) AS INT)) AS tw, GREATEST(1, CAST(round_even(h * (1500 / CAST(GREATEST(w, h) AS DOUBLE)), 0) AS INT)) AS th FROM ({base._O})),
f AS (SELECT *, SQRT(1e6 / (CAST(tw AS DOUBLE) * th)) AS f FROM o)
SELECT o_orderkey, CASE WHEN tw * th <= 1000000 THEN tw ELSE GREATEST(1, CAST(FLOOR(tw * f) AS INT)) END AS out_w, CASE WHEN tw * th <= 1000000 THEN th ELSE GREATEST(1, CAST(FLOOR(th * f) AS INT)) END AS out_h, CASE WHEN tw * th > 1000000 THEN 1 ELSE 0 END AS n_notes FROM f""",
)

# Spectral analysis and the phase method
register(
    "dft_rows",
    lambda s, d: rounded(spectral.dft_rows(tables.part_rows(s, d), "r"), ["image_id", "y", "k"], ["re", "im"]),
    sql.rounded(f"SELECT image_id, y, CAST(k AS INT) AS k, SUM(r * COS(-2 * PI() * k * x / w)) AS re, SUM(r * SIN(-2 * PI() * k * x / w)) AS im FROM ({tables.PART_IMAGES}), range(0, {tables.SIDE // 2 + 1}) t(k) GROUP BY image_id, y, k", ["image_id", "y", "k"], ["re", "im"]),
)
_n = tables.SIDE
# The transform of each image by its definition, over the half spectrum; what a column of frequencies counts for is twice unless it is its own mirror.
_SPLIT = f"""
WITH p AS ({sql.add(tables.PART_IMAGES, {"v": sql.LUMA})}),
f AS (SELECT CAST(fy AS INT) AS fy, CAST(fx AS INT) AS fx, CASE WHEN fy < {(_n + 1) // 2} THEN fy ELSE fy - {_n} END / {_n}e0 AS ky, fx / {_n}e0 AS kx, CASE WHEN fx IN (0, {_n // 2}) THEN 1e0 ELSE 2e0 END AS c FROM range(0, {_n}) a(fy), range(0, {_n // 2 + 1}) b(fx)),
r AS (SELECT *, GREATEST(SQRT(kx * kx + ky * ky), 1e-6) AS r FROM f),
g AS (SELECT *, {", ".join(f"EXP(-0.5e0 * POW(LN(r / {0.22 * 2.0**-k}) / LN(1.6e0), 2)) AS g{k}" for k in range(3))} FROM r),
t AS (SELECT *, g0 + g1 + g2 AS total, GREATEST(1e0, max(g0 + g1 + g2) OVER ()) AS peak FROM g),
m AS (SELECT fy, fx, c, kx / CASE WHEN fx = 0 AND fy = 0 THEN 1 ELSE r END AS qx, ky / CASE WHEN fx = 0 AND fy = 0 THEN 1 ELSE r END AS qy, band, CASE band WHEN 0 THEN g0 / peak WHEN 1 THEN g1 / peak WHEN 2 THEN g2 / peak ELSE GREATEST(0e0, 1 - total / peak) END AS g FROM t, (VALUES (-1), (0), (1), (2)) v(band)),
s AS (SELECT image_id, fy, fx, SUM(v * COS(2 * PI() * (fy * y + fx * x) / {_n})) AS re, -SUM(v * SIN(2 * PI() * (fy * y + fx * x) / {_n})) AS im FROM p, f GROUP BY image_id, fy, fx),
e AS (SELECT s.image_id, band, c * g / {_n * _n}e0 AS k, qx * CAST(band >= 0 AS INT) AS qx, qy * CAST(band >= 0 AS INT) AS qy, re * COS(a) - im * SIN(a) AS even, re * SIN(a) + im * COS(a) AS odd, y, x
  FROM s JOIN m USING (fy, fx) JOIN (SELECT fy, fx, CAST(y AS INT) AS y, CAST(x AS INT) AS x, 2 * PI() * (fy * y + fx * x) / {_n} AS a FROM f, range(0, {_n}) u(y), range(0, {_n}) w(x)) USING (fy, fx))
SELECT image_id, y, x, band, SUM(k * even) AS b, SUM(k * qx * odd) AS rx, SUM(k * qy * odd) AS ry FROM e GROUP BY image_id, y, x, band"""
register("band_split", lambda s, d: per_image(spectral.decompose(tables.part_images(s, d).withColumn("v", color.luminance()), "v"), ("b", "rx", "ry")), per_image_sql(_SPLIT, ("b", "rx", "ry")))
# The bands and the low pass add up to the field, so the sum of a split is the field again.
# One image of vectors, in strips of 2,048 pixels: bands and low pass add up to it again
register("two_pass_split", lambda s, d: rounded(spectral.decompose(tables.embedding_field(s, d), "v", most=2048).groupBy("image_id", "y", "x").agg(F.sum("b").alias("v")), base.AT, ["v"]), sql.rounded(tables.EMBEDDING_FIELD, base.AT, ["v"]))
_AROUND = " AND ".join(f"(v, y * 64 + x) < (coalesce({f}(v, {n}) OVER {o}, 1e9), (y + {dy}) * 64 + x + {dx})" for f, n, o, dy, dx in [("lag", 1, "r", 0, -1), ("lead", 1, "r", 0, 1), ("lag", 1, "c", -1, 0), ("lead", 1, "c", 1, 0), ("lag", 1, "u", -1, -1), ("lead", 1, "u", 1, 1), ("lag", 1, "d", -1, 1), ("lead", 1, "d", 1, -1)])
register(
    "minima_of_field",
    lambda s, d: topology.minima(tables.embedding_field(s, d), "v", 4096).select("image_id", "y", "x", F.round("birth", 6).alias("birth")),
    f"SELECT image_id, y, x, ROUND(v, 6) AS birth FROM (SELECT *, {_AROUND} AS low FROM ({tables.EMBEDDING_FIELD}) WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y), u AS (PARTITION BY x - y ORDER BY y), d AS (PARTITION BY x + y ORDER BY y)) WHERE low",
)
register("band_sum", lambda s, d: rounded(spectral.decompose(tables.part_images(s, d).withColumn("v", color.luminance()), "v", bands=1).groupBy("image_id", "y", "x").agg(F.sum("b").alias("v")), base.AT, ["v"]), sql.rounded(sql.add(tables.PART_IMAGES, {"v": sql.LUMA}), base.AT, ["v"]))
# The images of parts are rows of arrays here: an image stays in its row from the source to the result.
_luma_rows = lambda s, d: color.luminance_rows(tables.part_rows(s, d), "v")
register("phase_enlarge", lambda s, d: per_image(phase.enlarge(_luma_rows(s, d), 2.0), ("v",)))
register("phase_enlarge_rgb", lambda s, d: per_image(phase.enlarge_rgb(tables.part_rows(s, d), 2.0, keep_topology=False)))
register(
    "phase_report",
    lambda s, d: phase.report_rows(tables.part_rows(s, d), 2.0, "g").select(
        "image_id", "h", "w", "out_h", "out_w", *(F.round(c, 6).alias(c) for c in ("mean_coherence", "residual_energy", "suppressed_energy", "tau")), "suppressed_peaks", "restored_peaks", "matches", F.col("candidate.total").alias("total")
    ),
)
register("peaks_of_parts", lambda s, d: topology.signature(topology.extrema(tables.part_rows(s, d), "g").union(topology.extrema(tables.part_rows(s, d), "g", "pit"))))
def encoded_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of the part images as JPEG, PNG and TIFF files."""
    rows = tables.part_rows(spark, sf_dir)
    files = [encode.encode(rows, fmt) for fmt in ("JPEG", "PNG", "TIFF")]
    found = headers.headers(files[0].unionByName(files[1]).unionByName(files[2]).select("image_id", "content"))
    return found.select("image_id", "format", "width", "height", "mode", "has_alpha", "error")


register(
    "encoded_headers",
    encoded_headers,
    f"""SELECT DISTINCT image_id, f AS format, w AS width, h AS height, CASE f WHEN 'JPEG' THEN 'RGB' ELSE 'RGBA' END AS mode, f <> 'JPEG' AS has_alpha, CAST(NULL AS VARCHAR) AS error
FROM ({tables.PART_IMAGES}), (VALUES ('JPEG'), ('PNG'), ('TIFF')) t(f)""",
)
# One large image whose file is coded in strips of sixteen lines.
register(
    "png_strips",
    lambda s, d: rounded(
        decode.decode(encode.encode(tables.embedding_field(s, d).select("image_id", "h", "w", "y", "x", *(F.col("v").alias(c) for c in "rgb")), gray=True, strip=1024)),
        ["image_id", "h", "w", "y", "x", "mode", "error"],
        ["r"],
    ),
    f"SELECT image_id, h, w, y, x, 'L' AS mode, CAST(NULL AS VARCHAR) AS error, round(floor((0.299e0 * v + 0.587e0 * v + 0.114e0 * v) * 255e0 + 0.5e0) / 255e0, 6) AS r FROM ({tables.EMBEDDING_FIELD})",
)
register("png_roundtrip", lambda s, d: images.probe(images.encode_png(tables.part_rows(s, d)).withColumnRenamed("png", "content")), f"SELECT DISTINCT image_id, 'PNG' AS format, w AS width, h AS height, 'RGBA' AS mode, true AS has_alpha, CAST(NULL AS VARCHAR) AS error FROM ({tables.PART_IMAGES})")

register(
    "png_pixels",
    lambda s, d: rounded(decode.decode(images.encode_png(tables.part_rows(s, d)), content="png"), ["image_id", "h", "w", "y", "x", "mode", "error"], [*RGB, "a"]),
    f"SELECT image_id, h, w, y, x, 'RGBA' AS mode, CAST(NULL AS VARCHAR) AS error, {', '.join(f'ROUND(FLOOR(GREATEST(0e0, LEAST(255e0, {c} * 255e0 + 0.5e0))) / 255e0, 6) + 0e0 AS {c}' for c in (*RGB, 'a'))} FROM ({tables.PART_IMAGES})",
)

# Headers of four formats, put together from the columns of parts
_SIZES = "SELECT p_partkey, CAST(1 + p_partkey % 5000 AS INT) AS width, CAST(1 + p_size * 7 AS INT) AS height, p_partkey % 4 AS kind, CAST(p_partkey % 60 AS INT) AS more FROM part"


def part_headers(s, d):
    k = F.col("p_partkey")
    p = tables.read(s, d, "part").select("p_partkey", (1 + k % 5000).cast("int").alias("w"), (1 + F.col("p_size") * 7).cast("int").alias("h"), (k % 60).cast("int").alias("more"))
    big = lambda c, n: F.lpad(F.hex(c.cast("long")), 2 * n, "0")
    little = lambda c, n: F.concat(*(F.substring(big(c, n), 2 * n - 1 - 2 * i, 2) for i in range(n)))
    w, h, more = F.col("w"), F.col("h"), F.col("more")
    lit = F.lit
    jpeg = F.concat(lit("FFD8FFE2"), big(more + 16, 2), lit("4943435F50524F46494C45000101"), F.repeat(lit("AA"), more), lit("FFC0001108"), big(h, 2), big(w, 2), lit("03011100021100031100FFDA"))
    tiff = F.concat(lit("4D4D002A000000080003"), lit("0100000400000001"), big(w, 4), lit("0101000400000001"), big(h, 4), lit("0106000300000001"), lit("00010000"), big(more, 4))
    webp = F.concat(lit("524946460000000057454250565038580A000000"), F.when(more % 2 == 1, "12").otherwise("00"), lit("000000"), little(w - 1, 3), little(h - 1, 3))
    gif = F.concat(lit("474946383961"), little(w, 2), little(h, 2), lit("000000"), F.repeat(lit("2C" + "00" * 9 + "020100" + "00"), F.when(more % 3 == 0, 2).otherwise(1)), lit("3B"))
    return p.select("p_partkey", F.unhex(F.when(k % 4 == 0, jpeg).when(k % 4 == 1, tiff).when(k % 4 == 2, webp).otherwise(gif)).alias("content"))


register(
    "headers_of_parts",
    lambda s, d: headers.headers(part_headers(s, d)),
    f"""SELECT p_partkey, CASE kind WHEN 0 THEN 'JPEG' WHEN 1 THEN 'TIFF' WHEN 2 THEN 'WEBP' ELSE 'GIF' END AS format, width, height,
  CASE kind WHEN 0 THEN 'RGB' WHEN 1 THEN '1' WHEN 2 THEN CASE WHEN more % 2 = 1 THEN 'RGBA' ELSE 'RGB' END ELSE 'P' END AS mode, kind = 2 AND more % 2 = 1 AS has_alpha,
  CASE kind WHEN 0 THEN false WHEN 1 THEN more > 0 WHEN 2 THEN more % 2 = 1 ELSE more % 3 = 0 END AS animated, CAST(CASE WHEN kind = 0 THEN more ELSE 0 END AS BIGINT) AS icc_bytes, CAST(NULL AS VARCHAR) AS error FROM ({_SIZES})""",
)

# Files: the addresses of pages as paths
register(
    "normalize_format",
    lambda s, d: tables.read(s, d, "part").select("p_partkey", images.normalize_format(F.element_at(F.array(*map(F.lit, (" .JPG", "png", "", ".TiFF", "heic", "jpe", ".webp "))), (F.col("p_partkey") % 7 + 1).cast("int"))).alias("format")),
    "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'JPEG' WHEN 1 THEN 'PNG' WHEN 2 THEN 'PNG' WHEN 3 THEN 'TIFF' WHEN 4 THEN 'HEIC' WHEN 5 THEN 'JPEG' ELSE 'WEBP' END AS format FROM part",
)
register("save_options", lambda s, d: tables.read(s, d, "region").select("r_regionkey", F.try_element_at(images.save_options(F.when(F.col("r_regionkey") % 2 == 0, "JPEG").otherwise("BMP"), 90), F.lit("quality")).alias("quality")), "SELECT r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN '90' END AS quality FROM region")


def page_paths(s, d):
    return tables.read(s, d, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("path"))


_PATHS = "SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages"
register("output_names", lambda s, d: images.outputs(page_paths(s, d), "_x2", ".png").select("page_id", "target"), f"SELECT page_id, regexp_extract(path, '^(.*?)(\\.[^./]*)?$', 1) || '_x2.png' AS target FROM ({_PATHS})")
register("skip_existing", lambda s, d: images.pending(images.outputs(page_paths(s, d), "", ".png"), images.outputs(page_paths(s, d).where("page_id % 3 = 0"), "", ".png").select(F.col("target").alias("path"))).select("page_id"), f"WITH p AS (SELECT page_id, regexp_extract(path, '^(.*?)(\\.[^./]*)?$', 1) || '.png' AS target FROM ({_PATHS})) SELECT page_id FROM p WHERE target NOT IN (SELECT target FROM p WHERE page_id % 3 = 0)")
register("batch_report", lambda s, d: jobs.batch_report(images.batch_plan(images.outputs(page_paths(s, d), "", ".png"), images.outputs(page_paths(s, d).where("page_id % 3 = 0"), "", ".png").select(F.col("target").alias("path")))), f"WITH p AS (SELECT page_id, regexp_extract(path, '^(.*?)(\\.[^./]*)?$', 1) || '.png' AS target FROM ({_PATHS})) SELECT CASE WHEN target IN (SELECT target FROM p WHERE page_id % 3 = 0) THEN 'skipped' ELSE 'pending' END AS status, count(*) AS n FROM p GROUP BY 1")
register(
    "model_presence",
    lambda s, d: models.presence(models.catalogue(s), tables.read(s, d, "nation").select(F.concat(F.lit("/m/"), F.element_at(F.array(*map(F.lit, ("x4plus.onnx", "x4plus_fp16.onnx", "animevideov3_fp16.onnx", "general-x4v3.pth", "other.onnx"))), (F.col("n_nationkey") % 5 + 1).cast("int"))).alias("path"))).select("name", "arch", "scale", "onnx", "weights"),
    "SELECT name, arch, scale, CASE name WHEN 'x4plus' THEN '/m/x4plus.onnx' WHEN 'animevideov3' THEN '/m/animevideov3_fp16.onnx' END AS onnx, CASE name WHEN 'general-x4v3' THEN '/m/general-x4v3.pth' END AS weights FROM (VALUES ('x4plus', 'rrdb', 4), ('x4plus-anime', 'rrdb', 4), ('general-x4v3', 'srvgg', 4), ('general-wdn-x4v3', 'srvgg', 4), ('animevideov3', 'srvgg', 4)) t(name, arch, scale)",
)
register(
    "output_range",
    lambda s, d: tables.read(s, d, "customer").groupBy("c_nationkey").agg(F.min(F.col("c_acctbal") / 9000).alias("low"), F.max(F.col("c_acctbal") / F.when(F.col("c_nationkey") % 2 == 0, 9000).otherwise(90000)).alias("high")).select("c_nationkey", models.range_rule(F.col("low"), F.col("high")).alias("rule")),
    "SELECT c_nationkey, CASE WHEN max(c_acctbal / CASE WHEN c_nationkey % 2 = 0 THEN 9000 ELSE 90000 END) > 1.5 THEN 'bytes' WHEN min(c_acctbal / 9000) < -0.05 THEN 'signed' ELSE 'unit' END AS rule FROM customer GROUP BY c_nationkey",
)

# Jobs: events as a log of jobs
_J = """SELECT event_id AS job_id, user_id % 20 AS queue, CASE event_type WHEN 'view' THEN 'queued' WHEN 'signup' THEN 'running' WHEN 'click' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS status,
  ts AS created_at, CASE WHEN event_type <> 'view' THEN ts + INTERVAL 2 SECOND END AS started_at, CASE WHEN event_type IN ('click', 'error', 'purchase') THEN ts + INTERVAL 2 SECOND + to_microseconds(CAST(FLOOR(value * 1000) AS BIGINT) * 10000) END AS finished_at, value FROM events"""


def event_jobs(s, d):
    e, kind = tables.read(s, d, "events"), F.col("event_type")
    status = F.when(kind == "view", "queued").when(kind == "signup", "running").when(kind == "click", "succeeded").when(kind == "error", "failed").otherwise("cancelled")
    micros = F.unix_micros(F.col("ts").cast("timestamp")) + 2_000_000
    return e.select(
        F.col("event_id").alias("job_id"),
        (F.col("user_id") % 20).alias("queue"),
        status.alias("status"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.when(kind != "view", F.timestamp_micros(micros)).alias("started_at"),
        F.when(kind.isin("click", "error", "purchase"), F.timestamp_micros(micros + F.floor(F.col("value") * 1000).cast("long") * 10000)).alias("finished_at"),
        "value",
    )


def _now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


register("job_stats", lambda s, d: jobs.stats(event_jobs(s, d)), f"SELECT count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status IN ('succeeded', 'failed', 'cancelled')) AS finished, count(*) AS retained FROM ({_J})")
register("job_elapsed", lambda s, d: event_jobs(s, d).select("job_id", jobs.elapsed_ms(_now()).alias("ms"), jobs.done().alias("done")), f"SELECT job_id, ROUND((epoch_us(coalesce(finished_at, TIMESTAMP '2024-02-01 00:00:00')) - epoch_us(started_at)) / 1000e0, 2) AS ms, status IN ('succeeded', 'failed', 'cancelled') AS done FROM ({_J})")
register("job_cancel", lambda s, d: jobs.cancel(event_jobs(s, d), event_jobs(s, d).where("job_id % 2 = 0")).groupBy("status").agg(F.count("*").alias("n")), f"SELECT CASE WHEN status = 'queued' AND job_id % 2 = 0 THEN 'cancelled' ELSE status END AS status, count(*) AS n FROM ({_J}) GROUP BY 1")
register("job_ttl", lambda s, d: jobs.evict(event_jobs(s, d), _now(), 86400.0 * 20).select("job_id", "status"), f"SELECT job_id, status FROM ({_J}) WHERE NOT (status IN ('succeeded', 'failed', 'cancelled') AND coalesce(epoch_us(finished_at) < epoch_us(TIMESTAMP '2024-02-01 00:00:00') - 1728000000000, false))")
register(
    "job_admission",
    lambda s, d: jobs.admit(event_jobs(s, d), 40).select("job_id", "active", "admitted"),
    f"""WITH RECURSIVE j AS ({_J}), e AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY queue ORDER BY moment, step, job_id) AS k FROM (
    SELECT queue, job_id, created_at AS moment, 1 AS step, coalesce(finished_at > created_at, true) AS holds FROM j
    UNION ALL SELECT queue, job_id, finished_at, -1, false FROM j WHERE finished_at IS NOT NULL)
), r AS (
  SELECT DISTINCT queue, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS held, CAST(NULL AS BIGINT) AS job_id, 0 AS step, CAST(0 AS BIGINT) AS active FROM j
  UNION ALL
  SELECT r.queue, e.k, CASE WHEN e.step < 0 THEN list_filter(r.held, lambda x: x <> e.job_id) WHEN e.holds AND len(r.held) < 40 THEN list_append(r.held, e.job_id) ELSE r.held END,
    CAST(e.job_id AS BIGINT), e.step, CAST(len(r.held) AS BIGINT) FROM r JOIN e ON e.k = r.k + 1 AND e.queue IS NOT DISTINCT FROM r.queue
)
SELECT job_id, active, active < 40 AS admitted FROM r WHERE step = 1""",
)
register("http_status", lambda s, d: event_jobs(s, d).select("job_id", jobs.http_status(F.when(F.col("status") == "failed", F.element_at(F.array(*map(F.lit, ("unauthorized", "queue_full", "odd"))), (F.col("job_id") % 3 + 1).cast("int")))).alias("code")), f"SELECT job_id, CASE WHEN status <> 'failed' THEN 200 ELSE CASE job_id % 3 WHEN 0 THEN 401 WHEN 1 THEN 429 ELSE 400 END END AS code FROM ({_J})")


def event_options():
    """Options of an event's props as a nested form: k is the tile and missing the scale."""
    inner = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("tile"), F.get_json_object("props", "$.missing").alias("scale")))
    return config.options_from(config.form_fields(F.create_map(F.lit("options"), inner)), pipeline.Options())


register(
    "option_layers",
    lambda s, d: tables.read(s, d, "events").select("event_id", event_options().alias("o")).select("event_id", "o.tile", "o.scale"),
    "SELECT event_id, coalesce(TRY_CAST(props->>'$.k' AS INT), 512) AS tile, coalesce(TRY_CAST(props->>'$.missing' AS DOUBLE), 4e0) AS scale FROM events",
)
register("bench_summary", lambda s, d: event_jobs(s, d).groupBy("status").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("median_ms"), F.round(F.min("value"), 6).alias("least_ms")), f"SELECT status, ROUND(quantile_cont(value, 0.5), 6) AS median_ms, ROUND(min(value), 6) AS least_ms FROM ({_J}) GROUP BY status")
