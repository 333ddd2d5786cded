"""Enhancement pipelines: options become a chain of DataFrame transforms; neutral stages never enter the plan."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import color, sizing
from rasterloom.operators import kernels, models, percentiles, resample, tilework, tiling
from rasterloom.operators import neighbourhood as near
from rasterloom.plans import phase
from rasterloom.sources import decode, images

RGB = ["r", "g", "b"]


@dataclass(frozen=True)
class Options:
    """What an enhancement does. Sizes: width and height, else one of them, else longest_side, else scale."""

    scale: float | None = 4.0
    width: int | None = None
    height: int | None = None
    longest_side: int | None = None
    keep_aspect: bool = True
    backend: str = "classical"
    model: str | None = None
    tile: int = 512
    tile_overlap: int = 16
    tile_pad: int = 16
    max_pixels: int = 64_000_000
    pre_downscale: bool | None = None
    denoise: float = 0.0
    denoise_radius: float = 3.0
    chroma_denoise: float = 0.0
    detail: float = 0.35
    detail_radius: int = 4
    detail_eps: float = 1e-3
    sharpen: float = 0.0
    sharpen_radius: float = 1.0
    sharpen_threshold: float = 0.004
    gamma: float = 1.0
    contrast: float = 0.0
    saturation: float = 1.0
    auto_levels: float = 0.0
    alpha_mode: str = "lanczos"
    output_format: str | None = None
    quality: int = 95
    extra: dict = field(default_factory=dict)

    @classmethod
    def of(cls, values: dict) -> Options:
        """Known names become fields, others go to extra."""
        known = {f.name for f in fields(cls)} - {"extra"}
        return cls(**{k: v for k, v in values.items() if k in known}, extra={k: v for k, v in values.items() if k not in known})


# The published presets.
PRESETS = {
    "fast": Options(scale=2.0, detail=0.25, detail_radius=3, tile=0),
    "default": Options(),
    "quality": Options(denoise=0.035, chroma_denoise=1.2, detail=0.40, detail_radius=5, detail_eps=8e-4, auto_levels=0.25, tile_overlap=32),
}

Backend = Callable[[DataFrame, float], DataFrame]


def classical(px: DataFrame, scale: float) -> DataFrame:
    return resample.resize_chained(px, RGB, scale)


def nearest(px: DataFrame, scale: float) -> DataFrame:
    return resample.nearest(px, F.rint(F.col("w") * scale), F.rint(F.col("h") * scale))


def phased(px: DataFrame, scale: float) -> DataFrame:
    return phase.enlarge_rgb(px, scale)


#: Backends by name; a new one is a function of the pixels and a scale.
BACKENDS: dict[str, Backend] = {"classical": classical, "nearest": nearest, "phase": phased}


def target(images: DataFrame, opts: Options) -> DataFrame:
    """Adds out_w, out_h and notes to images (w, h): the requested size, cut to max_pixels with a note."""
    lit = lambda v, t: F.lit(v).cast(t)
    want = sizing.resolve_target(F.col("w"), F.col("h"), lit(opts.scale, "double"), lit(opts.width, "int"), lit(opts.height, "int"), lit(opts.longest_side, "int"), F.lit(opts.keep_aspect))
    d = images.withColumn("__want", want)
    d = d.withColumn("__fit", sizing.fit_within(F.col("__want.w"), F.col("__want.h"), F.lit(opts.max_pixels)))
    cut = (F.col("__fit.w") != F.col("__want.w")) | (F.col("__fit.h") != F.col("__want.h"))
    note = F.when(cut, F.format_string("target cut to %d x %d", F.col("__fit.w"), F.col("__fit.h")))
    return d.withColumns({"out_w": F.col("__fit.w"), "out_h": F.col("__fit.h"), "notes": F.array_compact(F.array(note))}).drop("__want", "__fit")


def memory_guard(images: DataFrame, limit_bytes: int, opts: Options | None = None) -> DataFrame:
    """Images whose float pixels take more than limit_bytes, once they have the size that opts ask for, raise an error when they are read."""
    out = target(images, opts) if opts else images.withColumns({"out_w": F.col("w"), "out_h": F.col("h")})
    size = F.col("out_w").cast("long") * F.col("out_h") * 12
    return out.withColumn("w", F.when(size > limit_bytes, F.raise_error(F.format_string("image of %d bytes is over the limit", size)).cast("int")).otherwise(F.col("w"))).select(*images.columns)


def _sized(px: DataFrame, opts: Options) -> DataFrame:
    """px with out_w, out_h, the scale that the backend runs at (that of both axes, else the root of the area's) and the enlargement of the width."""
    d = target(px, opts).drop("notes")
    sx, sy = F.col("out_w") / F.col("w"), F.col("out_h") / F.col("h")
    uniform = F.abs(sx - sy) <= 0.01 * F.greatest(sx, sy)
    return d.withColumns({"__scale": F.when(uniform, (sx + sy) / 2).otherwise(F.sqrt(sx * sy)), "__gain": F.greatest(F.lit(1.0), sx), "__ratio": F.greatest(sx, sy)})


def _side(opts: Options) -> tuple[Column, Column]:
    """Whether an image is one tile (no side is over opts.tile, and it has at most MOST pixels), and the side of tiles, of at most MOST pixels once they are enlarged."""
    pixels = lambda w, h: F.col(w).cast("long") * F.col(h)
    whole = (F.greatest(pixels("w", "h"), pixels("out_w", "out_h")) <= kernels.MOST) & ~tiling.should_tile(F.col("h"), F.col("w"), F.lit(opts.tile))
    grown = F.greatest(F.lit(1.0), F.col("out_w") / F.col("w"), F.col("out_h") / F.col("h"))
    most = F.floor(F.lit(math.sqrt(kernels.MOST)) / grown).cast("int")
    return whole, F.when(whole, F.greatest("h", "w")).otherwise(F.greatest(F.lit(kernels.LEAST), F.least(F.lit(opts.tile or 512), most)))


def _margin(opts: Options, kind: str) -> Column:
    """Pixels of the source around a tile that its result depends on, at most."""
    out = F.lit(2)
    if kind in ("all", "before") and opts.denoise > 0:
        out = out + 2 * max(1, round(opts.denoise_radius))
    if kind == "before":
        return out
    grown = [F.col("out_w") / F.col("w"), F.col("out_h") / F.col("h")]
    # Each step looks at four pixels of its input to a side; where an image shrinks these are as many more of the source.
    steps = F.greatest(F.lit(0.0), F.ceil(F.log2(F.greatest(*grown)))) + 3
    out = out + F.ceil(4 * steps / F.least(F.lit(1.0), *grown, F.col("__scale")))
    gain, far = F.col("__gain"), F.lit(0.0)
    radius = lambda sigma: (F.sqrt(4 * sigma * sigma + 1) - 1) / 2 + 2
    if opts.chroma_denoise > 0:
        far = far + 3 * radius(opts.chroma_denoise * gain)
    if opts.detail > 0:
        far = far + 2 * (opts.detail_radius * gain / 4 + 2)
    if opts.sharpen > 0:
        far = far + 3 * radius(F.greatest(F.lit(0.5), opts.sharpen_radius * gain / 4))
    return out + F.ceil(far / F.least(*grown))


KEYS = ["out_w", "out_h", "__scale", "__gain", "__side", "__dark", "__light"]


def _worked(sized: DataFrame, names: list[str], opts: Options, kind: str) -> DataFrame:
    """Tiles of images (with KEYS but the side) through the stages of a kind: before (at the source's size), fit (from there to the target), or all."""
    whole, side = _side(opts)

    def work(v: np.ndarray, part: kernels.Part, own: tuple) -> Iterator[tuple[kernels.Part, np.ndarray, int, int]]:
        h, w, ty, tx, out_w, out_h, scale, gain, tile, dark, light = own
        ends = None if dark is None else (dark, light)
        if kind == "before":
            out_w, out_h, stages = w, h, kernels.before(replace(opts, auto_levels=0.0), h, w)
        elif kind == "fit":
            stages = kernels.resizes(h, w, out_h, out_w) + kernels.after(opts, out_h, out_w, gain)
        else:
            stages = kernels.before(opts, h, w, ends) + kernels.enlarging(opts, h, w, out_h, out_w, scale) + kernels.after(opts, out_h, out_w, gain)
        want = (*kernels.core(ty, tile, h, out_h), *kernels.core(tx, tile, w, out_w))
        if want[0] >= want[1] or want[2] >= want[3]:
            return
        for to, out in kernels.worked(v[:3], part, stages, want):
            if len(v) > 3:
                a = np.empty((1, *out.shape[1:]))
                for own_part, made in kernels.worked(v[3:], part, _alpha_stages(opts, kind, h, w, out_h, out_w), to):
                    kernels.cropped(a, to, own_part)[...] = made.clip(0, 1)
                out = np.concatenate([out, a])
            yield to, out, out_h, out_w

    # Of a tile narrower than its margins most is margin, which is sent to it and worked out again: tiles are as wide as both margins together, if they may be.
    margin = F.when(whole, 0).otherwise(_margin(opts, kind))
    grown = F.greatest(F.lit(1.0), F.col("out_w") / F.col("w"), F.col("out_h") / F.col("h"))
    wide = F.least(2 * margin, F.floor(F.lit(math.sqrt(kernels.MOST)) / grown)).cast("int")
    d = sized.withColumn("__side", F.when(whole, side).otherwise(F.greatest(side, wide)))
    return tilework.worked(tilework.cut_with_margin(d, F.col("__side"), margin), names, KEYS, work)


def _alpha_stages(opts: Options, kind: str, h: int, w: int, out_h: int, out_w: int) -> list[kernels.Stage]:
    if kind == "before":
        return []
    return [kernels.Resize(h, w, out_h, out_w, True)] if opts.alpha_mode == "nearest" else kernels.resizes(h, w, out_h, out_w)


def _by_tiles(px: DataFrame, opts: Options) -> DataFrame:
    """The enhancement on tiles with a margin. Levels of images of several tiles come from percentiles of all their pixels."""
    names = [*RGB, *(["a"] if "a" in px.columns else [])]
    nothing = {c: F.lit(None).cast("double") for c in ("__dark", "__light")}
    d = _sized(px.select("image_id", "h", "w", "y", "x", *names), opts).drop("__ratio").withColumns(nothing)
    if opts.auto_levels > 0:
        whole, _ = _side(opts)
        large = d.where(~whole)
        seen = large.select("image_id", "h", "w", "y", "x", *RGB)
        if opts.denoise > 0:
            seen = _worked(large, RGB, opts, "before")
        ends = percentiles.percentiles(seen.select("image_id", color.luminance().alias("luma")), "luma", {"__dark": 0.005, "__light": 0.995})
        d = d.where(whole).unionByName(large.drop("__dark", "__light").join(ends, "image_id"))
    return _worked(d, names, opts, "all")


@dataclass(frozen=True)
class TileBackend:
    """A model that enlarges tiles natively. opener gives a function from 1 x 3 x h x w floats to the enlarged ones; it is called once a task.

    A tile for which it raises MemoryError is halved, down to the side least.
    """

    opener: Callable[[], models.Process]
    native_scale: int
    align: int = 1
    least: int = 64


def downscaled(opts: Options, native: int) -> Column:
    """Whether images are shrunk before a model of a native scale: where that is asked for, or, left open, where a large one needs less than half of it."""
    need = F.greatest(F.col("out_w") / F.col("w"), F.col("out_h") / F.col("h"))
    asked = (need < native / 2) & (F.col("w").cast("long") * F.col("h") > 4_000_000) if opts.pre_downscale is None else F.lit(opts.pre_downscale)
    return asked & (need < native)


def _by_model(px: DataFrame, opts: Options, backend: TileBackend) -> DataFrame:
    """Denoise and levels, the model on overlapping tiles of the mirrored image, blended and cut, then the fit and the rest on tiles with a margin."""
    if "a" in px.columns:
        alpha = _by_tiles(px.select("image_id", "h", "w", "y", "x", "a", *(F.lit(0.0).alias(c) for c in RGB)), replace(opts, backend="nearest", denoise=0.0, auto_levels=0.0, chroma_denoise=0.0, detail=0.0, sharpen=0.0, gamma=1.0, contrast=0.0, saturation=1.0))
        return _by_model(px.drop("a"), opts, backend).join(alpha.select("image_id", "y", "x", "a"), ["image_id", "y", "x"])
    s, keys = backend.native_scale, ["out_w", "out_h", "__gain"]
    d = px.select("image_id", "h", "w", "y", "x", *RGB)
    nothing = {c: F.lit(None).cast("double") for c in ("__dark", "__light")}
    if opts.denoise > 0 or opts.auto_levels > 0:
        same = replace(opts, scale=1.0, width=None, height=None, longest_side=None, backend="nearest", max_pixels=2**62, chroma_denoise=0.0, detail=0.0, sharpen=0.0, gamma=1.0, contrast=0.0, saturation=1.0)
        d = _by_tiles(d, same)
    d = _sized(d, opts).drop("__ratio", "__scale")
    if opts.pre_downscale is not False:
        need = F.greatest(F.col("out_w") / F.col("w"), F.col("out_h") / F.col("h")) / s
        small = lambda c: F.when(downscaled(opts, s), F.greatest(F.lit(1), F.rint(F.col(c) * need).cast("int"))).otherwise(F.col(c))
        d = resample.resize_to(d.withColumns({"__to_w": small("w"), "__to_h": small("h"), "__out_w": F.col("out_w"), "__out_h": F.col("out_h")}).drop("out_w", "out_h"), RGB, F.col("__to_w"), F.col("__to_h"), 1.0).drop("__to_w", "__to_h").withColumnsRenamed({"__out_w": "out_w", "__out_h": "out_h"})
    d = models.on_tiles(d, backend.opener, s, opts.tile, opts.tile_overlap, opts.tile_pad, backend.align, keys, backend.least)
    return _worked(d.withColumn("__scale", F.least(F.col("out_w") / F.col("w"), F.col("out_h") / F.col("h"))).withColumns(nothing), RGB, opts, "fit")


def enhance(px: DataFrame, opts: Options, backend: Backend | TileBackend | None = None, limit_bytes: int = 0) -> DataFrame:
    """px (image_id, h, w, y, x, r, g, b[, a]) enhanced: denoise, levels, enlarge, fit, chroma, detail, sharpen, colour, clip.

    Sizes are those of target(), for every option. The backend runs at the scale of both axes (or the root of the area's),
    then images are fitted. Alpha is enlarged to the same size by itself. Sharpening is done once. Images with a side over
    opts.tile (0: none has) or over kernels.MOST pixels, before or after, are cut into tiles with the margin that their results
    depend on, others are one tile; both have the values of the whole image. A TileBackend is given tiles of opts.tile that overlap, of an
    image mirrored by opts.tile_pad at its edges. Other backends than these, classical and nearest are worked on as pixels. An image whose
    result would take more than limit_bytes (0: no limit) as floats raises an error.
    """
    if limit_bytes > 0:
        px = memory_guard(px, limit_bytes, opts)
    if isinstance(backend, TileBackend):
        return _by_model(px, opts, backend)
    if backend is None and opts.backend in ("classical", "nearest"):
        return _by_tiles(px, opts)
    return _by_pixels(px, opts, backend)


def _by_pixels(px: DataFrame, opts: Options, backend: Backend | None) -> DataFrame:
    """The enhancement as a chain of DataFrame transforms.

    Alpha is joined. Radii grow with the enlargement, so there is a branch of the plan for each different enlargement. Images that are rows of
    arrays take the same chain in their rows (without alpha, and by backends that enlarge such rows).
    """
    if tilework.by_rows(px):
        return _chain_in_rows(px, opts, backend)
    rgb = px.select("image_id", "h", "w", "y", "x", *RGB)
    sizes = _sized(px.select("image_id", "h", "w").distinct(), opts)
    run = backend or BACKENDS[opts.backend]
    made = lambda size: F.greatest(F.lit(1), F.rint(F.col(size) * F.col("__scale")).cast("int"))
    off = (made("w") != F.col("out_w")) | (made("h") != F.col("out_h"))
    # Only the backends by name are known to give the rounded size.
    off = off if backend is None and opts.backend in ("classical", "nearest") else F.lit(True)
    kinds = sizes.groupBy("__scale", "__gain").agg(F.max("__ratio").alias("ratio"), F.max(off).alias("off")).orderBy("__scale", "__gain").collect()
    ratio = max((k["ratio"] for k in kinds), default=1.0)
    if opts.denoise > 0:
        rgb = near.denoise(rgb, RGB, opts.denoise_radius, opts.denoise)
    if opts.auto_levels > 0:
        rgb = color.auto_levels(rgb, strength=opts.auto_levels)
    to = sizes.select("image_id", F.col("out_w").alias("__to_w"), F.col("out_h").alias("__to_h"))

    def branch(scale: float, gain: float, fit: bool, of: DataFrame) -> DataFrame:
        d = run(of, scale)
        if fit:
            d = resample.resize_to(d.join(to, "image_id"), RGB, F.col("__to_w"), F.col("__to_h"), ratio).drop("__to_w", "__to_h")
        if opts.chroma_denoise > 0:
            d = near.chroma_denoise(d, opts.chroma_denoise * gain)
        if opts.detail > 0:
            d = near.detail_enhance(d, RGB, max(1, round(opts.detail_radius * gain / 4)), opts.detail_eps, opts.detail)
        if opts.sharpen > 0:
            d = near.unsharp(d, RGB, opts.sharpen, max(0.5, opts.sharpen_radius * gain / 4), opts.sharpen_threshold)
        return d

    if len(kinds) > 1:
        sized, names = _sized(rgb, opts), rgb.columns
        d = None
        for k in kinds:
            part = branch(k["__scale"], k["__gain"], k["off"], sized.where((F.col("__scale") == k["__scale"]) & (F.col("__gain") == k["__gain"])).select(*names))
            d = part if d is None else d.unionByName(part)
    else:
        k = kinds[0] if kinds else {"__scale": 1.0, "__gain": 1.0, "off": False}
        d = branch(k["__scale"], k["__gain"], k["off"], rgb)
    if opts.gamma != 1.0 or opts.contrast != 0.0 or opts.saturation != 1.0:
        d = color.adjust_color(d, opts.contrast, opts.saturation, opts.gamma)
    d = d.withColumns({c: color.clip01(F.col(c)) for c in RGB})
    if "a" in px.columns:
        a = target(px.select("image_id", "h", "w", "y", "x", "a"), opts).withColumns({"__to_w": F.col("out_w"), "__to_h": F.col("out_h")}).drop("out_w", "out_h", "notes")
        if opts.alpha_mode == "nearest":
            a = resample.nearest(a, F.col("__to_w"), F.col("__to_h"))
        else:
            a = resample.resize_to(a, ["a"], F.col("__to_w"), F.col("__to_h"), ratio).withColumn("a", color.clip01(F.col("a")))
        d = d.join(a.select("image_id", "y", "x", "a"), ["image_id", "y", "x"])
    return d


def _chain_in_rows(rows: DataFrame, opts: Options, backend: Backend | None) -> DataFrame:
    """_by_pixels for images as rows, scaled by opts.scale alone."""
    if opts.scale is None or opts.width or opts.height or opts.longest_side or "a" in rows.columns or (backend is None and opts.backend != "classical"):
        raise ValueError("rows of arrays are only scaled, without alpha, by the classical backend")
    d = rows.select("image_id", "h", "w", *RGB)
    if opts.denoise > 0:
        d = near.denoise(d, RGB, opts.denoise_radius, opts.denoise)
    if opts.auto_levels > 0:
        d = levelled(d, strength=opts.auto_levels)
    many = F.rint(F.col("w") * opts.scale) * F.rint(F.col("h") * opts.scale) > opts.max_pixels
    d = d.withColumn("w", F.when(many, F.raise_error(F.lit("rows of arrays aren't cut to max_pixels")).cast("int")).otherwise(F.col("w")))
    d = (backend or classical)(d, opts.scale)
    gain = max(1.0, opts.scale)
    d = near.chroma_denoise(d, opts.chroma_denoise * gain)
    d = near.detail_enhance(d, RGB, max(1, round(opts.detail_radius * gain / 4)), opts.detail_eps, opts.detail)
    d = near.unsharp(d, RGB, opts.sharpen, max(0.5, opts.sharpen_radius * gain / 4), opts.sharpen_threshold)
    return tilework.changed(d, RGB, lambda v: kernels.adjust(v, opts.contrast, opts.saturation, opts.gamma))


def levelled(rows: DataFrame, low: float = 0.5, high: float = 99.5, strength: float = 1.0) -> DataFrame:
    """color.auto_levels of images that are rows of arrays: the percentiles of an image are found in its row."""
    return tilework.changed(rows, RGB, lambda v: kernels.levels(v, strength, None, low, high))


def enhance_bytes(files: DataFrame, opts: Options, image_id: str = "image_id", content: str = "content") -> DataFrame:
    """(image_id, png, error): the images of a binary column enhanced, as PNG bytes, or why not. Grey images stay grey, and so does alpha where there is some.

    One plan from bytes to bytes; files are told apart by image_id, so that is unique.
    """
    px = decode.decode(files, image_id, content)
    out = None
    for grey in (True, False):
        for alpha in (True, False):
            some = px.where(F.col("error").isNull() & (F.col("mode").isin("L", "LA") == grey) & (F.col("a").isNotNull() == alpha)).select("image_id", "h", "w", "y", "x", *RGB, *(["a"] if alpha else []))
            made = images.encode_png(enhance(some, opts), grey)
            out = made if out is None else out.unionByName(made)
    return out.withColumn("error", F.lit(None).cast("string")).unionByName(px.where("error is not null").select("image_id", F.lit(None).cast("binary").alias("png"), "error"))


def summary(done: DataFrame) -> DataFrame:
    """Telemetry of finished images (src_w, dst_w, elapsed_ms, ...), rounded."""
    f: Column = sizing.scale_factor(F.col("src_w"), F.col("dst_w"))
    return done.withColumns({"scale": F.round(f, 4), "elapsed_ms": F.round("elapsed_ms", 2)})


def with_options(preset: str, **changes) -> Options:
    return replace(PRESETS[preset], **changes)
