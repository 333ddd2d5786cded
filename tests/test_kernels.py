import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import kernels, models, percentiles, tilework
from rasterloom.plans import pipeline

from .test_pipeline_fitted import picture

OPTIONS = {
    "quality": pipeline.with_options("quality", scale=3.0, sharpen=0.4, gamma=1.2, contrast=0.1, saturation=1.3),
    "fitted": pipeline.Options(width=17, height=9, detail=0.3, auto_levels=0.5, chroma_denoise=1.0),
    "nearest": pipeline.Options(scale=2.5, backend="nearest", alpha_mode="nearest", max_pixels=300),
}
FAST = pipeline.with_options("fast", sharpen=0.3)
ORDER = ["image_id", "y", "x"]


def sorted_pixels(df):
    return df.toPandas().sort_values(ORDER, ignore_index=True)


def equal(a, b):
    assert set(a.columns) == set(b.columns) and len(a) == len(b)
    for c in a.columns:
        assert (a[c] - b[c]).abs().max() < 1e-9, c


@pytest.mark.parametrize("name", list(OPTIONS))
def test_arrays_equal_pixels(spark, name):
    px = picture(spark, [(7, 9), (12, 5), (1, 3)])
    equal(sorted_pixels(pipeline.enhance(px, OPTIONS[name])), sorted_pixels(pipeline._by_pixels(px, OPTIONS[name], None)))


TILED = {
    "quality": pipeline.with_options("quality", scale=2.0, sharpen=0.4, gamma=1.2, contrast=0.1, saturation=1.3),
    "five": pipeline.Options(scale=5.0, detail=0.3, sharpen=0.3),
    "squeezed": pipeline.Options(width=23, height=140, detail=0.3, chroma_denoise=1.0),
    "shrunk": pipeline.Options(scale=0.4, detail=0.3, auto_levels=0.5),
    "nearest": pipeline.Options(scale=2.5, backend="nearest", alpha_mode="nearest", detail=0.2, max_pixels=9_000),
}


@pytest.mark.parametrize("name", list(TILED))
def test_tiles_equal_whole(spark, name):
    px = picture(spark, [(37, 53), (61, 8), (1, 70), (20, 20)])
    whole = sorted_pixels(pipeline.enhance(px, pipeline.replace(TILED[name], tile=0)))
    for tile in (9, 40) if name == "quality" else (11,):
        equal(sorted_pixels(pipeline.enhance(px, pipeline.replace(TILED[name], tile=tile))), whole)


def test_large_images_are_tiles(spark, monkeypatch):
    px = picture(spark, [(37, 53), (9, 8)])
    opts = pipeline.replace(FAST, auto_levels=0.4, denoise=0.05)
    whole = sorted_pixels(pipeline.enhance(px, opts))
    monkeypatch.setattr(kernels, "MOST", 30 * 30)
    equal(sorted_pixels(pipeline.enhance(px, opts)), whole)
    assert pipeline.enhance(px.limit(0), opts).count() == 0


def test_tile_rows(spark):
    px = picture(spark, [(11, 6), (4, 5)])
    rows = tilework.tile_rows(tilework.cut_with_margin(px, F.lit(5), F.lit(2)), ["r", "a"]).collect()
    assert len(rows) == 3 * 2 + 1
    grid = {(p.image_id, p.y, p.x): p.r for p in px.collect()}
    for t in rows:
        assert (t.y0, t.y1, t.x0, t.x1) == (max(0, t.ty * 5 - 2), min(t.h, t.ty * 5 + 7), max(0, t.tx * 5 - 2), min(t.w, t.tx * 5 + 7))
        assert t.r == [grid[t.image_id, y, x] for y in range(t.y0, t.y1) for x in range(t.x0, t.x1)]


def test_halved_for_want_of_memory():
    v = np.random.default_rng(1).random((3, 1, 90, 70))
    stages = [kernels.Near(90, 70, 4, lambda a: kernels.box(a, 2, 2)), kernels.Resize(90, 70, 180, 100)]
    (part, want), = kernels.worked(v, (0, 90, 0, 70), stages, (0, 180, 0, 100))
    seen = []

    def tight(a):
        seen.append(a[0].size)
        if a[0].size > 2_000:
            raise MemoryError
        return kernels.box(a, 2, 2)

    got = np.full_like(want, np.nan)
    parts = list(kernels.worked(v, (0, 90, 0, 70), [kernels.Near(90, 70, 4, tight), stages[1]], (0, 180, 0, 100)))
    for at, out in parts:
        kernels.cropped(got, part, at)[...] = out
    assert len(parts) > 3 and max(seen) > 2_000 and np.abs(got - want).max() < 1e-12
    with pytest.raises(MemoryError):
        list(kernels.worked(v, (0, 90, 0, 70), [kernels.Near(90, 70, 0, lambda a: (_ for _ in ()).throw(MemoryError()))], (0, 90, 0, 70)))


@pytest.mark.parametrize("h,w", [(5_000, 50), (1, 250_000)])
def test_memory_of_long_images(h, w):
    v = np.random.default_rng(1).random((3, 1, h, w))
    tracemalloc.start()
    stages = kernels.enlarging(FAST, h, w, 2 * h, 2 * w, 2.0)
    (_, out), = kernels.worked(v, (0, h, 0, w), stages, (0, 2 * h, 0, 2 * w))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.shape == (3, 1, 2 * h, 2 * w) and peak < 200e6


def doubling(most=10**9, align=1):
    def opener():
        def process(x):
            assert x.shape[2] % align == 0 and x.shape[3] % align == 0
            if max(x.shape[2:]) > most:
                raise MemoryError
            return x.repeat(2, axis=2).repeat(2, axis=3)

        return process

    return opener


@pytest.mark.parametrize("tile,overlap,pad,most", [(12, 3, 2, 10**9), (40, 8, 0, 20), (0, 4, 4, 10**9), (16, 20, 9, 9)])
def test_model_tiles(spark, tile, overlap, pad, most):
    px = picture(spark, [(37, 53), (9, 8), (1, 30)])
    opts = pipeline.Options(scale=2.0, backend="nearest", tile=tile, tile_overlap=overlap, tile_pad=pad, detail=0.3, sharpen=0.2)
    got = pipeline.enhance(px, opts, pipeline.TileBackend(doubling(most, 4), 2, 4, 4))
    want = sorted_pixels(pipeline.enhance(px, pipeline.replace(opts, tile=0)))
    # The model works on floats.
    got = sorted_pixels(got)
    assert set(got.columns) == set(want.columns) and len(got) == len(want)
    assert all((got[c] - want[c]).abs().max() < 2e-6 for c in "rgb") and (got["a"] - want["a"]).abs().max() < 2.0


def test_overlap_and_pad_have_effect(spark):
    """A model that shades each tile by the place in it shows where tiles lie."""
    px = picture(spark, [(30, 30)])

    def opener():
        def process(x):
            out = np.zeros((1, 3, x.shape[2] * 2, x.shape[3] * 2))
            out[...] = np.linspace(0, 1, out.shape[3])
            return out

        return process

    seen = []
    for tile, overlap, pad in [(12, 3, 2), (12, 3, 0), (12, 0, 2), (20, 3, 2)]:
        opts = pipeline.Options(scale=2.0, tile=tile, tile_overlap=overlap, tile_pad=pad, detail=0.0)
        seen.append(sorted_pixels(pipeline.enhance(px.drop("a"), opts, pipeline.TileBackend(opener, 2)))["r"].to_numpy())
    assert all(np.abs(a - b).max() > 0.01 for i, a in enumerate(seen) for b in seen[:i])


def test_model_is_fitted_and_shrunk_before(spark):
    # Of low contrast: beyond 0..1 a model's output would be taken for signed.
    px = picture(spark, [(20, 30)]).withColumns({c: 0.4 + 0.2 * F.col(c) for c in "rgb"})
    out = pipeline.enhance(px, pipeline.Options(scale=1.5, detail=0.0, pre_downscale=False), pipeline.TileBackend(doubling(), 2))
    assert out.count() == 30 * 45
    out = pipeline.enhance(px, pipeline.Options(scale=1.0, detail=0.0, pre_downscale=True, alpha_mode="nearest"), pipeline.TileBackend(doubling(), 2))
    small = sorted_pixels(pipeline.enhance(px, pipeline.Options(scale=0.5, detail=0.0)))["r"].to_numpy().reshape(10, 15)
    assert np.abs(sorted_pixels(out)["r"].to_numpy().reshape(20, 30) - small.repeat(2, 0).repeat(2, 1)).max() < 1e-6


def test_percentiles(spark):
    r = np.random.default_rng(5)
    groups = {0: r.random(5_000), 1: np.full(70, 0.25), 2: np.array([3.0]), 3: np.concatenate([np.zeros(4_000), r.normal(size=3), [1e9]]), 4: r.integers(0, 4, 999) / 3, 5: r.normal(size=2)}
    rows = [(k, float(v)) for k, g in groups.items() for v in g] + [(0, None), (6, None), (0, float("nan"))]
    df = spark.createDataFrame(rows, "image_id long, v double").repartition(7)
    at = {"a": 0.005, "b": 0.5, "c": 0.995, "d": 1.0, "e": 0.0, "f": 1 / 3}
    got = {g.image_id: g for g in percentiles.percentiles(df, "v", at).collect()}
    assert set(got) == set(groups)
    for k, g in groups.items():
        for n, q in at.items():
            want = np.percentile(g, 100 * q)
            assert abs(got[k][n] - want) <= 1e-12 * max(1, abs(want)), (k, n)


def test_own_feather_is_that_of_tiles(spark):
    from rasterloom.operators import tiling

    d = spark.range(10, 40).select(tiling.feather(F.col("id"), F.lit(10), F.lit(40), F.lit(40), F.lit(7)).alias("w"))
    assert np.allclose([r.w for r in d.collect()], models._feather(10, 40, 40, 7))
