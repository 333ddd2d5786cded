"""Queries over images that are rows of arrays: pixels are neither shuffled nor sorted, whatever the number of parts."""

import pytest
from pyspark.sql import functions as F

from rasterloom.operators import kernels, neighbourhood, resample, tilework, tiling, topology
from rasterloom.plans import catalogue, catalogue_jobs, catalogue_more, pipeline  # noqa: F401
from rasterloom.sources import encode, tables

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def lean(spark, name):
    found = plan(spark, name)
    for what in ("Window", "Sort ", "Join", "InPandas", "ObjectHashAggregate"):
        assert what not in found, found
    # Parts are dealt out by a number that adaptive execution keeps, and partial results of images may meet.
    assert "REPARTITION_BY_NUM" in found and found.count("Exchange") <= 2, found


def test_pipeline_pixels(spark):
    lean(spark, "pipeline_pixels")
    with pytest.raises(ValueError):
        pipeline._by_pixels(tables.part_rows(spark, SF).drop("a"), pipeline.Options(width=9), None)


def test_png_roundtrip(spark):
    lean(spark, "png_roundtrip")


def test_png_pixels(spark):
    lean(spark, "png_pixels")


def test_resample_3x_chained(spark):
    lean(spark, "resample_3x_chained")


def test_denoise(spark):
    lean(spark, "denoise")


def test_detail(spark):
    lean(spark, "detail")


def test_alpha_resample(spark):
    lean(spark, "alpha_resample")


def test_auto_levels(spark):
    lean(spark, "auto_levels")


def test_dft_rows(spark):
    lean(spark, "dft_rows")


def test_phase_transport(spark):
    lean(spark, "phase_transport")


def test_peaks_of_parts(spark):
    px, rows = tables.part_images(spark, SF), tables.part_rows(spark, SF)
    for kind in ("peak", "pit"):
        names = ["image_id", "kind", "y", "x", "value", "persistence", "factor"]
        got, want = (topology.extrema(d, "g", kind).select(names) for d in (rows, px))
        assert want.count() == got.count() > 0 and want.exceptAll(got).count() == 0
    with pytest.raises(Exception, match="aren't pooled"):
        topology.extrema(rows, "g", most=63).collect()
    assert "ty#" not in plan(spark, "peaks_of_parts")  # pixels were dealt out by tile


def test_rows_of_several_sizes(spark):
    sizes = [(0, 3, 5), (1, 1, 1), (2, 3, 5), (3, 7, 2)]
    rows = spark.createDataFrame([(i, h, w, *([((k * (i + 3 + c)) % 11) / 11 for k in range(h * w)] for c in range(3))) for i, h, w in sizes], "image_id long, h int, w int, r array<double>, g array<double>, b array<double>").coalesce(1)
    px = tilework.as_pixels(rows, ["r", "g", "b"])
    for change in (lambda d: resample.resize_chained(d, ["r", "g", "b"], 3.0), lambda d: neighbourhood.unsharp(d, ["r", "g", "b"], 0.8), lambda d: neighbourhood.chroma_denoise(d, 1.5), lambda d: neighbourhood.denoise(d, ["r", "g", "b"])):
        got = {(p.image_id, p.y, p.x): (p.h, p.w, p.r, p.g, p.b) for p in tilework.as_pixels(change(rows), ["r", "g", "b"]).collect()}
        want = {(p.image_id, p.y, p.x): (p.h, p.w, p.r, p.g, p.b) for p in change(px).collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert kernels.MOST > tilework.STACK


@pytest.mark.parametrize("fmt", ["PNG", "JPEG", "TIFF"])
def test_encoded_rows(spark, fmt):
    rows = tables.part_rows(spark, SF, 12)
    for strip in (encode.STRIP, 96):
        got, want = ({f.image_id: (f.format, bytes(f.content), f.error) for f in encode.encode(d, fmt, strip=strip).collect()} for d in (rows, tilework.as_pixels(rows, ["r", "g", "b", "a"])))
        assert got == want and got
    with pytest.raises(ValueError):
        encode.encode(rows, fmt, gray=True)


def test_encoded_headers(spark):
    found = plan(spark, "encoded_headers")
    assert "ObjectHashAggregate" not in found and "Sort " not in found, found


@pytest.mark.parametrize("name", ["feather_blend", "tiled_equals_whole"])
def test_blended_rows(spark, name):
    lean(spark, name)


def test_blended_rows_equal_blend(spark):
    rows = tables.part_rows(spark, SF, 13)
    px = tilework.as_pixels(rows, ["r", "g"])
    for tile, overlap in ((6, 2), (5, 1), (4, 3), (0, 2), (20, 2)):
        shade = tiling.cut_fixed(px, tile, overlap).withColumns({c: F.col(c) + 0.01 * (F.col("tx") + 2 * F.col("ty")) for c in ("r", "g")})
        want = {(p.image_id, p.y, p.x): (p.r, p.g) for p in tiling.blend(shade, ["r", "g"], overlap).collect()}
        done = tiling.blended_rows(rows, ["r", "g"], tile, overlap, lambda v, ty, tx: v + 0.01 * (tx + 2 * ty))
        got = {(p.image_id, p.y, p.x): (p.r, p.g) for p in tilework.as_pixels(done, ["r", "g"]).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
