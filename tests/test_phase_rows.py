"""The phase method on images that are rows of arrays gives what it gives on relations of pixels, without a shuffle of pixels."""

import pytest
from pyspark.sql import functions as F

from rasterloom.functions import color
from rasterloom.operators import tilework
from rasterloom.plans import catalogue, catalogue_jobs, phase  # noqa: F401
from rasterloom.sources import tables

SF = "/root/testdata/sf0.001"


def hills(spark, h=20, w=18):
    """Three images with several peaks each, a flat one among them, of which one has another size."""
    rows = []
    for i, (n, m) in enumerate([(h, w), (h, w), (9, 13)]):
        v = [0.4 if i == 1 else 0.5 + 0.3 * ((7 * y * y + 5 * x + 3 * y * x) % 29) / 29 - 0.2 * ((y + 2 * x) % 7) / 7 for y in range(n) for x in range(m)]
        rows.append((i, n, m, v, v[::-1], [0.5 * a for a in v]))
    return spark.createDataFrame(rows, "image_id long, h int, w int, r array<double>, g array<double>, b array<double>")


def same(a, b, keys):
    cols = sorted(a.columns)
    a, b = (sorted(map(tuple, d.select(*keys, *(c for c in cols if c not in keys)).collect())) for d in (a, b))
    assert len(a) == len(b) > 0
    for p, q in zip(a, b, strict=True):
        assert all(x == pytest.approx(y, abs=1e-9) if isinstance(x, float) else x == y for x, y in zip(p, q, strict=True)), (p, q)


def test_rows_equal_pixels(spark):
    rows = hills(spark)
    px = tilework.as_pixels(rows, ["r", "g", "b"])
    at = ["image_id", "y", "x"]
    same(phase.enlarge(rows, 2.0, "r"), phase.enlarge(px, 2.0, "r"), at)
    same(phase.enlarge_rgb(rows, 1.5, keep_topology=False), phase.enlarge_rgb(px, 1.5, keep_topology=False), at)
    names = ["image_id", "h", "w", "out_h", "out_w", "scale", "bands", "mean_coherence", "residual_energy", "suppressed_energy", "suppressed_peaks", "restored_peaks", "matches", "tau"]
    flat = [*names, *(F.col(f"{c}.{n}").alias(f"{c}_{n}") for c in ("baseline", "candidate") for n in ("peaks", "pits", "total", "sum_persistence")), F.round(F.col("candidate.spectrum")[0], 9).alias("first"), F.size("candidate.spectrum").alias("kept")]
    some = "image_id <> 1"  # the tau of a flat image is 0, so that rounding errors are counted
    same(phase.report_rows(rows, 2.0, "r").where(some).select(*flat), phase.report(phase.reconstruct(px, 2.0, "r")).where(some).select(*flat), ["image_id"])


def test_rows_are_bounded(spark):
    with pytest.raises(Exception, match="more than 100 pixels"):
        phase.enlarge(hills(spark), 2.0, "r", max_pixels=100).collect()


def test_source_rows(spark):
    names = ["r", "g", "b", "a"]
    px = tables.part_images(spark, SF)
    rows = tilework.as_pixels(tables.part_rows(spark, SF), names).select(px.columns)
    assert px.exceptAll(rows).count() == 0 and rows.count() == px.count()
    luma = tilework.as_pixels(color.luminance_rows(tables.part_rows(spark, SF), "v"), ["v"])
    assert px.withColumn("v", color.luminance()).select(luma.columns).exceptAll(luma).count() == 0


@pytest.mark.parametrize("name", ["phase_enlarge", "phase_enlarge_rgb", "phase_report"])
def test_no_shuffle_of_pixels(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") <= 2, plan  # parts are dealt out, and partial results of images
