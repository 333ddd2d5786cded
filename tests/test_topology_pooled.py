import numpy as np
from pyspark.sql import functions as F

from rasterloom.operators import topology


def field(spark, v):
    h, w = v.shape
    rows = [(0, h, w, y, x, float(v[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id long, h int, w int, y int, x int, v double")


def bump(n, cy, cx):
    y, x = np.mgrid[:n, :n]
    return 0.1 + 0.8 * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / 40)


def test_peaks_that_move_by_a_block_stay(spark):
    """On an image pooled by 5, a peak two pixels off that falls into the next block still has its partner."""
    a, b = field(spark, bump(96, 49, 47)), field(spark, bump(96, 51, 47))
    tau = topology.persistence_threshold(a, "v", 0.18)
    peaks = topology.extrema(a, "v", "peak", 400).collect()
    assert {p.factor for p in peaks} == {5}
    assert abs(peaks[0].y - topology.extrema(b, "v", "peak", 400).first().y) == 5
    out = topology.suppress(b, a, "v", tau, most=400)
    moved = out.join(b.withColumnRenamed("v", "was"), ["image_id", "y", "x"]).select(F.max(F.abs(F.col("v") - F.col("was")))).first()[0]
    assert moved == 0
    lone = topology.suppress(b, field(spark, np.full((96, 96), 0.1)), "v", tau, most=400)
    assert lone.agg(F.max("v")).first()[0] < 0.85  # without a partner it is blended away


def test_restore_looks_as_far_as_the_pooling_moves_peaks(spark):
    a = field(spark, bump(96, 49, 47))
    tau = topology.persistence_threshold(a, "v", 0.18)
    peaks = topology.extrema(a, "v", "peak", 100).select("image_id", "y", "x", "value", "factor")
    assert peaks.first().factor == 10
    same = topology.restore(a, peaks, "v", tau).join(a.withColumnRenamed("v", "was"), ["image_id", "y", "x"])
    assert same.select(F.max(F.abs(F.col("v") - F.col("was")))).first()[0] < 1e-12


def test_rounds_over_tiles_are_not_broadcast(spark):
    px = spark.range(40 * 40).selectExpr("0L AS image_id", "40 AS h", "40 AS w", "CAST(id DIV 40 AS INT) AS y", "CAST(id % 40 AS INT) AS x", "CAST(hash(id) % 1000 AS DOUBLE) AS v")
    assert "SortMergeJoin" in topology.minima(px, "v", 100)._jdf.queryExecution().executedPlan().toString()
