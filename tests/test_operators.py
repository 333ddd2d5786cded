import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import models, neighbourhood, resample, spectral, tiling, topology, transport
from rasterloom.plans import phase, pipeline
from rasterloom.sources import images, tables
from rasterloom.streaming import jobs


def field(spark, v, image_id=0):
    h, w = v.shape
    rows = [(image_id, h, w, y, x, float(v[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id long, h int, w int, y int, x int, v double").coalesce(2)


def back(df, value="v"):
    p = df.select("h", "w", "y", "x", value).toPandas()
    out = np.full((p.h.iloc[0], p.w.iloc[0]), np.nan)
    out[p.y, p.x] = p[value]
    assert len(p) == out.size
    return out


def wave(h=24, w=32):
    y, x = np.mgrid[:h, :w]
    return 0.5 + 0.2 * np.sin(2 * np.pi * x / 16) + 0.1 * np.cos(2 * np.pi * y / 12)


def box(v, r):
    for axis in (0, 1):
        k = min(r, v.shape[axis] - 1)
        pad = [(k, k) if a == axis else (0, 0) for a in (0, 1)]
        p = np.pad(v, pad, mode="edge")
        v = np.mean([np.take(p, range(i, i + v.shape[axis]), axis) for i in range(2 * k + 1)], axis=0)
    return v


@pytest.mark.parametrize("r", [1, 4, 40])
def test_box(spark, r):
    v = wave()
    assert np.allclose(back(neighbourhood.box_blur(field(spark, v), ["v"], r)), box(v, r))


def test_guided(spark):
    v = wave()
    m, mm = box(v, 3), box(v * v, 3)
    a = (mm - m * m) / (mm - m * m + 1e-3)
    want = box(a, 3) * v + box(m - a * m, 3)
    assert np.allclose(back(neighbourhood.guided_filter(field(spark, v), ["v"], ["v"], 3, 1e-3)), want)


def test_neutral_steps_change_nothing(spark):
    d = field(spark, wave())
    assert neighbourhood.gaussian_blur(d, ["v"], 0) is d and neighbourhood.detail_enhance(d, ["v"], strength=0) is d and neighbourhood.unsharp(d, ["v"], 0) is d


def test_lanczos(spark):
    flat = np.full((9, 7), 0.42)
    assert np.allclose(back(resample.resize(field(spark, flat), ["v"], F.lit(20), F.lit(5))), 0.42)
    v = wave()
    assert np.allclose(back(resample.resize(field(spark, v), ["v"], F.col("w"), F.col("h"))), v)
    big = back(resample.resize_chained(field(spark, v), ["v"], 3.0))
    y, x = (np.mgrid[: 24 * 3, : 32 * 3] + 0.5) / 3 - 0.5
    want = 0.5 + 0.2 * np.sin(2 * np.pi * x / 16) + 0.1 * np.cos(2 * np.pi * y / 12)
    assert np.abs(big - want)[12:-12, 12:-12].max() < 5e-3
    t = resample.lanczos_taps(spark, 30, 77).groupBy("o").agg(F.sum("w").alias("w")).toPandas()
    assert len(t) == 77 and np.allclose(t.w, 1)


def test_nearest(spark):
    v = np.arange(35.0).reshape(5, 7)
    got = back(resample.nearest(field(spark, v), F.lit(9), F.lit(13)))
    assert (got == v[np.minimum(np.arange(13) * 5 // 13, 4)][:, np.minimum(np.arange(9) * 7 // 9, 6)]).all()


@pytest.mark.parametrize("total", [1, 7, 64, 100, 513])
@pytest.mark.parametrize("tile,overlap", [(0, 4), (16, 4), (64, 16), (128, 0)])
def test_ranges_cover(spark, total, tile, overlap):
    d = spark.createDataFrame([(total, tile, overlap)], "n int, t int, o int")
    r = sorted((x.start, x.end) for x in tiling.axis_ranges(d, "n", "t", "o").collect())
    assert r[0][0] == 0 and r[-1][1] == total and len(set(r)) == len(r)
    assert all(b[0] <= a[1] for a, b in zip(r, r[1:])) and all(b - a == (min(tile, total) or total) for a, b in r)


@pytest.mark.parametrize("tile,overlap", [(8, 2), (11, 3), (64, 8)])
def test_tiles_blend_to_the_whole(spark, tile, overlap):
    v = wave(20, 31)
    assert np.allclose(back(tiling.blend(tiling.cut_fixed(field(spark, v), tile, overlap), ["v"], overlap)), v)


def test_merge_tree():
    at, birth, death = topology.merge_tree(np.array([[0.6, 0.6, 0.6], [0.0, 0.5, 0.2], [0.6, 0.6, 0.6]]))
    assert dict(zip(at.tolist(), (death - birth).round(6).tolist())) == {3: 0.6, 5: 0.3}


def test_peaks_survive_pooling(spark):
    v = np.full((32, 32), 0.4)
    v[16, 16] = 0.9
    p = topology.extrema(field(spark, v), "v", "peak", 64).collect()
    assert len(p) == 1 and p[0].value == 0.9 and abs(p[0].persistence - 0.5) < 1e-12 and abs(p[0].y - 16) <= p[0].factor


def test_suppress_and_restore(spark):
    y, x = np.mgrid[:24, :24]
    bump = 0.4 + 0.5 * np.exp(-((y - 12) ** 2 + (x - 12) ** 2) / 8)
    flat = np.full((24, 24), 0.4)
    tau = spark.createDataFrame([(0, 0.05)], "image_id long, tau double")
    out = back(topology.suppress(field(spark, bump), field(spark, flat), "v", tau))
    assert out[12, 12] < 0.45
    peaks = spark.createDataFrame([(0, 12.0, 12.0, 0.9)], "image_id long, y double, x double, value double")
    assert abs(back(topology.restore(field(spark, flat), peaks, "v", tau))[12, 12] - 0.9) < 1e-9
    assert np.allclose(back(topology.restore(field(spark, bump), peaks, "v", tau)), bump)


def test_bands_sum_and_identity(spark):
    v = wave()
    parts = spectral.decompose(field(spark, v), "v", bands=1)
    assert np.allclose(back(parts.groupBy("image_id", "h", "w", "y", "x").agg(F.sum("b").alias("v"))), v)
    one = back(transport.transport(phase.analyse(field(spark, v)).where("band = 0"), 1.0))
    want = back(phase.analyse(field(spark, v)).where("band = 0"), "b")
    assert np.abs(one - (want - want.mean())).max() < 1e-6


def test_phase_carries_a_plane_wave(spark):
    x = np.mgrid[:16, :64][1]
    v = 0.5 + 0.4 * np.cos(2 * np.pi * x * 8 / 64)
    got = back(phase.enlarge(field(spark, v), 2.0, keep_topology=False))
    u = (np.arange(128) + 0.5) / 2 - 0.5
    assert np.abs(got - (0.5 + 0.4 * np.cos(2 * np.pi * u * 8 / 64)))[:, 8:-8].max() < 2e-2
    with pytest.raises(ValueError):
        phase.plan(10, 10, 0.5)


def test_png_round_trip(spark, tmp_path):
    px = tables.synthetic(spark, 12).withColumn("a", F.lit(0.5))
    assert images.write_files(images.encode_png(px), str(tmp_path)) == 1
    got = images.load(spark, str(tmp_path)).toPandas().sort_values(["y", "x"])
    want = px.toPandas().sort_values(["y", "x"])
    for c in "rgba":
        assert np.abs(got[c].to_numpy(float) - want[c].to_numpy()).max() <= 0.5 / 255 + 1e-9
    files = spark.read.format("binaryFile").load(str(tmp_path))
    p = images.probe(files).first()
    assert (p.width, p.height, p.format, p.mode, p.has_alpha, p.error) == (12, 12, "PNG", "RGBA", True, None)
    assert images.list_files(spark, [str(tmp_path)]).count() == 1


def test_model_tiles(spark):
    px = tables.synthetic(spark, 20)
    opener = lambda: lambda x: np.repeat(np.repeat(x, 2, axis=2), 2, axis=3) * 255
    out = models.on_tiles(px, opener, 2, 12, 2, 3, 8)
    assert np.abs(back(out, "g") - back(resample.nearest(px, F.lit(40), F.lit(40)), "g")).max() < 1e-5


def test_providers():
    assert models.normalize_provider("AUTO") is None and models.normalize_provider("trt") == "TensorrtExecutionProvider"
    assert models.resolve_providers(None, ["CPUExecutionProvider", "CUDAExecutionProvider"]) == ["CUDAExecutionProvider", "CPUExecutionProvider"]
    assert models.resolve_providers("auto", list(reversed(models.AUTO))) == models.AUTO and models.normalize_provider("openvino-cpu") == "OpenVINOExecutionProvider"
    with pytest.raises(ValueError):
        models.normalize_provider("abacus")


def test_options_and_guard(spark):
    o = pipeline.Options.of({"scale": 2, "colour": "odd"})
    assert o.scale == 2 and o.extra == {"colour": "odd"}
    with pytest.raises(Exception, match="over the limit"):
        pipeline.memory_guard(spark.createDataFrame([(1000, 1000)], "w int, h int"), 1000).collect()
    px = tables.synthetic(spark, 10)
    assert back(pipeline.enhance(px, pipeline.Options(width=15, detail=0.0)), "r").shape == (15, 15)
    assert back(pipeline.enhance(px, pipeline.Options(scale=2.0, detail=0.0, backend="phase")), "r").shape == (20, 20)
    assert math.isclose(back(pipeline.enhance(px, pipeline.Options(scale=2.0, detail=0.0, backend="nearest")), "b")[3, 5], back(px, "b")[1, 2])


def test_streaming_admission(spark, tmp_path):
    rows = [(1, 1, "submit"), (1, 2, "submit"), (1, 3, "submit"), (2, 4, "submit")]
    spark.createDataFrame(rows, "queue long, job_id long, kind string").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    spark.createDataFrame([(1, 1, "finish"), (1, 5, "submit")], "queue long, job_id long, kind string").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    s = spark.readStream.schema("queue long, job_id long, kind string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = jobs.admissions(s, 2).writeStream.format("memory").queryName("admitted").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.job_id: r.admitted for r in spark.table("admitted").collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True}
