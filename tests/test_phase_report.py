import numpy as np
from pyspark.sql import functions as F

from rasterloom.operators import neighbourhood, topology
from rasterloom.plans import phase


def hills(spark, h=20, w=18):
    """Three fields: hills and noise, a plain, and a column of one pixel."""
    r = np.random.default_rng(4)
    y, x = np.mgrid[0:h, 0:w]
    v = 0.3 + 0.5 * np.exp(-((y - 5) ** 2 + (x - 6) ** 2) / 6.0) + 0.4 * np.exp(-((y - 14) ** 2 + (x - 12) ** 2) / 1.5) + r.random((h, w)) / 12
    rows = [(0, h, w, i, j, float(v[i, j])) for i in range(h) for j in range(w)]
    rows += [(1, 6, 6, i, j, 0.5) for i in range(6) for j in range(6)] + [(2, 1, 1, 0, 0, 0.2)]
    return spark.createDataFrame(rows, "image_id long, h int, w int, y int, x int, v double")


def values(df, image):
    p = df.where(F.col("image_id") == image).toPandas()
    v = np.full((p.y.max() + 1, p.x.max() + 1), np.nan)
    v[p.y, p.x] = p.v
    return v


def test_report_equals_a_recount(spark):
    run = phase.reconstruct(hills(spark), 2.0, "v")
    found = {r.image_id: r for r in phase.report(run).collect()}
    assert set(found) == {0, 1, 2}
    for i, r in found.items():
        a, p, o = (values(d, i) for d in (run.assembled, run.plain, run.out))
        assert (r.out_h, r.out_w) == a.shape == (2 * r.h, 2 * r.w) and r.scale == 2.0 and r.bands == 3
        assert abs(r.residual_energy - np.abs(a - p).mean()) < 1e-9
        assert abs(r.suppressed_energy - np.abs(a - o).mean()) < 1e-9
        assert -1e-9 <= r.mean_coherence <= 1 + 1e-9
        for d, s in ((p, r.baseline), (o, r.candidate)):
            lives = []
            for sign in (-1, 1):
                _, birth, death = topology.merge_tree(sign * d)
                lives.append([x for x in (death - birth) if x > 0 and x >= r.tau])
            assert (s.peaks, s.pits, s.total) == (len(lives[0]), len(lives[1]), len(lives[0]) + len(lives[1])), (i, lives)
            assert abs(s.sum_persistence - sum(map(sum, lives))) < 1e-9
        base, now = round(r.baseline.sum_persistence, 6), round(r.candidate.sum_persistence, 6)
        assert r.matches == (now <= 1e-9 if base <= 0 else now <= base * 1.25)
        for points, n in ((run.suppressed, r.suppressed_peaks), (run.restored, r.restored_peaks)):
            assert points.where(F.col("image_id") == i).count() == n
    assert found[1].tau < 1e-9 and found[1].candidate.sum_persistence < 1e-9 and found[1].matches and found[0].tau > 0
    assert {r.image_id for r in run.out.select("image_id").distinct().collect()} == {0, 1, 2}


def test_report_without_topology_and_of_nothing(spark):
    run = phase.reconstruct(hills(spark), 1.5, "v", keep_topology=False)
    for r in phase.report(run).collect():
        assert r.tau is None and r.matches is None and r.candidate is None and r.suppressed_peaks is None and r.residual_energy >= 0
    empty = hills(spark).limit(0)
    assert phase.report(phase.reconstruct(empty, 2.0, "v")).count() == 0


def test_suppressed_and_restored_are_counted(spark):
    """A field with a peak too many is blended to its reference there; one with a peak too few is raised."""
    base = np.full((24, 24), 0.2)
    y, x = np.mgrid[0:24, 0:24]
    more = base + 0.6 * np.exp(-((y - 12) ** 2 + (x - 12) ** 2) / 3.0)
    frame = lambda v: spark.createDataFrame([(0, 24, 24, i, j, float(v[i, j])) for i in range(24) for j in range(24)], "image_id long, h int, w int, y int, x int, v double")
    tau = spark.createDataFrame([(0, 0.1)], "image_id long, tau double")
    points = topology.spurious(frame(more), frame(base), "v", tau)
    assert [(p.y, p.x) for p in points.collect()] == [(12, 12)]
    same = topology.suppress(frame(more), frame(base), "v", tau).orderBy("y", "x").collect()
    assert same == topology.suppress(frame(more), frame(base), "v", tau, points=points).orderBy("y", "x").collect()
    peaks = topology.extrema(frame(more), "v")
    gone = topology.lost(frame(base), peaks, "v", tau)
    assert gone.count() == 1
    up = topology.restore(frame(base), peaks, "v", tau, points=gone)
    assert abs(up.agg(F.max("v")).first()[0] - more.max()) < 1e-9
    assert topology.lost(frame(more), peaks, "v", tau).count() == 0


def test_smoothing_along_an_angle(spark):
    """Against a plain loop over steps."""
    r = np.random.default_rng(5)
    v, theta = r.random((7, 9)), r.random((7, 9)) * 3
    df = spark.createDataFrame([(0, 7, 9, i, j, float(v[i, j]), float(theta[i, j])) for i in range(7) for j in range(9)], "image_id long, h int, w int, y int, x int, v double, theta double")
    got = {(p.y, p.x): p.smooth for p in neighbourhood.orient_smooth(df, "v", "theta", 2).collect()}
    for i in range(7):
        for j in range(9):
            total = mass = 0.0
            for k in (-2, -1, 0, 1, 2):
                a = min(6, max(0, round(i + k * np.sin(theta[i, j]))))
                b = min(8, max(0, round(j + k * np.cos(theta[i, j]))))
                wt = np.exp(-k * k / 8)
                total, mass = total + wt * v[a, b], mass + wt
            assert abs(got[i, j] - total / mass) < 1e-9


def test_colour_gate(spark):
    """Guided and plain gates give whole images; without chroma detail both are the same."""
    df = hills(spark).where("image_id = 0").select("image_id", "h", "w", "y", "x", F.col("v").alias("r"), (F.col("v") * 0.7).alias("g"), (1 - F.col("v")).alias("b"))
    one = lambda **o: {(p.y, p.x): (p.r, p.g, p.b) for p in phase.enlarge_rgb(df, 2.0, keep_topology=False, **o).collect()}
    guided, plain = one(), one(chroma_guided=False)
    assert len(guided) == len(plain) == 40 * 36 and guided != plain
    off, also = one(chroma_detail=0.0), one(chroma_detail=0.0, chroma_guided=False)
    assert all(abs(a - b) < 1e-9 for k in off for a, b in zip(off[k], also[k]))
