import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import spectral, topology
from rasterloom.plans import catalogue, catalogue_jobs, catalogue_more, phase  # noqa: F401
from rasterloom.sources import tables

SF = "/root/testdata/sf0.001"


def one_by_one(values):
    """Pixels from the lowest; components by a union-find."""
    h, w = values.shape
    flat, root, died = values.ravel(), {}, {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in np.argsort(flat, kind="stable").tolist():
        y, x = divmod(i, w)
        near = {find(a * w + b) for a in range(max(0, y - 1), min(h, y + 2)) for b in range(max(0, x - 1), min(w, x + 2)) if a * w + b in root}
        eldest = min(near, key=lambda r: (flat[r], r), default=i)
        root[i] = eldest
        if not near:
            died[i] = flat.max()
        for r in near - {eldest}:
            root[r], died[r] = eldest, flat[i]
    return sorted((*divmod(i, w), flat[i], d) for i, d in died.items())


def fields(seed=1):
    r = np.random.default_rng(seed)
    smooth = np.add.outer(np.sin(np.arange(37) / 3), np.cos(np.arange(44) / 4))
    spiral = np.fromfunction(lambda y, x: (7 * y + 11 * x) % 29, (23, 31))
    return [r.random((1, 1)), r.random((1, 40)), r.random((17, 1)), r.random((8, 8)), np.floor(r.random((30, 41)) * 5), smooth, spiral, np.zeros((9, 12)), np.add.outer(np.arange(40.0), np.arange(25.0))]


def relation(spark, some):
    rows = [(k, *v.shape, y, x, float(v[y, x])) for k, v in enumerate(some) for y in range(v.shape[0]) for x in range(v.shape[1])]
    return spark.createDataFrame(rows, "image_id long, h int, w int, y int, x int, v double").repartition(6)


def found(df):
    out = {}
    for m in df.collect():
        out.setdefault(m.image_id, []).append((m.y, m.x, m.birth, m.death))
    return {k: sorted(v) for k, v in out.items()}


def test_merge_trees_equal_one_by_one():
    r = np.random.default_rng(2)
    for v in [*fields(), *(np.floor(r.random((12, 15)) * q) for q in (2, 3, 9) for _ in range(8))]:
        at, birth, death = topology.merge_tree(v)
        assert sorted(zip(*np.divmod(at, v.shape[1]), birth, death, strict=True)) == one_by_one(v)
    stack = r.random((50, 6, 7))
    at, birth, death = topology.merge_trees(stack)
    for k, v in enumerate(stack):
        own = at // 42 == k
        assert sorted(zip(*np.divmod(at[own] - 42 * k, 7), birth[own], death[own], strict=True)) == one_by_one(v)


@pytest.mark.parametrize("most", [1 << 20, 170])
def test_minima_of_tables(spark, most):
    some = fields()
    assert found(topology.minima(relation(spark, some), "v", most)) == {k: one_by_one(v) for k, v in enumerate(some)}
    assert topology.minima(relation(spark, some).limit(0), "v", most).count() == 0


def test_beyond_pooling(spark):
    """A field of more cells than are pooled, by tiles and without pooling."""
    v = np.random.default_rng(3).random((270, 260))
    yx = F.col("id")
    df = spark.range(v.size).select(F.lit(0).cast("long").alias("image_id"), F.lit(270).alias("h"), F.lit(260).alias("w"), F.floor(yx / 260).cast("int").alias("y"), (yx % 260).cast("int").alias("x"))
    df = df.join(spark.createDataFrame([(i, float(a)) for i, a in enumerate(v.ravel())], "i long, v double"), F.col("y") * 260 + F.col("x") == F.col("i")).drop("i")
    got = found(topology.minima(df, "v", 1 << 14))[0]
    at, birth, death = topology.merge_tree(v)
    assert got == sorted(zip(*np.divmod(at, 260), birth, death, strict=True))


def grid(rows, value):
    n = [max(getattr(r, c) for r in rows) + 1 for c in ("y", "x")]
    out = np.full(n, np.nan)
    for r in rows:
        out[r.y, r.x] = getattr(r, value)
    return out


def test_extrema_of_events(spark):
    v = grid(tables.event_raster(spark, SF).collect(), "v")
    want = set()
    for kind, sign in (("peak", -1), ("pit", 1)):
        full = np.zeros((64, 64))
        full[: v.shape[0], : v.shape[1]] = np.nan_to_num(sign * v)
        want |= {(kind, y, x, round(sign * b, 9), round(d - b, 9)) for y, x, b, d in one_by_one(full) if d > b}
    got = {(e.kind, e.y, e.x, round(e.value, 9), round(e.persistence, 9)) for e in catalogue.QUERIES["extrema_of_events"](spark, SF).collect()}
    assert got == want


def test_peaks_are_pooled_on_request(spark):
    v = np.random.default_rng(7).random((20, 30))
    df = relation(spark, [v])
    free = topology.extrema(df, "v", "peak", 0).collect()
    assert {(e.y, e.x, e.factor) for e in free} == {(y, x, 1) for y, x, b, d in one_by_one(-v) if d > b}
    blocks = np.array([[v[4 * a : 4 * a + 4, 4 * b : 4 * b + 4].max() for b in range(8)] for a in range(5)])
    got = topology.extrema(df, "v", "peak", 40).collect()
    assert {(e.y, e.x) for e in got} == {(min(4 * y + 2, 19), min(4 * x + 2, 29)) for y, x, b, d in one_by_one(-blocks) if d > b}


SIZES = [(8, 8), (9, 14), (1, 12), (60, 7)]


def waves(spark):
    r = np.random.default_rng(4)
    return relation(spark, [r.random(s) for s in SIZES])


def test_two_passes_equal_one(spark):
    px = waves(spark)
    one, two = (spectral.decompose(px, "v", most=m).toPandas().sort_values(["image_id", "band", "y", "x"], ignore_index=True) for m in (1 << 20, 40))
    assert len(one) == len(two) and all((one[c] - two[c]).abs().max() < 1e-12 for c in one.columns)
    whole = one.groupby(["image_id", "y", "x"]).b.sum().sort_index().to_numpy()
    told = px.toPandas().sort_values(["image_id", "y", "x"])
    # Bands and low pass add up to the field where the bands don't overlap beyond 1.
    assert np.abs(whole - told.v.to_numpy()).max() < 1e-9
    v = np.full((9, 14), np.nan)
    own = told[told.image_id == 1]
    v[own.y, own.x] = own.v
    g, _ = spectral.filter_bank(9, 14)
    want = np.fft.irfft2(np.fft.rfft2(v) * g[1], s=(9, 14))
    got = one[(one.image_id == 1) & (one.band == 1)].b.to_numpy().reshape(9, 14)
    assert np.abs(got - want).max() < 1e-12


def test_gradients_of_two_passes_equal_one(spark):
    parts = spectral.decompose(waves(spark), "v").withColumnRenamed("rx", "r").withColumn("amp", F.hypot("b", "r")).withColumn("theta", F.col("x") / 7.0)
    one, two = (spectral.phase_gradient(parts, m).toPandas().sort_values(["image_id", "band", "y", "x"], ignore_index=True) for m in (1 << 20, 40))
    assert len(one) == len(two) and all((one[c] - two[c]).abs().max() < 1e-9 for c in one.columns)
    own = one[(one.image_id == 0) & (one.band == 0)]
    b, r, a = (own[c].to_numpy().reshape(8, 8) for c in ("b", "r", "amp"))
    z = (b + 1j * r) / np.maximum(a, 1e-8)
    want = np.imag(np.conj(z) * np.fft.ifft2(2j * np.pi * np.fft.fftfreq(8)[None, :] * np.fft.fft2(z)))
    assert np.abs(own.gx.to_numpy().reshape(8, 8) - want).max() < 1e-9
