import numpy as np
from pyspark.sql import functions as F

from rasterloom.llm import nndescent


def brute(rows, k):
    ok = {i: np.asarray(v, np.float64) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(ok)
    x = np.stack([ok[i] for i in ids])
    out = {}
    for q in ids:
        if q % 20 == 0:
            s = x @ ok[q]
            out[q] = [(i, round(v, 9)) for v, i in sorted((-round(v, 12), i) for v, i in zip(s, ids) if i != q)][:k]
    return out


def test_recall_and_rules(spark):
    r = np.random.default_rng(4)
    x = np.round(r.normal(size=(3000, 8)) * r.uniform(0.5, 2, size=(3000, 1)), 3).astype(np.float32)
    x[500:900] = x[500]  # one vector many times
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, []), (5040, [0.0] * 8), (5060, [float("nan")] * 8), (5080, [1.0, None] * 4), (None, [1.0] * 8), (5100, [1.0])]
    rows += rows[:3]
    df = spark.createDataFrame([(*x, "b") for x in rows], "vec_id long, embedding array<float>, block string")
    got = {}
    for g in nndescent.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(g.query_id, []).append((g.rank, g.vec_id, g.score))
    want = brute(rows, 20)
    assert set(got) == set(want)
    hits = 0
    for q, w in want.items():
        g = sorted(got[q])
        assert [a for a, _, _ in g] == list(range(1, 21)) and all(b >= c - 1e-12 for (_, _, b), (_, _, c) in zip(g, g[1:]))
        hits += len({b for _, b, _ in g} & {i for i, _ in w})
    assert hits / (20 * len(want)) >= 0.95
    assert [b for _, b, _ in sorted(got[600])][:5] == [i for i, _ in want[600]][:5]


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [1.0, 2.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, nndescent.nearest(df, F.col("vec_id") % 20 == 0).collect()))
    assert got == [(0, 1, 20, 5.0), (0, 2, 1, 4.0), (20, 1, 0, 5.0), (20, 2, 1, 4.0)]
    assert nndescent.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
