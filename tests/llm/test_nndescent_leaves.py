from functools import partial

import numpy as np
from pyspark.sql import functions as F

from rasterloom.llm import nndescent


def test_recall_over_many_leaves_and_bounded_groups(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "forest", partial(nndescent.forest, leaf=64))
    monkeypatch.setattr(nndescent, "ASKING", 50)
    sizes, score = [], nndescent.salts

    def counted(asked):
        out = score(asked)
        sizes.append(out.agg(F.max("salts")).first()[0] or 0)
        return out

    monkeypatch.setattr(nndescent, "salts", counted)
    r = np.random.default_rng(8)
    x = r.normal(size=(2000, 8)) * r.uniform(0.5, 2, size=(2000, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for g in nndescent.nearest(df, F.col("vec_id") % 20 == 0, 10).collect():
        got.setdefault(g.query_id, set()).add(g.vec_id)
    assert len(got) == 100
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(found & set(np.argsort(-s)[:10].tolist()))
    print("recall", hits / 1000, "copies of a block at most", max(sizes))
    assert hits / 1000 >= 0.95
    assert max(sizes) > 1
