import numpy as np
from pyspark.sql import functions as F

from rasterloom.llm import nndescent


def vectors():
    r = np.random.default_rng(12)
    centres = r.normal(size=(60, 32)) * 2
    x = np.concatenate([r.normal(size=(10_000, 32)), centres[r.integers(0, 60, 9_000)] + 0.3 * r.normal(size=(9_000, 32)), np.zeros((1_000, 32))])
    x[19_000:] = x[r.integers(0, 19_000, 1_000)]  # copies
    return np.round(x, 3)


def test_many_leaves(spark, monkeypatch):
    """20,000 vectors in leaves of 256: recall of the search, and of the graph after one round and after all."""
    x, kept = vectors(), {}
    build = nndescent.build

    def noted(nodes):
        kept["nodes"], kept["graph"] = nodes, build(nodes)
        return kept["graph"]

    monkeypatch.setattr(nndescent, "build", noted)
    monkeypatch.setattr(nndescent, "discard", lambda *tables: None)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for g in nndescent.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(g.query_id, []).append(g.score)
    assert len(got) == 400
    hits = 0
    for q, scores in got.items():
        s = np.delete(x @ x[q], q)
        worst = np.sort(s)[-20] - 1e-9  # scores, as copies tie
        hits += sum(v >= worst for v in scores)
    nodes = kept["nodes"].select("node", "x").toArrow()
    ids, at = nodes.column("node").to_numpy(), nndescent._matrix(nodes.column("x")).astype(np.float64)
    asked = np.random.default_rng(1).choice(len(ids), 300, replace=False)

    def recall(graph):
        lists = dict(graph.where(F.col("node").isin(ids[asked].tolist())).select("node", F.slice("ids", 1, 10)).collect())
        found = 0
        for i in asked:
            s = at @ at[i]
            s[i] = -np.inf
            found += len(set(ids[np.argsort(-s)[:10]].tolist()) & set(lists[ids[i]]))
        return found / (10 * len(asked))

    last = recall(kept["graph"])
    monkeypatch.setattr(nndescent, "CHANGED", 1.0)
    first = recall(build(kept["nodes"]))
    print("search", hits / 8000, "graph after one round", first, "after all", last)
    assert hits / 8000 >= 0.95
    assert first < last and last >= 0.9
