import itertools

import numpy as np

from rasterloom.llm import quality


def enumerated(doc, emit, trans):
    """Marginals and log partition functions by all labellings of each text."""
    good, pairs = np.zeros(len(doc)), np.zeros((4, int((doc[1:] == doc[:-1]).sum())))
    at_pair, total = 0, {}
    for d in dict.fromkeys(doc.tolist()):
        k = np.flatnonzero(doc == d)
        z, g, p = 0.0, np.zeros(len(k)), np.zeros((4, len(k) - 1))
        for y in itertools.product((0, 1), repeat=len(k)):
            w = np.exp(sum(emit[i] for i, v in zip(k, y) if v) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            z += w
            g += w * np.array(y)
            for j, (a, b) in enumerate(zip(y, y[1:])):
                p[2 * a + b, j] += w
        good[k], pairs[:, at_pair : at_pair + len(k) - 1] = g / z, p / z
        at_pair += len(k) - 1
        total[d] = np.log(z)
    return good, pairs, total


def test_marginals_equal_enumeration():
    r = np.random.default_rng(3)
    doc = np.repeat([0, 1, 2, 5], [1, 6, 2, 9])
    emit, trans = r.normal(size=len(doc)) * 2, r.normal(size=(2, 2))
    got, pairs = quality.marginals(doc, emit, trans)
    want, want_pairs, _ = enumerated(doc, emit, trans)
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)
    none, no_pairs = quality.marginals(np.zeros(0, np.int64), np.zeros(0), trans)
    assert not len(none) and no_pairs.shape == (4, 0)


def test_fit_reaches_a_point_without_slope():
    """At the fitted weights, differences of the penalised likelihood (by enumeration) vanish."""
    r = np.random.default_rng(4)
    doc = np.repeat(np.arange(12), r.integers(1, 6, 12))
    x = np.hstack([r.normal(size=(len(doc), 2)), np.ones((len(doc), 1))])
    label = np.arange(12) % 2
    weights, trans = quality.fit(doc, x, label, np.ones(12), steps=3000, ridge=0.01)
    size = np.bincount(doc)

    def loss(theta):
        w, t = theta[:3], theta[3:].reshape(2, 2)
        emit = x @ w
        *_, z = enumerated(doc, emit, t)
        out = 0.0
        for d in range(12):
            own = emit[doc == d].sum() * label[d] + (size[d] - 1) * t[label[d], label[d]]
            out += (z[d] - own) / size[d] / 12
        return out + 0.5 * 0.01 * (theta @ theta) + 0.5 * 0.05 * (theta[3:] @ theta[3:])

    theta = np.concatenate([weights, trans.ravel()])
    slope = lambda at: np.abs([(loss(at + e) - loss(at - e)) / 2e-5 for e in np.eye(7) * 1e-5]).max()
    assert slope(theta) < 3e-3 < 0.05 < slope(np.zeros(7))


def texts():
    good = "The committee met on Tuesday and agreed that the bridge should be repaired before winter sets in."
    bad = "BUY!!! CHEAP $$$ >>> CLICK >>> 1234567890 ### FREE !!!"
    return good, bad


def test_documents(spark):
    good, bad = texts()
    rows = [(i, (good if i % 2 else bad) + f"\nline {i} of it", "x") for i in range(200)] + [(None, None, "x"), (500, "", "x"), (501, " \n ", "x"), (502, good, "x"), (502, bad, "x"), (503, (good + "\n") * 6000, "x"), (3, good, "x"), (3, good, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(200)] + [(None, 1, None), (502, None, None), (501, 0, None), (501, 1, None)], "doc_id long, quality int, toxic int")
    model = quality.train(df, labels)
    out = quality.score(df, model)
    assert out.columns == ["doc_id", "text", "score"] and dict(out.dtypes)["score"] == "double"
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= g.score <= 1 for g in got)
    by = {(g.doc_id, g.text): g.score for g in got}
    assert by[500, ""] == by[None, None] == by[501, " \n "] == model[2]
    assert by[503, (good + "\n") * 6000] > 0.9 and by[502, bad] < 0.1 < 0.9 < by[502, good]
    assert quality.score(df.limit(0), model).count() == 0


def test_repeated_ids_are_bounded_before_they_are_collected(spark):
    good, bad = texts()
    df = spark.createDataFrame([(1, good if i % 2 else bad) for i in range(3000)] + [(2, bad), (3, bad), (4, good)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1)], "doc_id long, quality int")
    rows = quality.sample(df, labels, "quality", 3)
    assert len(rows) <= 3 and len({r.doc_id for r in rows}) == len(rows)
