import random
from collections import Counter

import pytest

from rasterloom.llm import repeats


def brute(texts, width):
    out = []
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        out.append((len(t), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), bytes(b for b, g in zip(t, gone) if not g)))
    return out


@pytest.mark.parametrize("task_rows", [50_000, 2])
def test_equals_brute_force(spark, task_rows):
    r = random.Random(7)
    base = ["".join(r.choice("abcdé ") for _ in range(300)) for _ in range(4)]
    texts = ["", None, "short", "ab" * 80, "a" * 100, "xyz" + "a" * 90]
    for i in range(60):
        b = list(r.choice(base))
        for _ in range(r.randint(0, 12)):
            b[r.randrange(len(b))] = r.choice("abcdé xyz")
        k = r.randint(0, 200)
        texts.append("".join(b)[k : k + r.randint(0, 250)])
    texts += [texts[10], texts[10], base[0] + base[0]]
    rows = [(i if i % 9 else None, t, "x") for i, t in enumerate(texts)] + [(10, texts[10], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lo string").repartition(5)
    got = repeats.remove_repeats(df, 20, task_rows).collect()
    want = brute([(t or "").encode() for _, t, _ in rows], 20)
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(map(key, ((g.doc_id, g.n_bytes, g.n_removed, g.n_spans, bytes(g.kept)) for g in got))) == sorted(map(key, ((row[0], *w) for row, w in zip(rows, want))))


def test_empty(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
