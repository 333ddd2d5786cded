import random
import re

import numpy as np

from rasterloom.llm import hyperminhash as h


def sets(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_equals_brute_force(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abcdé") for _ in range(4)) for _ in range(400)]
    base = [[r.choice(words) for _ in range(r.choice([6, 30, 80, 200]))] for _ in range(8)]
    rows = [(None, "one two three four five six"), (900, "one two three four five six"), (901, "ONE two three  four five six"), (902, None), (903, ""), (904, " \n"), (905, "few words"), (906, "Few\twords")]
    for i in range(160):
        b = list(r.choice(base))
        for _ in range(r.randint(0, max(1, len(b) // 25))):
            b[r.randrange(len(b))] = r.choice(words)
        rows.append((i, " ".join(b)))
    rows += [rows[20], rows[20]]
    got = h.duplicates(spark.createDataFrame([(*x, "y") for x in rows], "doc_id long, text string, node string").repartition(4)).collect()
    s = [sets(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and (rows[i][0] == rows[j][0] or s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j])):
                group[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    want = [(d, len(s[i]), None if d is None else least[find(i)], d is None or d == least[find(i)]) for i, (d, _) in enumerate(rows)]
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert any(not w[3] and w[0] not in (901, 906) for w in want)


def test_estimate_is_near():
    r = np.random.default_rng(3)
    a = r.integers(0, 2**63, 3000, dtype=np.uint64)
    x, y = np.unique(a[:2500]), np.unique(a[500:])
    regs = h.registers(np.concatenate([x, y]), np.array([0, len(x)]))
    e = h.estimate((regs[0] == regs[1]).mean(), np.array(len(x)), np.array(len(y)))
    assert abs(e - 2000 / 3000) < 0.12


def test_empty(spark):
    assert h.duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
