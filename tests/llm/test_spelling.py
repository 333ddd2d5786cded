import collections
import random
import re
import zlib

import duckdb
import numpy as np

from rasterloom.llm import spelling

NAMES = ["word", "form", "root", "n", "n_near", "form_n"]


def counted(rows):
    c = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({x: x + 32 for x in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            c[run] += 1
    return {w: n for w, n in c.items() if len(w) >= 6 and n >= 5}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(w):
    near = {k: [x for x in w if one_apart(k, x)] for k in w}
    best = {k: min(x, key=lambda y: (-w[y], y), default=None) for k, x in near.items()}
    form = {k: b if b is not None and w[b] >= 5 * w[k] else None for k, b in best.items()}
    out = []
    for k in w:
        root = k
        while form[root] is not None:
            root = form[root]
        out.append((k, form[k], root, w[k], len(near[k]), w[form[k]] if form[k] is not None else None))
    return sorted(out, key=str)


def told(df):
    return sorted((tuple(r) for r in df.select(*NAMES).collect()), key=str)


def test_brute_force(spark):
    r = random.Random(3)
    letters = "abéÿ÷"
    words = {"".join(r.choice(letters) for _ in range(r.randint(6, 8))): int(5 * 3 ** r.uniform(0, 6)) for _ in range(600)}
    # Runs of one letter, a chain of forms, ties, and one long word with neighbours.
    words |= {"aaaaaa": 9, "aaaaaaa": 9, "aaaaaaaa": 400, "aaaaaab": 9, "xhouse": 5, "xhouses": 30, "xhousess": 200, "xhousesss": 5_000, "tiezza": 50, "tiezzb": 50, "tiezzc": 5, "q" * 3_000: 7, "q" * 2_999 + "r": 70, "q" * 3_001: 35}
    df = spark.createDataFrame([(k, v, "x") for k, v in words.items()] + [(None, 8, "x")], "word string, n long, form string").repartition(5)
    want = brute(words)
    assert told(spelling.variants(df)) == want
    assert {x[0]: x[2] for x in want}["xhouse"] == "xhousesss"
    assert spelling.variants(df.limit(0)).count() == 0


def test_collisions_are_told_apart(spark, monkeypatch):
    # Hashes of 3 bits: nearly all keys collide, and strings alone decide.
    monkeypatch.setattr(spelling, "mix64", lambda h: h & np.uint64(7))
    r = random.Random(5)
    words = {"".join(r.choice("abc") for _ in range(6)): r.randint(5, 90) for _ in range(60)}
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(words))), pa.array(list(words)), pa.array(list(words.values()))], names=["id", "word", "n"])
    keys = pa.Table.from_batches(list(spelling._keys(iter([batch]))))
    keys = keys.append_column("word", pa.array([list(words)[i] for i in keys["id"].to_pylist()])).sort_by("key")
    assert len(set(keys["key"].to_pylist())) <= 8
    near = collections.Counter()
    for b in spelling._found(iter(keys.to_batches())):
        for i, n in zip(b["id"].to_pylist(), b["near"].to_pylist(), strict=True):
            near[list(words)[i]] += n
    assert {x[0]: x[4] for x in brute(words) if x[4]} == dict(near)


def test_keys_in_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "KEYS_AT_ONCE", 20)
    words = {"abcdefghij"[:k] + x: 5 + k for k in range(5, 10) for x in "vwxyz"}
    df = spark.createDataFrame(list(words.items()), "word string, n long").coalesce(1)
    assert told(spelling.variants(df)) == brute(words)


def test_documents(spark):
    r = random.Random(8)
    pool = ["Straße", "straßen", "colour", "colours", "Colour", "xyz", "über×gang", "ÀÉabcd", "éèêëàâ", "letter's", "under_score"]
    rows = [(i, " ".join(r.choice(pool) for _ in range(r.randint(0, 60)))) for i in range(300)]
    rows += [(None, None), (None, "colour " * 9), (4, ""), (5, None), (6, "longword" * 9_000 + " "), (7, "a" * 100_000)] + [(7, "same words again and again repeated")] * 6
    df = spark.createDataFrame([(*x, "w", 1) for x in rows], "doc_id long, text string, word string, n int").repartition(4)
    assert told(spelling.variants(spelling.word_counts(df))) == brute(counted(rows))
    assert spelling.variants(spelling.word_counts(df.limit(0))).count() == 0


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    q = con.execute(spelling.ORACLE)
    at = [[d[0] for d in q.description].index(c) for c in NAMES]
    assert told(spelling.op13_spelling_variants(spark, sf)) == sorted((tuple(r[i] for i in at) for r in q.fetchall()), key=str)
