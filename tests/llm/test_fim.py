import hashlib
import random
import re

import duckdb
import numpy as np

from rasterloom.llm import fim


def brute(doc_id, text, rate=100, spm_rate=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    hexed = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted(x % (len(lines) + 1) for x in h[:2])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(lines), "plain", None, None, text
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < spm_rate:
        return len(lines), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(lines), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_rank_and_select():
    r = np.random.default_rng(4)
    for n, share in [(0, 0), (1, 1), (64, 0.5), (513, 0.02), (5_000, 0.3), (4_096, 1)]:
        bits = r.random(n) < share
        b = fim.Bits(bits)
        before = np.concatenate([[0], np.cumsum(bits)])
        assert (b.rank(np.arange(n + 1)) == before).all()
        assert (b.select(np.arange(1, before[-1] + 1)) == np.flatnonzero(bits)).all()


def test_brute_force(spark):
    r = random.Random(2)
    bits = ["\n", "\n\n", "a", "word ", "é", "𝄞", "<P", ">", "<", "P>", "\r\n", "ß\n", "x" * 70 + "\n"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 40)))) for i in range(400)]
    rows += [(None, "a\nb\nc"), (None, None), (-5, "no line end"), (7, ""), (8, "\n"), (9, "x <S> y\nz"), (10, "<M>"), (11, "<P"), (12, ">\n<"), (13, "y" * 300_000), (14, "ü\n" * 100_000), (3, "a\nb\n"), (3, "a\nb\n")]
    df = spark.createDataFrame([(*x, "form", 5) for x in rows], "doc_id long, text string, form string, n int").repartition(3)
    for rate, spm_rate in [(100, 50), (40, 90)]:
        out = fim.fill_in_middle(df, rate, spm_rate)
        got = out.withColumn("back", fim.restored(out["output"], out["form"])).collect()
        assert len(got) == len(rows)
        told = sorted(((g.doc_id, g.text, g.n, g.form, g.prefix_chars, g.middle_chars, g.output) for g in got), key=str)
        assert told == sorted(((*x, *brute(*x, rate, spm_rate)) for x in rows), key=str)
        assert all(g.back == (g.text or "") for g in got)
    assert fim.fill_in_middle(df.limit(0)).count() == 0


def test_runs_of_texts(spark, monkeypatch):
    monkeypatch.setattr(fim, "RUN_BYTES", 100)
    rows = [(i, "line\n" * (i % 60)) for i in range(100)]
    got = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert [(g.n, g.form, g.prefix_chars, g.middle_chars, g.output) for g in sorted(got, key=lambda g: g.doc_id)] == [brute(*x) for x in rows]


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    q = con.execute(fim.ORACLE)
    names = [d[0] for d in q.description]
    want = sorted(q.fetchall(), key=str)
    got = fim.op11_fill_in_middle(spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=str) == want
