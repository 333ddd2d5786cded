import random

import duckdb
import pytest

from rasterloom.llm import chat, licenses, queries


def test_round_trip(spark):
    r = random.Random(9)
    bits = ["### ", "###", "</turn>", "</turn>\n", "\n", "\\", "\\\\", ": ", "assistant", "user", "x", " ", "é", "<", "#", "### Assistant: ", "\\#"]
    rows = []
    for c in range(150):
        for t in range(r.randint(1, 5)):
            rows.append((c, t, r.choice(["user", "assistant", "system", "odd: role", "a\\b", ""]), "".join(r.choice(bits) for _ in range(r.randint(0, 8)))))
    rows += [(None, None, None, None), (None, 1, "user", "### x"), (500, 1, "assistant", "a"), (500, 1, "assistant", "a"), (500, 1, "assistant", None), (501, 0, "user", "y" * 300_000 + "</turn>\n")]
    df = spark.createDataFrame([(*x, "extra") for x in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    got = chat.format_conversations(df).collect()
    want = {}
    for c, t, role, text in rows:
        want.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert len(got) == len(want)
    for g in got:
        assert g.round_trip
        assert [(t.role, t.text) for t in g.turns] == [x[2:] for x in sorted(want[g.conv_id])]
        for t in g.turns:
            assert "###" not in t.content and "</turn>" not in t.content
    assert chat.format_conversations(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op1_license_scan", "op6_chat_formatting"])
def test_equals_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, sf).toPandas()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda d: sorted(tuple(map(str, x)) for x in d[cols].astype(object).where(d[cols].notna(), None).itertuples(index=False))
    assert key(got) == key(want)


def test_licenses(spark):
    mit = licenses.KNOWN[0][1]
    rows = [
        (1, "Copyright (c) 2020 Some One\n\n" + mit.upper().replace("SUBLICENSE", "sub-license")),
        (2, "Released under the MIT Licence!\nother text\nreleased  under -- the mit license"),
        (2, "Released under the MIT Licence!\nother text\nreleased  under -- the mit license"),
        (3, None),
        (4, ""),
        (None, "prose only"),
        (5, "word " * 50_000),
    ]
    got = licenses.scan(spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, license string")).collect()
    told = sorted((str(g.doc_id), str(g.license), g.line_licenses, g.n_license_lines) for g in got)
    assert told == sorted([("1", "MIT", "", 0), ("2", "None", "MIT", 2), ("2", "None", "MIT", 2), ("3", "None", "", 0), ("4", "None", "", 0), ("None", "None", "", 0), ("5", "None", "", 0)])
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
