"""Every registered query of the image side that has SQL gives the SQL's rows on the smallest tables."""

import duckdb
import pytest

from rasterloom.plans import catalogue, catalogue_jobs, catalogue_more  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings pages".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def key(row):
    return tuple((v is None, str(v)) if not isinstance(v, float) else (False, f"{v:.5f}") for v in row)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(tuple, df.select(*cols).collect()), key=key)
    con = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in con.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(r[i] for i in at) for r in con.fetchall()), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert all(a == b or (isinstance(a, float) and abs(a - b) <= 2e-6) for a, b in zip(g, w)), (g, w)
