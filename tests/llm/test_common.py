import random
import time

import numpy as np
import pyarrow as pa

from rasterloom.llm import common


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, i) for i in range(6000, 6400)] + [(7, 7), (None, 3), (9, None)]
    got = {x.node: x.component for x in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    group = {}

    def find(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = find(u), find(v)
            group[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in group}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_whole_groups():
    keys = np.sort(np.random.default_rng(1).integers(0, 40, 500))
    batches = [pa.RecordBatch.from_arrays([pa.array(k), pa.array(k * 2)], names=["k", "v"]) for k in np.array_split(keys, 23)]
    tables = list(common.whole_groups(iter(batches), ["k"], 64))
    assert sum(t.num_rows for t in tables) == 500 and len(tables) > 3
    seen = [set(t.column("k").to_pylist()) for t in tables]
    assert sum(map(len, seen)) == len(set(keys.tolist()))


def test_binary_parts():
    c = pa.array([b"ab", None, b"", b"cde", b"f"], pa.binary()).slice(1, 3)
    data, at = common.binary_parts(c)
    assert data.tobytes() == b"cde" and at.tolist() == [0, 0, 0, 3]
    assert common.binary_parts(pa.array([], pa.binary()))[1].tolist() == [0]


def test_prefix_hash():
    data = np.frombuffer(b"abcabcabd", np.uint8)
    h = common.PrefixHash(data)
    same = h.of(np.array([0]), np.array([3])) == h.of(np.array([3]), np.array([6]))
    other = h.of(np.array([3]), np.array([6])) == h.of(np.array([6]), np.array([9]))
    assert same.all() and not other.any()


def test_hot_rows_are_whole(spark):
    """A third of all rows in one group of copies: nothing is dropped."""
    from rasterloom.llm import hyperminhash, linededup, repeats

    text = "one two three four five six seven eight nine ten " * 12
    rows = [(i, text if i % 3 == 0 else f"{text} {i} " + " ".join(f"w{i * 7 + k}" for k in range(90 * (i % 3 == 1)))) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    near = {r.doc_id: r.component_id for r in hyperminhash.duplicates(df).collect()}
    assert len(near) == 240 and {near[i] for i in range(0, 240, 3)} == {0}
    lines = linededup.dedup_lines(df).collect()
    assert len(lines) == 240 and sum(bool(r.text) for r in lines if r.doc_id % 3 == 0) == 1
    cut = repeats.remove_repeats(df, 100).collect()
    assert len(cut) == 240 and all(r.n_removed >= len(text) - 100 for r in cut)


def test_saved_leaves_no_shuffle_files(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getName() for f in (found.apply(i) for i in range(found.size())) if f.getName().startswith("shuffle_")}

    there, mode = files(), spark.conf.get(common.TIDY, None)
    out = common.saved(spark.range(5000).selectExpr("id % 700 AS k").groupBy("k").count(), "tidy")
    until = time.time() + 20
    while files() - there and time.time() < until:
        time.sleep(0.2)
    assert not files() - there and out.count() == 700 and spark.conf.get(common.TIDY, None) == mode
