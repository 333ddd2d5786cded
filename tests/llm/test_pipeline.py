import random
import re

import duckdb
import pytest

import corpus_pipeline
from rasterloom.llm import decontaminate, quality, wfst

from .test_hyperminhash import sets
from .test_linededup import brute as cut_lines


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    path = str(tmp_path_factory.mktemp("tables"))
    vocabulary = ["".join(r.choice("abcdefghiklmnorstu") for _ in range(r.randint(2, 8))) for _ in range(900)]
    line = lambda n: " ".join(r.choice(vocabulary) for _ in range(n)).capitalize() + "."
    items = [(i, line(30)) for i in range(6)] + [(6, line(4)), (7, None), (8, "")]
    docs, labels = [], []
    for i in range(150):
        text = "\n".join(line(r.randint(8, 40)) for _ in range(r.randint(1, 6)))
        if i % 5 == 1:
            text = " ".join(w + "!!" for w in text.upper().split())
        if i % 10 == 3:
            w = text.split(" ")
            w[len(w) // 2 : len(w) // 2] = items[i % 6][1].split(" ")[4:20]
            text = " ".join(w)
        docs.append([i, text, "en", "s", len(text)])
        labels.append((i, int(i % 5 != 1), 0))
    for i in range(150, 190):  # copies with a changed word
        w = docs[r.randrange(100)][1].split(" ")
        w[r.randrange(len(w))] = "changed"
        docs.append([i, " ".join(w), "en", "s", 0])
    docs += [[200, None, None, None, None], [201, "", "en", "s", 0], docs[7], [None, line(20), "en", "s", 0]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def same(a, b):
    return sorted(map(repr, a)) == sorted(map(repr, b))


def test_stages_equal_brute_force(spark, folder):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rows = [tuple(x) for x in docs.collect()]
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path).persist()
        out[name] = [tuple(x) for x in docs.collect()]
        if name != "sentencepiece":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    shouting = [x for x in out["quality"] if x[1] and x[1].isupper()]
    prose = [x for x in rows if x[1] and not x[1].isupper() and "!!" not in x[1]]
    assert not shouting and len([x for x in out["quality"] if x in prose]) >= 0.95 * len(prose)
    cut = cut_lines([x[:2] for x in out["quality"]])
    want = [(d, t) for (d, t), x in zip(cut, out["quality"]) if t.strip() or t == (x[1] or "")]
    assert same([x[:2] for x in out["line_dedup"]], want)
    s = [sets(x[1]) for x in out["line_dedup"]]
    ids = [x[0] for x in out["line_dedup"]]
    group = list(range(len(s)))
    find = lambda i: i if group[i] == i else find(group[i])
    for i in range(len(s)):
        for j in range(i):
            if ids[i] is not None and ids[j] is not None and (ids[i] == ids[j] or s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j])):
                group[find(i)] = find(j)
    best = {}
    for i, d in enumerate(ids):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    assert same([x[0] for x in out["near_duplicates"]], [*best.values(), *(d for d in ids if d is None)])
    windows = {tuple(w[i : i + 10]) for _, t in items for w in [words(t)] if w for i in range(max(1, len(w) - 9))}
    clean = [x for x in out["near_duplicates"] if not any(tuple(words(x[1])[i : i + len(w)]) == w for w in windows for i in range(len(words(x[1]))))]
    assert same(out["decontamination"], clean) and len(clean) < len(out["near_duplicates"])
    model = __import__("sentencepiece").SentencePieceProcessor(model_file=wfst.MODEL)
    assert same([(x[0], x[4]) for x in out["sentencepiece"]], [(x[0], model.encode(x[1] or "")) for x in clean])
    whole = [tuple(x) for x in corpus_pipeline.run(spark, path).collect()]
    assert same(whole, out["sentencepiece"])


def test_held_out_quality(spark):
    """The classifier tells held-out documents of the smallest tables apart."""
    from rasterloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    got = QUERIES["op9_quality_classifier"](spark, sf).where("held_out").toPandas().set_index("doc_id")
    labels = duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").df().set_index("doc_id")
    both = got.join(labels, how="inner")
    assert len(both) > 30 and (both.predicted == both.quality).mean() > 0.93
    assert got.score.between(0, 1).all()


def test_empty_tables(spark, tmp_path):
    d = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_decontamination_words_and_nulls(spark):
    docs = spark.createDataFrame([(1, "A b, C d", 1), (1, "A b, C d", 1), (None, None, 1), (2, "x a b", 1), (3, "", 1)], "doc_id long, text string, n_hit int")
    items = spark.createDataFrame([(5, "b c"), (5, "b c"), (6, None), (7, "!!"), (10, "a B c")], "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in decontaminate.decontaminate(docs, items).collect()]
    assert same(got, [(1, 4, 3, ["10", "5"], True)] * 2 + [(None, 0, 0, [], False), (2, 3, 0, [], False), (3, 0, 0, [], False)])
    assert decontaminate.decontaminate(docs, items.limit(0)).where("contaminated").count() == 0
    assert quality.train(docs.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, quality int"))[2] == 0.5
