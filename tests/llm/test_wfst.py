import random

import pytest

from rasterloom.llm import wfst

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def both():
    return wfst.Transducer.load(), sentencepiece.SentencePieceProcessor(model_file=wfst.MODEL)


def test_equals_library(both):
    t, model = both
    r = random.Random(1)
    texts = ["", " ", "  ", "a", "Hello  world ", "x\ny\t z", "ﬁ ½ é 日本 🙂", "<s> hi </s><0x41>", "\x00a", "a▁b", "aaaaaaaaaaaaaaaaaaaaaaaa", "    " * 20, "1234567890" * 9]
    letters = "aeiounrstlhdé .,\n🙂ß"
    texts += ["".join(r.choice(letters) for _ in range(r.randint(1, 120))) for _ in range(400)]
    texts += [" ".join(r.choice(["the", "ing", "internationalisation", "schön", "ñandú", "of", "whiteboard"]) + r.choice(["", "s", "ed", "."]) for _ in range(40)) for _ in range(50)]
    for x in texts:
        ids = t.encode(x).tolist()
        assert ids == model.encode(x), x
        assert t.decode(t.encode(x)) == x.replace("▁", " ")


def test_documents(spark, both):
    df = spark.createDataFrame([(1, "Some text", 5), (None, None, 6), (3, "", 7)], "doc_id long, text string, ids int")
    rows = {r.doc_id: r for r in wfst.encode(df).collect()}
    assert rows[1].ids == both[1].encode("Some text") and rows[1].round_trip
    assert rows[None].ids == [] and rows[3].ids == [] and rows[None].round_trip
    assert wfst.encode(df.limit(0)).count() == 0


def merged(t, text):
    """The pieces that merging pairs by score leaves of a text."""
    s = list(text)
    while True:
        pairs = [(t.score[a + b], -i) for i, (a, b) in enumerate(zip(s, s[1:])) if a + b in t.score]
        if not pairs:
            return s
        i = -max(pairs)[1]
        s[i : i + 2] = [s[i] + s[i + 1]]


def segmentations(t, text):
    if not text:
        yield []
    for k in range(1, len(text) + 1):
        if k == 1 or text[:k] in t.score:
            for rest in segmentations(t, text[k:]):
                yield [text[:k], *rest]


def test_path_is_the_least_of_all_accepted_ones(both):
    t, _ = both
    r = random.Random(5)
    letters = "aeintrsohl▁"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(1, 11))).lstrip("▁") for _ in range(150)]
    many = 0
    for text in filter(None, ("▁" * (i % 2) + x.replace("▁", "") for i, x in enumerate(texts))):
        accepted = []
        for path in segmentations(t, text):
            if all(merged(t, a + b) == [a, b] for a, b in zip(path, path[1:])) and merged(t, path[0]) == path[:1]:
                accepted.append((sum(-t.score[p] if p in t.score else wfst.FALLBACK for p in path), path))
        assert t.shortest_path(text) == min(accepted)[1]
        many += sum(1 for _ in segmentations(t, text)) > 20
    assert many > 30


def test_normaliser():
    table = {" ": "_", "A": "a", "½": "1/2"}
    assert wfst.normaliser(lambda s: "^" + "".join(table.get(c, c) for c in s)) == ("^", {ord(k): v for k, v in table.items()})
    with pytest.raises(ValueError):
        wfst.normaliser(lambda s: " ".join(s.split()))


def least_sums(pieces, fallback, text):
    """Every segmentation of a text with its sum of weights, the least first."""
    out = []

    def go(at, sum_, path):
        if at == len(text):
            out.append((sum_, path))
            return
        for k in range(1, len(text) - at + 1):
            p = text[at : at + k]
            if p in pieces:
                go(at + k, sum_ - pieces[p], [*path, p])
            elif k == 1:
                go(at + k, sum_ + fallback, [*path, p])

    go(0, 0.0, [])
    return sorted(out)


def test_weights_decide_for_unigrams():
    """The path is that of the least sum of all segmentations, and other weights give other paths."""
    r = random.Random(7)
    names = sorted({"".join(r.choice("ab▁") for _ in range(r.randint(1, 6))) for _ in range(60)} - {"b"})
    names = [n for n in names if "▁" not in n.lstrip("▁")]
    bytes_ = list(range(1000, 1256))
    make = lambda scores: wfst.Transducer([(n, s, i) for i, (n, s) in enumerate(zip(names, scores))], bytes_, merging=False)
    right, other = make([-r.uniform(1, 9) for _ in names]), make([-r.uniform(1, 9) for _ in names])
    changed = 0
    for _ in range(150):
        text = "".join(r.choice("ab ") for _ in range(r.randint(0, 9)))
        ids = right.encode(text).tolist()
        want = []
        if text:
            best = least_sums(right.score, right.fallback, "▁" + text.replace(" ", "▁"))
            assert len(best) < 2 or best[1][0] > best[0][0]
            for p in best[0][1]:
                want += [right.ids[p]] if p in right.ids else [bytes_[b] for b in p.encode()]
        assert ids == want, text
        assert right.decode(right.encode(text)) == text
        changed += ids != other.encode(text).tolist()
    assert changed > 50
    again = wfst.Transducer.__reduce__(right)
    assert again[0](*again[1]).encode("abab").tolist() == right.encode("abab").tolist()


def test_kind_of_the_model(both):
    assert both[0].merging


def test_very_long_texts(both):
    t, model = both
    r = random.Random(8)
    for x in ["ab" * 40_000, "word " * 30_000, "".join(r.choice("abcdefgh ij.,0é") for _ in range(120_000))]:
        ids = t.encode(x)
        assert ids.tolist() == model.encode(x) and t.decode(ids) == x
