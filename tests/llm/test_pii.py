import random
import re

from rasterloom.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def test_base_equals_plain_patterns():
    r = random.Random(2)
    bits = ["a@b.c", "@", ".", "1", "12", "255", "256", "+", "-", " ", "(", ")", "x", "@@", "4111111111111111", "+49 170 1234567", "1.2.3.4", "é", "a.b", "..", "0"]
    for _ in range(6000):
        text = "".join(r.choice(bits) for _ in range(r.randint(1, 16)))
        assert pii.find_all(text)[0] == brute(text), text


def added(text):
    base, every = pii.find_all(text)
    assert set(base) <= set(every)
    return [(k, text[a:b]) for k, a, b in every if (k, a, b) not in base]


def test_disguises():
    assert added("write to john.doe (at) mail [dot] example (dot) com today") == [("email", "john.doe (at) mail [dot] example (dot) com")]
    assert added("write to john at example dot com today") == [("email", "john at example dot com")]
    assert added("look at the dot on the wall, at noon") == []
    assert added("call plus four nine one seven zero one two three four five six seven now") == [("phone", "plus four nine one seven zero one two three four five six seven")]
    assert added("аnna@example.org") == [("email", "аnna@example.org")]
    assert added("ip １９２.１６８.０.１ here") == [("ip", "１９２.１６８.０.１")]
    assert added("john​@exam​ple.com") == [("email", "john​@exam​ple.com")]
    assert added("un deux trois quatre cinq") == []


def test_documents(spark):
    df = spark.createDataFrame([(1, "a@b.cd", "z"), (None, None, None), (3, "", "z"), (4, "x" * 500_000 + " a@b.cd " + "1" * 200_000, "z")], "doc_id long, text string, spans string")
    rows = {r.doc_id: r for r in pii.personal_data(df).collect()}
    assert [tuple(s) for s in rows[1].base] == [("email", 0, 6)] and rows[None].spans == [] and rows[3].base == []
    assert [tuple(s) for s in rows[4].spans] == [("email", 500_001, 500_007)]
    assert pii.personal_data(df.limit(0)).count() == 0


def test_query(spark, tmp_path):
    from rasterloom.llm.queries import QUERIES

    texts = {1: "a@b.cd and 1.2.3.4", 2: None, 3: "", 4: "x +49 170 1234567 4111111111111111", 5: "plain"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    import hashlib

    for r in QUERIES["op8_personal_data"](spark, str(tmp_path)).collect():
        want = brute(texts[r.doc_id] or "")
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest() and r.spans == told
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in BASE]
