"""Spelling variants: words one inserted, deleted or replaced code point apart, by rolling-hash deletions.

A word of L code points gives L + 1 integer keys: the polynomial hash of the word itself, and that of the word without each of
its code points, put together from a prefix hash and a suffix hash (vectorised over all words of an Arrow batch). Keys are dealt out
by their leading bits (a radix partition) and sorted. Words that share a key are neighbours if the strings behind the key are equal too:

    own + deletion                 one word is the other without a code point
    deletions at the same place    the two differ in that code point only

Both are counted by group, so that no pair is ever built: a group that is deleted at the same place has a word for each code point of
the alphabet at most, and what a word gets out of a group is a count and the best of the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import ascii_lower, discard, mix64, narrow, read, saved, whole_groups

RUN = "A-Za-zÀ-ÿ"
#: Of the runs of a document, one in TYPO (by crc32) loses a code point; words are of at least so many code points and occurrences.
TYPO, LEAST_LENGTH, LEAST_COUNT = 199, 6, 5
#: A word's form is so many times as frequent at least.
FACTOR = 5
#: Keys are made for so many bytes of keys at once.
KEYS_AT_ONCE = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all texts: runs of letters, A-Z lower-cased, of which one in TYPO lost a code point. Shorter and rarer words are left out."""
    # A run of fewer code points can't give a word; greedy matches of the others are maximal runs still.
    runs = F.regexp_extract_all("text", F.lit(f"[{RUN}]{{{LEAST_LENGTH},}}"), F.lit(0))
    r = docs.select("doc_id", F.explode(runs).alias("run")).select(F.col("run"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"))
    r = r.select(ascii_lower(F.col("run")).alias("run"), "id")
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(h, F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = r.select(F.when(h % TYPO == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT))


def _hashes(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number, deleted place (-1: none) and hash for each key of the words that lie end to end in points, with n + 1 offsets."""
    lengths = np.diff(at)
    n = int(lengths.max(initial=0)) + 1
    power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, BASE, np.uint64))])
    inverse = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _UNBASE, np.uint64))])
    word = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(points)) - at[:-1][word]
    weight = mix64(points.astype(np.uint64) + np.uint64(0x51ED2701)) | np.uint64(1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(weight * power[place], out=sums[1:])
    start, end = sums[at[:-1]], sums[at[1:]]
    # The prefix before the place, and the suffix after it moved down by one power of the base.
    prefix = sums[:-1] - start[word]
    suffix = (end[word] - sums[1:]) * inverse[1]
    own = end - start
    length = np.concatenate([lengths, lengths[word] - 1]).astype(np.uint64)
    # The length is part of the key.
    return np.concatenate([np.arange(len(lengths)), word]), np.concatenate([np.full(len(lengths), -1), place]), mix64(np.concatenate([own, prefix + suffix]) + length * np.uint64(0xD6E8FEB86659FD93))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, word, n) -> (key, place, id, n): the keys of each word, some words at a time."""
    for batch in batches:
        words = batch.column("word").cast(pa.string()).to_pylist()
        lengths = np.array([len(w) for w in words], np.int64)
        done, total = 0, np.cumsum(lengths)
        while done < len(words):
            hi = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + KEYS_AT_ONCE, "right")))
            points = np.frombuffer("".join(words[done:hi]).encode("utf-32-le"), np.uint32)
            word, place, key = _hashes(points, np.concatenate([[0], np.cumsum(lengths[done:hi])]))
            ids, n = (batch.column(c).to_numpy()[done:hi] for c in ("id", "n"))
            for lo in range(0, len(key), KEYS_AT_ONCE):
                part = slice(lo, lo + KEYS_AT_ONCE)
                yield pa.RecordBatch.from_arrays([pa.array(key[part].view(np.int64)), pa.array(place[part].astype(np.int32)), pa.array(ids[word[part]]), pa.array(n[word[part]])], names=["key", "place", "id", "n"])
            done = hi


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of keys sorted by key, those of a key that two words have."""
    for table in whole_groups(batches, ["key"]):
        key, ids = (table.column(c).to_numpy() for c in ("key", "id"))
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        many = np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts)
        yield from table.filter(pa.array(many[group])).to_batches()


def _verified(key: np.ndarray, place: np.ndarray, words: list[str]) -> np.ndarray:
    """A number for each row: rows have the same one if their keys and the strings behind these are equal."""
    told = [w if p < 0 else w[:p] + w[p + 1 :] for w, p in zip(words, place.tolist(), strict=True)]
    _, number = np.unique(np.array(told, object), return_inverse=True)
    _, both = np.unique(np.stack([key, number]), axis=1, return_inverse=True)
    return both.ravel()


def _best(order: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows sorted by group and then best first: size of the row's group, and the best row that isn't the row itself (-1: none)."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(starts, len(group)))
    at = np.repeat(np.arange(len(starts)), size)
    first = order[starts[at]]
    second = np.where(size[at] > 1, order[np.minimum(starts[at] + 1, len(order) - 1)], -1)
    return size[at], first, np.where(order == first, second, first)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, place, id, n, word) sorted by key -> (id, near, best_n, best): what a word gets out of each of its groups."""
    for table in whole_groups(batches, ["key"]):
        key, place, ids, n = (table.column(c).to_numpy() for c in ("key", "place", "id", "n"))
        words = table.column("word").to_pylist()
        # Rank of a row among all: the most frequent first, ties by code points.
        rank = np.empty(len(words), np.int64)
        rank[sorted(range(len(words)), key=lambda i: (-n[i], words[i]))] = np.arange(len(words))
        group = _verified(key, place, words)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # rows, near, best row
        # Replaced: deletions at the same place.
        rows = np.flatnonzero(place >= 0)
        rows = rows[np.lexsort((rank[rows], place[rows], group[rows]))]
        if len(rows):
            both = np.cumsum(np.concatenate([[0], (group[rows][1:] != group[rows][:-1]) | (place[rows][1:] != place[rows][:-1])]))
            size, _, other = _best(rows, both)
            some = size > 1
            out.append((rows[some], size[some] - 1, other[some]))
        # Inserted or deleted: the word itself and deletions, each longer word once.
        own = np.full(group.max(initial=-1) + 1, -1)
        own[group[place < 0]] = np.flatnonzero(place < 0)
        rows = np.flatnonzero((place >= 0) & (own[group] >= 0))
        if len(rows):
            rows = rows[np.lexsort((place[rows], rank[rows], ids[rows], group[rows]))]
            new = np.concatenate([[True], (ids[rows][1:] != ids[rows][:-1]) | (group[rows][1:] != group[rows][:-1])])
            rows = rows[new]
            out.append((rows, np.ones(len(rows), np.int64), own[group[rows]]))
            rows = rows[np.lexsort((rank[rows], group[rows]))]
            size, first, _ = _best(rows, group[rows])
            lead = rows == first
            out.append((own[group[rows[lead]]], size[lead], first[lead]))
        if out:
            at, near, best = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(near), pa.array(n[best]), pa.array([words[i] for i in best], pa.string())], names=["id", "near", "best_n", "best"])


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, best_n, best) for those of words (id, word, n; ids and words unique) that have a neighbour: how many, and the most frequent, ties by code points."""
    keys = words.mapInArrow(_keys, "key long, place int, id long, n long")
    parts = max(1, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = keys.repartition(parts, F.shiftrightunsigned("key", 40)).sortWithinPartitions("key")
    shared = dealt.mapInArrow(_shared, "key long, place int, id long, n long")
    # Strings are joined only where two words share a key.
    told = shared.join(words.select("id", "word"), "id")
    groups = told.select("key", "place", "id", "n", "word").repartition(parts, F.shiftrightunsigned("key", 40)).sortWithinPartitions("key")
    found = groups.mapInArrow(_found, "id long, near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return found.groupBy("id").agg(F.sum("near").alias("n_near"), first.alias("f")).select("id", "n_near", (-F.col("f.m")).alias("best_n"), F.col("f.best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for links (word, form): the last of the chain that starts at the word. Chains have no circles, as counts grow along them.

    Pointers are doubled, so that a chain of k links takes log2 k rounds.
    """
    at, before = saved(links.select("word", F.col("form").alias("root")), "roots"), None
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = saved(at.join(narrow(step), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        discard(*([at] if before is None else [before]))
        moved = now.where("moved").limit(1).count()
        before, at = now, now.select("word", "root")
        if not moved:
            return at


def variants(counts: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for counts (word, n), words being unique.

    form: the near word of largest n (ties: the least by code points) if that is at least FACTOR times n, else null; root: the last of
    the chain of forms, the word itself if it has none. A null word is left out; a word may be of any length (it makes as many keys, and
    its string travels only with keys that another word shares). An empty table gives no rows. Other columns are left out.
    """
    words = saved(counts.where("word is not null").select(F.monotonically_increasing_id().alias("id"), "word", F.col("n").cast("long").alias("n")), "words")
    near = saved(neighbours(words), "near")
    out = words.join(near, "id", "left")
    good = F.col("best_n") >= FACTOR * F.col("n")
    out = saved(out.select("word", F.when(good, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best_n")).alias("form_n")), "forms")
    discard(words, near)
    last = roots(out.where("form is not null").select("word", "form"))
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of all documents with its neighbours' count, its form and its root. A null text has no words; a null id is the empty string."""
    return variants(word_counts(read(spark, sf_dir, "documents")))


ORACLE = r"""
WITH RECURSIVE t AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS UBIGINT), CAST(range(8) AS UBIGINT[])), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS crc
), r AS (
  SELECT id, run, count(*) AS n FROM (
    SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  ) WHERE length(run) >= 6 GROUP BY id, run
), b AS (
  SELECT run, n, list_transform(regexp_extract_all(hex(encode(id || ':' || run)), '..'), lambda x: CAST('0x' || x AS UBIGINT)) AS bytes FROM r
), h AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda c, x: xor(c >> 8, crc[CAST(xor(c, x) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT) AS h FROM b, t
), w AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM h)
  GROUP BY word HAVING length(word) >= 6 AND sum(n) >= 5
), d AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)
), p AS (
  SELECT a.word, b.word AS other, b.n AS m FROM d a JOIN d b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.s = w.word
  UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.s = w.word
), k AS (
  SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS place FROM p
), f AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(k.n_near, 0) AS n_near, CASE WHEN k.m >= 5 * w.n THEN k.other END AS form, CASE WHEN k.m >= 5 * w.n THEN k.m END AS form_n FROM w LEFT JOIN k ON k.word = w.word AND k.place = 1
), c AS (
  SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word JOIN f g ON g.word = c.at WHERE g.form IS NULL
"""
