"""Benchmark decontamination by a prefix-filtered join of shingles, in DataFrame functions only.

A window is a run of 10 words of an item (the whole item if shorter). A text that holds a window holds each of
its shingles of three words, so it's enough to join on one: the rarest in the documents. The place of that
shingle in the window and in the text gives the only place where the window can start (positional bound); the
window must end within the text (length bound). What is left is verified word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import ascii_lower, narrow, read, row_key, same_row, saved

WINDOW = 10
SHINGLE = 3


def words(text: Column) -> Column:
    """Lower-cased runs of digits, a-z and characters beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def windows_of(items: DataFrame, window: int) -> DataFrame:
    """(window, size, items): each different window, its number of words and the items that hold it.

    A row for each place first, so that copies of a window meet in a grouped aggregate.
    """
    i = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    i = i.withColumn("size", F.least(F.size("w"), F.lit(window)))
    i = i.select("item_id", "size", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("size"))).alias("start"))
    i = i.select("item_id", "size", F.array_join(F.slice("w", F.col("start") + 1, F.col("size")), " ").alias("window"))
    return i.groupBy("window", "size").agg(F.collect_set("item_id").alias("items"))


def word_counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(word, n) in all documents of the words wanted."""
    w = docs.select(F.explode(words(F.col("text"))).alias("word"))
    return w.join(wanted, "word").groupBy("word").agg(F.count("*").alias("n"))


def prefix_shingles(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(token, windows): the rarest shingle of each window (product of its words' counts, then the text), and the windows it stands for.

    windows is an array of (offset, size, window, items).
    """
    w = windows.withColumn("w", F.split("window", " ")).withColumn("k", F.least("size", F.lit(SHINGLE)))
    words_ = w.select("window", "size", "items", "k", F.posexplode("w").alias("at", "word")).join(counts, "word", "left")
    words_ = words_.groupBy("window", "size", "items", "k").agg(F.sort_array(F.collect_list(F.struct("at", "word", F.log(F.coalesce("n", F.lit(0)) + 1.0).alias("cost")))).alias("w"))
    places = F.transform(
        F.sequence(F.lit(0), F.col("size") - F.col("k")),
        lambda o: F.struct(
            F.aggregate(F.slice("w", o + 1, F.col("k")), F.lit(0.0), lambda s, x: s + x["cost"]).alias("cost"),
            F.array_join(F.transform(F.slice("w", o + 1, F.col("k")), lambda x: x["word"]), " ").alias("token"),
            o.alias("offset"),
        ),
    )
    p = words_.withColumn("p", F.array_min(places))
    return p.groupBy(F.col("p.token").alias("token"), "k").agg(F.collect_list(F.struct(F.col("p.offset").alias("offset"), "size", "window", "items")).alias("windows"))


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, n_hit, item_ids) of the documents that hold a window; item_ids is sorted as strings."""
    d = docs.select(*row_key(), "text")
    windows = saved(windows_of(items, window), "windows")
    wanted = saved(windows.select(F.explode(F.split("window", " ")).alias("word")).distinct(), "window-words")
    counts = saved(word_counts(d, narrow(wanted)), "word-counts")
    tokens = saved(prefix_shingles(windows, counts), "prefix-shingles")
    found = None
    for k in sorted(r.k for r in tokens.select("k").distinct().collect()):  # at most SHINGLE values
        t = tokens.where(F.col("k") == k).select("token", "windows")
        w = d.select("doc_id", "text_key", words(F.col("text")).alias("w"))
        # The words of each shingle side by side; the last ones of a text lack some and match nothing.
        shingle = F.arrays_zip(*(F.slice("w", F.lit(1 + i), F.greatest(F.size("w") - i, F.lit(0))).alias(f"w{i}") for i in range(k)))
        shingle = w.select("doc_id", "text_key", F.posexplode(shingle).alias("at", "s"))
        shingle = shingle.select("doc_id", "text_key", "at", *(F.col(f"s.w{i}") for i in range(k)))
        t = t.select(*(F.split("token", " ")[i].alias(f"w{i}") for i in range(k)), F.xxhash64("token").alias("token_key"))
        hit = shingle.join(narrow(saved(t, "tokens")), [f"w{i}" for i in range(k)]).select("doc_id", "text_key", "at", "token_key")
        found = hit if found is None else found.union(hit)
    if found is None:  # no item has words
        return d.limit(0).select("doc_id", "text_key", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("item_ids"))
    # Repeated rows of a document give the same places again: collect_set keeps one.
    found = saved(found.groupBy("doc_id", "text_key", "token_key").agg(F.collect_set("at").alias("places")), "token-places")
    ids = saved(found.select("doc_id", "text_key").distinct(), "matched-documents")
    found = found.join(narrow(tokens.select(F.xxhash64("token").alias("token_key"), "windows")), "token_key").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("places", "windows")).alias("found"))
    d = d.join(narrow(ids), same_row(d, ids), "left_semi").dropDuplicates(["doc_id", "text_key"])
    d = d.join(found, same_row(d, found)).select(d["doc_id"], d["text_key"], words(F.col("text")).alias("w"), "found")
    tries = F.flatten(F.transform("found", lambda f: F.flatten(F.transform(f["windows"], lambda x: F.transform(f["places"], lambda p: F.struct((p - x["offset"]).alias("start"), x["size"].alias("size"), x["window"].alias("window"), x["items"].alias("items")))))))
    fits = F.filter(tries, lambda x: (x["start"] >= 0) & (x["start"] + x["size"] <= F.size("w")))
    same = F.filter(fits, lambda x: F.array_join(F.slice("w", F.greatest(x["start"], F.lit(0)) + 1, x["size"]), " ") == x["window"])
    d = d.select("doc_id", "text_key", same.alias("held")).where(F.size("held") > 0)
    spans = F.array_sort(F.transform("held", lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["size"]).alias("end"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(spans, start, lambda s, x: F.struct((s["n"] + F.greatest(x["end"] - F.greatest(x["start"], s["end"]), F.lit(0))).alias("n"), F.greatest(s["end"], x["end"]).alias("end")))
    return d.select("doc_id", "text_key", covered["n"].alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.transform("held", lambda x: x["items"])))).alias("item_ids"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, item_ids, contaminated) for each row of docs (doc_id, text) against items (item_id, text).

    A null text has no words; an item without words has no window; items that repeat or share an id count once;
    repeated documents give repeated results; null ids stay; empty tables give no rows or no hits. Other columns
    are left out.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hit = saved(matches(d, items, window), "hits")
    counted = d.select(*row_key(), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = counted.join(hit, same_row(counted, hit), "left").drop(hit["doc_id"]).drop(hit["text_key"])
    out = out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long"))).withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>")))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: how many of its words lie in windows of benchmark items, and of which items."""
    out = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), i AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[s+1:s+least(len(w), 10)], ' ') AS t
  FROM (SELECT *, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS s FROM b WHERE len(w) > 0)
), k AS (SELECT DISTINCT k FROM i),
p AS (SELECT doc_id, k, s, array_to_string(w[s+1:s+k], ' ') AS t FROM (SELECT doc_id, w, k, unnest(range(0, greatest(len(w) - k + 1, 0))) AS s FROM d, k)),
m AS (SELECT doc_id, s, p.k, item_id FROM p JOIN i ON p.k = i.k AND p.t = i.t),
h AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS x FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
