"""URL filter: rules on hosts and paths, and for the rest a naive Bayes score of segmented host and path words.

Runs of letters of hosts and paths are cut into words by unigram Viterbi, each different run once: its substrings are joined with
the dictionary (words of all visible page text, counted), and the arcs found, sorted by place, are relaxed from left to right. Pages
whose words hold one of the seed words are the first class of a multinomial naive Bayes model, all others the second; the model
counts every word of every page, so that words which keep company with seeds come to weigh as well.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import ascii_lower, narrow, read, saved

# The rules (verdict, host, path) of the query.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
# Words of gambling, adult, pharmacy, advertising, malware and loan sites, by which the first class is seeded.
SEEDS = (
    "casino poker roulette jackpot lottery slots betting bets sportsbook bingo gambling "
    "adult porn porno xxx sex sexy nude escort hentai milf erotic camgirls "
    "pills viagra cialis pharmacy xanax tramadol steroids "
    "spam ads adserver adserv popunder popup banners clickbait doorway "
    "malware phishing keygen warez torrent cracked "
    "payday loans replica counterfeit forex"
).split()
# Common words of names, which the text of pages may lack.
COMMON = (
    "about app art best big blog book books buy car center cheap city club cloud code daily data day deal deals design direct "
    "dog drug easy farm fashion fast film find food forum free fun game games gift global gold good great green group guide "
    "health help home host hot house info job jobs kids land learn life link list live local love market media mobile money music "
    "my net new news now one online open page park party pet photo place play post price pro quick radio sale school search "
    "shop site smart soft sport sports star store team tech test the time tips top tour town track travel trip video watch web "
    "wiki win winner wine work world your zone "
    "adults alphabet beads downloads essex heads leads loads reads roads sussex threads uploads"
).split()

#: Words of the dictionary have so many letters at most and occur so often at least; listed words count as such a share of all words at least (a million words are added to the total, so that this is one).
LONGEST, LEAST_COUNT, LISTED = 24, 3, 1e-6
#: Weight, in words, of the words of both classes in the estimate of each.
SMOOTHING = 100.0
#: Runs of letters are looked up in pieces of so many letters.
PIECE = 1_000


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both are empty for a null url or one without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def dictionary(html: DataFrame) -> DataFrame:
    """(word, cost, unknown) from a column html: cost is the negative logarithm of the word's share; unknown (the same in each row) that of one occurrence."""
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>|&\w+;", " ")
    words = html.select(F.explode(F.split(ascii_lower(text), r"[^\p{L}]+")).alias("word")).where(F.col("word").rlike(f"^[a-z]{{1,{LONGEST}}}$"))
    counts = saved(words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT), "words")
    total = float(counts.agg(F.sum("n")).first()[0] or 0) + 1 / LISTED
    listed = html.sparkSession.createDataFrame([(w, total * LISTED) for w in sorted({*SEEDS, *COMMON})], "word string, n double")
    both = counts.select("word", F.col("n").cast("double")).union(listed).groupBy("word").agg(F.max("n").alias("n"))
    return saved(both.select("word", (math.log(total) - F.log("n")).alias("cost"), F.lit(math.log(total)).alias("unknown")), "dictionary")


class _Lattice:
    """Least-cost cut of one run of letters; arcs come in by place. An unknown stretch costs the unknown price once and ten-fold for each letter."""

    def __init__(self, run: str, unknown: float):
        self.run, self.unknown, self.at = run, unknown, 0
        n = len(run)
        self.best, self.start = [0.0] + [math.inf] * n, [0] * (n + 1)
        self.odd, self.odd_start = math.inf, 0

    def to(self, place: int) -> None:
        """All arcs that start before the place are in: unknown stretches are carried on to it."""
        for p in range(self.at, place):
            if self.best[p] + self.unknown < self.odd:
                self.odd, self.odd_start = self.best[p] + self.unknown, p
            self.odd += math.log(10)
            if self.odd < self.best[p + 1]:
                self.best[p + 1], self.start[p + 1] = self.odd, self.odd_start
        self.at = max(self.at, place)

    def arc(self, place: int, length: int, cost: float) -> None:
        self.to(place)
        end, whole = place + length, self.best[place] + cost
        # Ties: the longer word.
        if whole < self.best[end] or whole == self.best[end] and place < self.start[end]:
            self.best[end], self.start[end] = whole, place

    def words(self) -> list[str]:
        self.to(len(self.run))
        found, end = [], len(self.run)
        while end:
            found.append(self.run[self.start[end] : end])
            end = self.start[end]
        return found[::-1]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, place, length, cost, unknown), all of a run by place behind a first row of place -1, the only one that holds the run -> (run, words)."""
    now: _Lattice | None = None
    for batch in batches:
        runs, cut = [], []
        for run, place, length, cost, unknown in zip(*(batch.column(c).to_pylist() for c in ("run", "place", "length", "cost", "unknown")), strict=True):
            if place >= 0:
                now.arc(place, length, cost)
                continue
            if now is not None:
                runs.append(now.run)
                cut.append(now.words())
            now = _Lattice(run, unknown)
        yield pa.RecordBatch.from_arrays([pa.array(runs, pa.string()), pa.array(cut, pa.list_(pa.string()))], names=["run", "words"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now.run]), pa.array([now.words()], pa.list_(pa.string()))], names=["run", "words"])


def segmented(runs: DataFrame, words: DataFrame) -> DataFrame:
    """(run, words) for the different runs of a column run: the cut of least cost by the dictionary. Runs may be of any length.

    The arcs of a run of n letters are 24 n rows at most; they are sorted by place and read as they come, so that a task holds three numbers for each letter.
    """
    unknown = words.select("unknown").first()[0]
    runs = saved(runs.where("run <> ''").select("run").distinct().select(F.monotonically_increasing_id().alias("id"), "run"), "runs")
    # Pieces of long runs overlap by a word; a place belongs to one of them.
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("run") - 1) / PIECE).cast("int")), lambda i: F.substring("run", i * PIECE + 1, F.lit(PIECE + LONGEST)))
    p = runs.select("id", F.posexplode(cut).alias("piece", "text"))
    p = p.select("id", "piece", "text", F.explode(F.sequence(F.lit(1), F.least(F.length("text"), F.lit(PIECE)))).alias("at"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("text") - F.col("at") + 1))
    p = p.select("id", (F.col("piece") * PIECE + F.col("at") - 1).alias("place"), F.explode(F.transform(sizes, lambda n: F.substring(F.col("text"), F.col("at"), n))).alias("word"))
    arcs = p.join(narrow(words), "word").select("id", F.lit(None).cast("string").alias("run"), "place", F.length("word").alias("length"), "cost")
    heads = runs.select("id", "run", F.lit(-1).alias("place"), F.lit(0).alias("length"), F.lit(0.0).alias("cost"))
    rows = heads.union(arcs).withColumn("unknown", F.lit(unknown)).repartition("id").sortWithinPartitions("id", "place", "length")
    return rows.select("run", "place", "length", "cost", "unknown").mapInArrow(_cut, "run string, words array<string>")


def ruled(hosts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, rules) for the hosts, each once, that are one of the rules' hosts or below it: array of (size, path, rule, verdict)."""
    table = hosts.sparkSession.createDataFrame([(h, p, h + p, v, len(h + p)) for v, h, p in rules], "suffix string, path string, rule string, verdict string, size int")
    labels = max((h.count(".") + 1 for _, h, _ in rules), default=1)
    tails = F.array_distinct(F.array(*(F.substring_index("host", ".", -i) for i in range(1, labels + 1))))
    found = hosts.select("host", F.explode(tails).alias("suffix")).join(F.broadcast(table), "suffix")
    return found.groupBy("host").agg(F.collect_list(F.struct("size", "path", "rule", "verdict")).alias("rules"))


def _parts(kind: str, pages: DataFrame) -> DataFrame:
    """(kind, part, runs) for the different hosts or paths."""
    return pages.select(F.lit(kind).alias("kind"), F.col({"h": "host", "p": "path"}[kind]).alias("part")).distinct().withColumn("runs", F.regexp_extract_all(F.lower("part"), F.lit("[a-z]+"), F.lit(0)))


def scored(pages: DataFrame, words: DataFrame) -> tuple[DataFrame, float]:
    """(kind, part, weight) for each different host (h) and path (p) of pages (host, path, n), and the logarithm of the prior odds.

    The weight is the sum, over the part's words, of the logarithm of the ratio of their probabilities in the two classes.
    """
    parts = saved(_parts("h", pages).union(_parts("p", pages)), "url-parts")
    each = parts.select("kind", "part", F.explode("runs").alias("run"))
    cut = saved(segmented(each, words), "url-words")
    tokens = saved(each.join(narrow(cut), "run").select("kind", "part", F.explode("words").alias("word")).groupBy("kind", "part", "word").agg(F.count("*").alias("times")), "url-tokens")
    seeded = saved(tokens.where(F.col("word").isin(SEEDS)).select("kind", "part").distinct(), "url-seeded")

    def bad(kind: str, name: str) -> DataFrame:
        return narrow(seeded.where(F.col("kind") == kind).select(F.col("part").alias(name), F.lit(1).alias(f"bad_{kind}")))

    first = pages.join(bad("h", "host"), "host", "left").join(bad("p", "path"), "path", "left")
    first = saved(first.select("host", "path", "n", F.coalesce("bad_h", "bad_p", F.lit(0)).alias("bad")), "url-classes")
    n1, n0 = F.sum(F.col("n") * F.col("bad")).alias("n1"), F.sum(F.col("n") * (1 - F.col("bad"))).alias("n0")
    counts = first.groupBy(F.lit("h").alias("kind"), F.col("host").alias("part")).agg(n1, n0).union(first.groupBy(F.lit("p").alias("kind"), F.col("path").alias("part")).agg(n1, n0))
    model = saved(tokens.join(counts, ["kind", "part"]).groupBy("kind", "word").agg(F.sum(F.col("n1") * F.col("times")).alias("n1"), F.sum(F.col("n0") * F.col("times")).alias("n0")), "url-model")
    t1, t0 = (float(x or 0) for x in model.agg(F.sum("n1"), F.sum("n0")).first())
    p1, p0 = (float(x or 0) for x in first.agg(n1, n0).first())
    share = SMOOTHING * (F.col("n1") + F.col("n0")) / max(t1 + t0, 1.0)
    ratio = F.log((F.col("n1") + share) / (t1 + SMOOTHING)) - F.log((F.col("n0") + share) / (t0 + SMOOTHING))
    weights = saved(model.select("kind", "word", ratio.alias("ratio")), "url-weights")
    weight = tokens.join(narrow(weights), ["kind", "word"]).groupBy("kind", "part").agg(F.sum(F.col("times") * F.col("ratio")).alias("weight"))
    return saved(weight, "url-weight"), math.log((p1 + 1) / (p0 + 1))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages (all its columns, of which url and html are read) with host, path, rule, verdict and score (the probability of block without rules).

    The longest rule that fits decides: it fits its host and all below it where the path starts with the rule's. Without one, block
    if the naive Bayes odds of it are over 1. A null url and one without "://" have an empty host and path and no words, as have
    hosts of digits only: the prior decides. A null html adds nothing to the dictionary. Urls and pages of any length are
    read whole. Repeated rows stay. An empty table gives no rows. Columns of the new names are replaced.
    """
    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score")]
    host, path = parsed(F.col("url"))
    p = pages.select(*rest, host.alias("host"), path.alias("path"))
    different = saved(p.groupBy("host", "path").agg(F.count("*").alias("n")), "urls")
    weight, prior = scored(different, dictionary(pages.select("html")))
    of = lambda kind, name: weight.where(F.col("kind") == kind).select(F.col("part").alias(name), F.col("weight").alias(f"weight_{kind}"))
    by_host = different.select("host").distinct()
    by_host = saved(by_host.join(ruled(by_host, rules), "host", "left").join(of("h", "host"), "host", "left"), "hosts")
    by_path = saved(of("p", "path"), "paths")
    out = p.join(narrow(by_host), "host", "left").join(narrow(by_path), "path", "left")
    fits = F.array_max(F.filter("rules", lambda r: F.col("path").startswith(r["path"])))
    odds = F.lit(prior) + F.coalesce("weight_h", F.lit(0.0)) + F.coalesce("weight_p", F.lit(0.0))
    out = out.withColumn("fits", fits).withColumn("score", F.round(1 / (1 + F.exp(-odds)), 6))
    verdict = F.coalesce("fits.verdict", F.when(odds > 0, "block").otherwise("allow"))
    return out.select(*rest, "host", "path", F.col("fits.rule").alias("rule"), verdict.alias("verdict"), "score")


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host and path, the rule that decides, if any, and the verdict."""
    return judge(read(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("url", "html")
