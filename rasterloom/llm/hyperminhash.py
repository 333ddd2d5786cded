"""Near-duplicate documents by HyperMinHash.

A document's set holds its distinct shingles of five words. Each of 200 buckets has a hash function of its own
and keeps, of the least hash, the count of leading zeros (6 bits) and the next 10 bits. Five registers make a
band. Documents that share a band are candidates; the registers' equal share, corrected for chance collisions,
estimates their Jaccard index, and what the estimate leaves is verified on the full sets.

Work in a band's group goes in rounds, so that large groups of near copies don't make all their pairs:
1. texts with equal sets are one node; 2. each node is verified against the least node of its bands with which
it shares most bands; 3. in groups that hold several components still, the full sets of blocks of nodes are
compared inside tasks, and only links that join two components come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import binary_parts, components, mix64, narrow, PrefixHash, read, saved, whole_groups

WORDS, BANDS, ROWS, MANTISSA = 5, 40, 5, 10
BUCKETS = BANDS * ROWS
#: A link has 100 * intersection >= THRESHOLD * union.
THRESHOLD = 75
#: Candidates with a lower estimate (4.5 standard errors below the threshold) are left to the comparison in blocks.
LEAST_ESTIMATE = 0.61
#: The sets of about so many nodes are compared with one another in a task.
BLOCK = 512
#: Bytes of text that are shingled at once (or one text).
SLICE = 1 << 20

_r = np.random.default_rng(7)
_A = _r.integers(0, 2**31, BUCKETS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _r.integers(0, 2**32, BUCKETS, dtype=np.uint32)
_C = [np.uint64(int(x) | 1) for x in _r.integers(1, 2**63, WORDS, dtype=np.uint64)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def slices(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE bytes."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE, "right")) - 1)
        yield i, j
        i = j


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word."""
    low = _LOWER[data]
    solid = ~_SPACE[low]
    first = np.zeros(len(low) + 1, bool)
    first[at] = True
    begin = solid & (np.concatenate([[True], ~solid[:-1]]) | first[:-1])
    end = solid & (np.concatenate([~solid[1:], [True]]) | first[1:])
    start = np.flatnonzero(begin)
    return mix64(PrefixHash(low).of(start, np.flatnonzero(end) + 1)), np.searchsorted(at, start, "right") - 1


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each distinct shingle, sorted. Fewer words than five are one shingle."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, doc = words_of(data, at)
    n = np.bincount(doc, minlength=len(at) - 1)
    full = max(0, len(h) - WORDS + 1)
    s = np.zeros(full, np.uint64)
    for k, c in enumerate(_C):
        s += h[k : k + full] * c
    whole = doc[:full] == doc[len(doc) - full :]
    few = np.flatnonzero((n > 0) & (n < WORDS))
    first = (np.cumsum(n) - n)[few]
    t = n[few].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k, c in enumerate(_C[:-1]):
        there = n[few] > k
        t[there] += h[first[there] + k] * c
    doc, s = np.concatenate([doc[:full][whole], few]), mix64(np.concatenate([s[whole], t]))
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], s[new]


def registers(s: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (texts x BUCKETS) of the sets that begin at starts in s."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    least = np.stack([np.minimum.reduceat(x * a + b, starts) for a, b in zip(_A, _B, strict=True)], axis=1)
    _, bits = np.frexp(least.astype(np.float64))
    zeros = (32 - bits).astype(np.uint64)
    after = ((least.astype(np.uint64) << (zeros + np.uint64(1))) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - MANTISSA)
    return (zeros << np.uint64(MANTISSA) | after).astype(np.uint16)


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard index from the share of equal registers of sets of n and m, without the collisions expected of different minima."""
    n, m = n.astype(np.float64), m.astype(np.float64)
    # The minima have densities n(1-x)^(n-1) and m(1-x)^(m-1); a register at x is x * 0.7213 / 2^MANTISSA wide on average.
    c = 0.7213 / 2**MANTISSA * n * m / np.maximum(1, (n + m) * (n + m - 1))
    return (equal - c) / (1 - c)


def _sketch(sets: bool):
    """Rows (doc_id, n, d1, d2, registers) of texts, or (node, n, registers, hashes) with their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = binary_parts(batch.column(1))
            for i, j in slices(at):
                doc, s = shingles(data[at[i] : at[j]], at[i : j + 1] - at[i])
                n = np.bincount(doc, minlength=j - i)
                some = np.flatnonzero(n)
                starts = (np.cumsum(n) - n)[some]
                found = registers(s, starts) if len(some) else np.zeros((0, BUCKETS), np.uint16)
                regs = np.full(j - i, None, object)
                regs[some] = [x.tobytes() for x in found]
                ids = batch.column(0).slice(i, j - i)
                if sets:
                    end = np.cumsum(n)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(regs, pa.binary()), pa.array([s[e - k : e].tobytes() for e, k in zip(end, n, strict=True)], pa.binary())], names=["node", "n", "registers", "hashes"])
                else:
                    d = np.zeros((2, j - i), np.uint64)
                    if len(some):
                        d[0, some] = np.add.reduceat(mix64(s), starts)
                        d[1, some] = np.add.reduceat(mix64(s ^ np.uint64(0xA0761D6478BD642F)), starts)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), *map(pa.array, d.astype(np.int64)), pa.array(regs, pa.binary())], names=["doc_id", "n", "d1", "d2", "registers"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v) that their sizes or their full sets decide, and whether they are linked; those of a low estimate are left open."""
    for batch in batches:
        n, m = batch.column("n_u").to_numpy(), batch.column("n_v").to_numpy()
        regs = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, BUCKETS) for k in ("registers_u", "registers_v")]
        sized = np.minimum(n, m) * 100 >= THRESHOLD * np.maximum(n, m)
        near = estimate((regs[0] == regs[1]).mean(axis=1), n, m) >= LEAST_ESTIMATE
        link = np.zeros(len(n), bool)
        for i in np.flatnonzero(near & sized):
            a, b = (np.frombuffer(batch.column(k)[int(i)].as_buffer(), np.uint64) for k in ("hashes_u", "hashes_v"))
            both = np.sort(np.concatenate([a, b]), kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            if 100 * common >= THRESHOLD * (len(a) + len(b) - common):
                link[i] = True
        ids = pa.array(np.flatnonzero(near | ~sized))
        yield pa.RecordBatch.from_arrays([batch.column("u").take(ids), batch.column("v").take(ids), pa.array(link).take(ids)], names=["u", "v", "link"])


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets (sorted arrays of distinct hashes)."""
    n = len(sets)
    every = np.concatenate(sets)
    of = np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(every, kind="stable")
    every, of = every[order], of[order]
    new = np.concatenate([[True], every[1:] != every[:-1]]) if len(every) else np.zeros(0, bool)
    which = np.cumsum(new) - 1
    twice = np.bincount(which)[which] > 1 if len(every) else new
    _, column = np.unique(which[twice], return_inverse=True)
    of = of[twice]
    out = np.zeros((n, n), np.float32)
    for low in range(0, int(column.max()) + 1 if len(column) else 0, 4096):
        i, j = np.searchsorted(column, [low, low + 4096])
        held = np.zeros((n, 4096), np.float32)
        held[of[i:j], column[i:j] - low] = 1
        out += held @ held.T  # counts below 2^24 are exact
    return out.astype(np.int64)


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between different components among the nodes of two blocks of a band: just enough to join them."""
    for table in whole_groups(batches, ["key", "left", "right"], 256):
        key, left, right, own, node, comp = (table.column(k).to_numpy() for k in ("key", "left", "right", "own", "node", "component"))
        data, at = binary_parts(table.column("hashes"))
        sets = [data[i:j].view(np.uint64) for i, j in zip(at[:-1], at[1:], strict=True)]
        size = np.diff(at) // 8
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
        us, vs = [], []
        for i, j in zip(new, [*new[1:], len(key)], strict=True):
            common = common_counts(sets[i:j])
            n, c = size[i:j], comp[i:j]
            link = (100 * common >= THRESHOLD * (n[:, None] + n[None, :] - common)) & (c[:, None] < c[None, :])
            if left[i] != right[i]:
                link &= own[i:j, None] != own[None, i:j]
            x, y = np.nonzero(link)
            _, first = np.unique(np.stack([c[x], c[y]]), axis=1, return_index=True)
            parent: dict[int, int] = {}
            for a, b in zip(x[first], y[first], strict=True):
                ends = []
                for k in (int(c[a]), int(c[b])):
                    while parent.get(k, k) != k:
                        k = parent[k]
                    ends.append(k)
                if ends[0] != ends[1]:
                    parent[ends[1]] = ends[0]
                    us.append(node[i + a])
                    vs.append(node[i + b])
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    component_id is the least doc_id that links lead to. A null or blank text has an empty set and is linked
    with nothing. Repeated rows have one id and so one component; rows that share an id are one node, with the
    links of all their texts. A row with a null id is never linked: component_id is null and kept is true. An
    empty table gives no rows. Other columns are left out.
    """
    d = docs.select("doc_id", F.encode("text", "utf-8").alias("bytes"))
    sketches = saved(d.mapInArrow(_sketch(False), "doc_id long, n long, d1 long, d2 long, registers binary"), "sketches")
    some = sketches.where("n > 0 and doc_id is not null")
    same = saved(some.groupBy("d1", "d2").agg(F.min("doc_id").alias("node")), "equal-sets")
    nodes = some.join(same.withColumnRenamed("node", "doc_id"), ["d1", "d2", "doc_id"], "left_semi").select(F.col("doc_id").alias("node"), "n", "registers").distinct()
    nodes = saved(nodes, "nodes")
    keys = F.array(*(F.xxhash64(F.lit(b), F.substring("registers", 1 + b * ROWS * 2, ROWS * 2)) for b in range(BANDS)))
    members = nodes.select("node", F.explode(keys).alias("key"))
    shared = members.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("most")).where("hub < most").select("key", "hub")
    members = saved(members.join(shared, "key").distinct(), "bands")
    candidates = saved(members.select("node").distinct(), "candidates")
    full = d.join(narrow(candidates), d["doc_id"] == candidates["node"], "left_semi").mapInArrow(_sketch(True), "node long, n long, registers binary, hashes binary")
    full = saved(full.where("n > 0"), "sets")

    hubs = members.where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("bands"))
    hubs = hubs.groupBy("node").agg(F.min(F.struct(-F.col("bands"), "hub")).alias("h")).select(F.col("h.hub").alias("u"), F.col("node").alias("v"))
    a, b = (full.select(*(F.col(c).alias(k if c == "node" else f"{c}_{k}") for c in full.columns)) for k in ("u", "v"))
    tried = saved(hubs.join(a, "u").join(b, "v").mapInArrow(_verify, "u long, v long, link boolean"), "decided")
    links = tried.where("link").select("u", "v").distinct()
    open_ = members.select("key", "node").join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = saved(open_, "open")
    groups = open_.groupBy("key").agg(F.count("*").alias("size"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("who"), F.min("component").alias("a"), F.max("component").alias("b"), F.min("node").alias("u"), F.max("node").alias("v")).where("a < b")
    # Bands with the same nodes are looked at once; a pair that was decided already isn't again.
    groups = groups.groupBy("size", "who").agg(F.min("key").alias("key"), F.min("u").alias("u"), F.max("v").alias("v"))
    tried = tried.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.lit(2).cast("long").alias("size"))
    groups = saved(groups.join(tried, ["u", "v", "size"], "left_anti").select("key", "size"), "open-groups")
    rows = open_.join(groups, "key").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.hash("node"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "own", "node", "component").join(full.select("node", "hashes"), "node")
    more = rows.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right").mapInArrow(_block_links, "u long, v long").distinct()
    links = links.union(saved(more, "links"))
    found = components(links)
    classes = saved(same.join(found, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("component_id")), "classes")
    out = sketches.withColumn("known", F.when(F.col("n").__gt__(0) & F.col("doc_id").isNotNull(), True)).join(classes.withColumn("known", F.lit(True)), ["d1", "d2", "known"], "left")
    component = F.coalesce("component_id", "doc_id")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents at a Jaccard index of 0.75 on shingles of five words."""
    return duplicates(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w
), n AS (SELECT doc_id, len(s) AS n FROM s), x AS (SELECT doc_id, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM x a JOIN x b USING (t) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v WHERE 100 * c >= 75 * (nu.n + nv.n - c)),
r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT n.doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, n.doc_id = component_id AS kept
FROM n JOIN (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u) USING (doc_id)
"""
