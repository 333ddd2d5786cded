"""Approximate nearest neighbours by NN-descent and greedy graph search; nearness is the inner product.

Data vectors get one more coordinate, sqrt(greatest norm^2 - norm^2), so that among them the nearest by inner product
are the nearest by distance; queries have 0 there, so their order is that of the plain inner product. Equal vectors are
one node that stands for its least ids.

1. Start: a forest of random projection trees, fitted on a bounded sample, deals all nodes into leaves of about
   LEAF nodes; each leaf finds the nearest ones of its nodes within it. Beyond what the sample can split, leaves are dealt
   by a hash: the start is then worse and takes more rounds to mend.
2. NN-descent: each node's list is joined with the lists of its neighbours (and of the nodes that list it); the
   neighbours of neighbours are scored and the best stay. Rounds go on until few entries change.
3. Search: each query starts from the best of its node's list, the nodes of greatest norm and a bounded number of nodes
   from all over, as clusters may have no links between them; again and again the lists of the best nodes that weren't
   opened yet are scored, until the best BEAM are all open.

Scores are computed by blocks of nodes: candidate ids travel to the block that holds their vectors, with one copy of
the asking vector for each block, and never a vector for each pair. A node's number names its block. The nodes
that every query starts from are scored where the queries are. Graph and search use single precision;
the scores returned don't.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import discard, narrow, read, saved, whole_groups

#: Length of a node's list, nodes of a list that a round opens, and entries of theirs that it reads.
LIST, OPENED, READ = 32, 12, 16
TREES, LEAF, SAMPLE = 6, 256, 8192
#: Neighbouring leaves of the first tree whose vectors are a block. Wider blocks need fewer copies of asking vectors.
BLOCK_LEAVES = 64
#: Bits of a node's number below its block's.
BITS = 32
#: Nodes that a search keeps for each query; nodes of greatest norm and nodes from all over (by a hash) that it starts from.
BEAM, TOPS, ENTRIES = 128, 16, 1024
#: The share of changed entries below which the rounds of NN-descent end.
CHANGED = 0.05
#: Asking vectors of a block that are scored in one task; more are dealt to copies of the block.
ASKING = 16_384

_LISTS = "node long, ids array<long>, sims array<double>, open array<boolean>"


def _matrix(column) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(node: np.ndarray, of: np.ndarray, ids: np.ndarray, sims: np.ndarray, open_: np.ndarray) -> pa.RecordBatch:
    """A row for each node; of: the place in node of each entry, sorted."""
    ends = pa.array(np.searchsorted(of, np.arange(len(node) + 1)), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(node), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in (ids, sims.astype(np.float64), open_))], names=["node", "ids", "sims", "open"])


def forest(sample: np.ndarray, n: int, trees: int = TREES, leaf: int = LEAF) -> list[list[tuple]]:
    """Trees as lists of (direction, threshold, left, right) or (None, parts, first part number, 0) for leaves."""
    r = np.random.default_rng(5)
    out = []
    for _ in range(trees):
        tree: list[tuple] = []
        parts = 0
        todo = [(np.arange(len(sample)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            me = len(tree)
            if parent >= 0:
                p = list(tree[parent])
                p[2 + side] = me
                tree[parent] = tuple(p)
            here = len(rows) / max(1, len(sample)) * n
            split = None
            if here > leaf and len(rows) >= 16:
                a, b = sample[r.choice(rows, 2, replace=False)]
                x = sample[rows] @ (a - b)
                at = np.median(x)
                if (x <= at).any() and (x > at).any():
                    split = (a - b, at, x <= at)
            if split is None:
                k = max(1, int(np.ceil(here / (1.25 * leaf))))
                tree.append((None, k, parts, 0))
                parts += k
            else:
                tree.append((split[0], split[1], 0, 0))
                todo += [(rows[split[2]], me, 0), (rows[~split[2]], me, 1)]
        out.append(tree)
    return out


def _leaves(x: np.ndarray, node: np.ndarray, tree: list[tuple]) -> np.ndarray:
    """The leaf of each row; leaves that the sample can't split further are dealt by a hash of the node."""
    out = np.zeros(len(x), np.int64)
    todo = [(0, np.arange(len(x)))]
    while todo:
        i, rows = todo.pop()
        d, at, left, right = tree[i]
        if d is None:
            h = (node[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            out[rows] = left + (h % np.uint64(at)).astype(np.int64)
        else:
            low = x[rows] @ d <= at
            todo += [(left, rows[low]), (right, rows[~low])]
    return out


def _place(trees: list[list[tuple]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, node = _matrix(b.column("x")), b.column("node").to_numpy()
                at = np.stack([_leaves(x, node, t) for t in trees], axis=1)
                leaves = pa.ListArray.from_arrays(pa.array(np.arange(0, at.size + 1, at.shape[1]), pa.int32()), pa.array(at.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("node"), b.column("x"), leaves], names=["node", "x", "leaves"])

    return run


def _best(s: np.ndarray, k: int) -> np.ndarray:
    k = min(k, s.shape[1])
    return np.argpartition(-s, k - 1, axis=1)[:, :k] if k else np.zeros((len(s), 0), np.int64)


def _within_leaf(table: pa.Table) -> pa.Table:
    x, node = _matrix(table.column("x")), table.column("node").to_numpy()
    of, ids, sims = [], [], []
    for i in range(0, len(x), 256):
        s = x[i : i + 256] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        best = _best(s, min(LIST, len(x) - 1))
        of.append(np.repeat(np.arange(i, i + len(s)), best.shape[1]))
        ids.append(node[best].ravel())
        sims.append(np.take_along_axis(s, best, axis=1).ravel())
    sims = np.concatenate(sims)
    return pa.Table.from_batches([_lists(node, np.concatenate(of), np.concatenate(ids), sims, np.zeros(len(sims), bool))])


def _merge(k: int):
    """The k best entries of all lists of a node; an entry is open if it is so in any list. Counts those not open, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["node"]):
            node, place = np.unique(table.column("node").to_numpy(), return_inverse=True)
            lists = table.column("ids").combine_chunks()
            of = np.repeat(place, lists.value_lengths().to_numpy())
            ids, sims, open_ = (table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("ids", "sims", "open"))
            o = np.lexsort((~open_.astype(bool), ids, of))
            o = o[np.concatenate([[True], (ids[o][1:] != ids[o][:-1]) | (of[o][1:] != of[o][:-1])])] if len(o) else o
            o = o[np.lexsort((ids[o], -sims[o], of[o]))]
            first = np.searchsorted(of[o], np.arange(len(node)))
            o = o[np.arange(len(o)) - first[of[o]] < k]
            yield _lists(node, of[o], ids[o], sims[o], open_[o].astype(bool))

    return run


def merged(lists: DataFrame, k: int) -> DataFrame:
    return lists.repartition("node").sortWithinPartitions("node").mapInArrow(_merge(k), _LISTS)


def _score(asked: pa.Table, block: pa.Table) -> pa.Table:
    """Scores of the candidates of a block: asked has a vector and ids, block the vectors of ids."""
    if not asked.num_rows or not block.num_rows:
        return pa.Table.from_batches([_lists(*(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.float64, bool)))])
    node, x = block.column("node").to_numpy(), _matrix(block.column("x"))
    order = np.argsort(node)
    node, x = node[order], x[order]
    q = _matrix(asked.column("x"))
    lists = asked.column("ids").combine_chunks()
    of = np.repeat(np.arange(asked.num_rows), lists.value_lengths().to_numpy())
    ids = lists.flatten().to_numpy()
    at = np.searchsorted(node, ids)
    sims = np.concatenate([np.einsum("ij,ij->i", q[of[i : i + 65536]], x[at[i : i + 65536]]) for i in range(0, len(of), 65536)])
    return pa.Table.from_batches([_lists(asked.column("node").to_numpy(), of, ids, sims, np.zeros(len(of), bool))])


def salts(asked: DataFrame) -> DataFrame:
    """(block, salts): how many copies of each block that asked (node, block) needs for about ASKING asking vectors each."""
    return asked.groupBy("block").agg(F.ceil(F.count("*") / ASKING).cast("int").alias("salts"))


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each node and block of its ids."""
    for b in batches:
        lists = b.column("ids")
        of, ids = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        block = ids >> BITS
        o = np.lexsort((block, of))
        of, ids, block = of[o], ids[o], block[o]
        first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (block[1:] != block[:-1])])) if len(of) else np.zeros(0, np.int64)
        ends = pa.array(np.append(first, len(of)), pa.int32())
        yield pa.RecordBatch.from_arrays([b.column("node").take(pa.array(of[first])), pa.array(block[first]), pa.ListArray.from_arrays(ends, pa.array(ids))], names=["node", "block", "ids"])


def scored(wanted: DataFrame, asking: DataFrame, nodes: DataFrame) -> DataFrame:
    """Lists of (ids, sims) for wanted (node, ids); asking has the vectors of the nodes that ask.

    A block that many nodes ask is copied, and each copy answers a part of them, so that no task has more than about
    ASKING vectors besides those of a block.
    """
    pairs = saved(wanted.mapInArrow(_by_block, "node long, block long, ids array<long>"), "asked-blocks")
    copies = narrow(salts(pairs))
    pairs = pairs.join(copies, "block").withColumn("salt", F.pmod(F.xxhash64("node"), "salts").cast("int")).join(asking.select("node", "x"), "node")
    held = nodes.select("node", "x", F.shiftright("node", BITS).alias("held")).join(copies.withColumnRenamed("block", "held"), "held")
    held = held.select("node", "x", "held", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("copy")).toDF("node", "x", "held", "copy")
    return pairs.select("node", "ids", "x", "block", "salt").toDF("node", "ids", "x", "block", "salt").groupBy("block", "salt").cogroup(held.groupBy("held", "copy")).applyInArrow(_score, _LISTS)


def scored_here(at: np.ndarray, y: np.ndarray):
    """Lists of the best of the nodes at (vectors y) for each row (node, x), itself left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                node = b.column("node").to_numpy()
                sims = _matrix(b.column("x")).astype(np.float64) @ y.T
                sims[node[:, None] == at[None, :]] = -np.inf
                best = _best(sims, BEAM)
                found = np.take_along_axis(sims, best, axis=1)
                of, k = np.nonzero(found > -np.inf)
                yield _lists(node, of, at[best[of, k]], found[of, k], np.zeros(len(of), bool))

    return run


def neighbours_of(opened: DataFrame, graph: DataFrame) -> DataFrame:
    """(node, ids): the entries of the lists of the nodes that each node opens; opened is (node, id)."""
    lists = graph.select(F.col("node").alias("id"), "ids")
    return opened.join(lists, "id").groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))


def both_ways(lists: DataFrame, k: int) -> DataFrame:
    """(node, ids): the first k entries of each list and at most k nodes that list it, the nearest first."""
    flat = lists.select("node", F.posexplode(F.arrays_zip("ids", "sims")).alias("at", "e")).select("node", "at", "e.ids", "e.sims")
    near = Window.partitionBy("ids").orderBy(F.desc("sims"), "node")
    back = flat.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).select(F.col("ids").alias("node"), F.col("node").alias("ids"))
    return flat.where(F.col("at") < k).select("node", "ids").union(back).groupBy("node").agg(F.collect_set("ids").alias("ids"))


def build(nodes: DataFrame) -> DataFrame:
    """The neighbour graph (node, ids, sims, open) of nodes (node, x, leaves)."""
    placed = nodes.select("node", "x", F.posexplode("leaves").alias("tree", "leaf"))
    start = placed.groupBy("tree", "leaf").applyInArrow(_within_leaf, _LISTS)
    graph = saved(merged(start, LIST), "graph")
    while True:
        links, last = saved(both_ways(graph, READ), "graph-links"), graph
        opened = graph.select("node", F.explode(F.slice("ids", 1, OPENED)).alias("id"))
        wanted = neighbours_of(opened, links).join(graph.select("node", F.col("ids").alias("had")), "node")
        wanted = wanted.select("node", F.array_except(F.array_except("ids", "had"), F.array("node")).alias("ids"))
        # What a round adds isn't open; what was there is.
        old = graph.withColumn("open", F.transform("ids", lambda i: F.lit(True)))
        graph = saved(merged(old.union(scored(wanted, nodes, nodes)), LIST), "graph")
        discard(links, last)
        new, every = graph.select(F.sum(F.size(F.filter("open", lambda o: ~o))), F.sum(F.size("ids"))).first()
        if (new or 0) <= CHANGED * (every or 0):
            break
    return graph


def search(queries: DataFrame, graph: DataFrame, nodes: DataFrame, entries: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Pools (node, ids, sims, open) of the BEAM best nodes for each query (node, x), itself left out."""
    links = saved(both_ways(graph, LIST), "search-links")
    start = scored(queries.select("node").join(graph.select("node", "ids"), "node"), queries, nodes)
    pool = saved(merged(start.union(queries.mapInArrow(scored_here(*entries), _LISTS)), BEAM), "pool")
    while True:
        opened = pool.select("node", F.explode(F.filter(F.arrays_zip("ids", "open"), lambda e: ~e["open"])).alias("e")).select("node", F.col("e.ids").alias("id"))
        wanted = neighbours_of(opened, links).join(pool.select("node", F.col("ids").alias("had")), "node")
        wanted = saved(wanted.select("node", F.array_except(F.array_except("ids", "had"), F.array("node")).alias("ids")).where(F.size("ids") > 0), "wanted")
        old = pool.withColumn("open", F.transform("ids", lambda i: F.lit(True)))
        if wanted.isEmpty():
            return old
        pool, last = saved(merged(old.union(scored(wanted, queries, nodes)), BEAM), "pool"), pool
        discard(last, wanted)


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision, in the order of the components."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of vectors (vec_id, embedding) that is_query holds for.

    Vectors that are null, empty, zero, of other than the commonest length (the greatest of equally common ones), or with null or non-finite components take no part,
    nor do null ids. Of an id's different vectors the least counts; repeated rows count once. Ties go to the smaller id.
    With fewer than k candidates all are returned; an empty table gives no rows. Other columns are left out.
    """
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("embedding", lambda c: c != 0)
    v = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    v = saved(v.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("norm2", dot("embedding", "embedding")), "vectors")
    common = v.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    longest = common["n"] if common else 0
    v = v.where(F.size("embedding") == longest)
    most = v.select(F.max("norm2")).first()[0] or 0.0
    # A node for each different vector, with its k + 1 least ids: a query needs no more of them.
    ids = v.withColumn("r", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    nodes = ids.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.min("norm2").alias("norm2"), F.sort_array(F.collect_list("vec_id")).alias("vec_ids"))
    nodes = saved(nodes.withColumn("last", F.sqrt(F.greatest(F.lit(0.0), F.lit(most) - F.col("norm2")))), "vector-nodes")
    x = F.concat(F.col("embedding").cast("array<double>"), F.array("last"))
    sample = _matrix(nodes.orderBy(F.xxhash64("first"), "first").limit(SAMPLE).select(x.alias("x")).toArrow().column("x")) if longest else np.zeros((0, 1))
    trees = forest(sample, nodes.count())
    placed = nodes.select(F.col("first").alias("node"), x.cast("array<float>").alias("x")).mapInArrow(_place(trees), "node long, x array<float>, leaves array<long>")
    placed = placed.withColumn("block", F.floor(F.col("leaves")[0] / BLOCK_LEAVES))
    own = F.row_number().over(Window.partitionBy("block").orderBy("node")).cast("long")
    placed = saved(placed.select(F.col("node").alias("first"), (F.shiftleft("block", BITS) + own).alias("node"), "x", "leaves"), "vector-blocks")
    nodes = saved(nodes.join(placed.select("first", "node"), "first"), "numbered-nodes")
    graph = build(placed.select("node", "x", "leaves"))
    some = nodes.select("node", x.alias("x"), "norm2", "first")
    some = some.orderBy(F.desc("norm2"), "first").limit(TOPS).union(some.orderBy(F.xxhash64("first"), "first").limit(ENTRIES)).dropDuplicates(["node"]).toArrow()
    entries = (some.column("node").to_numpy(), _matrix(some.column("x"))) if some.num_rows else (np.zeros(0, np.int64), np.zeros((0, longest + 1)))
    asked = saved(v.where(is_query).join(nodes.select("embedding", "node"), "embedding").select(F.col("vec_id").alias("query_id"), "node"), "asked")
    zero = F.transform("x", lambda c, i: F.when(i < longest, c).otherwise(F.lit(0.0).cast("float")))
    queries = saved(asked.select("node").distinct().join(placed, "node").select("node", zero.alias("x")), "queries")
    pool = search(queries, graph, placed.select("node", "x"), entries)
    found = pool.select("node", F.explode(F.slice("ids", 1, 2 * k)).alias("id")).union(queries.select("node", F.col("node").alias("id")))
    found = found.join(nodes.select(F.col("node").alias("id"), F.col("embedding").alias("other"), "vec_ids"), "id").join(nodes.select("node", "embedding"), "node")
    found = found.select("node", F.struct((-dot("embedding", "other")).alias("away"), "vec_ids").alias("e")).groupBy("node").agg(F.collect_list("e").alias("e"))
    # Equal scores of different vectors go by id too, so the lists are flattened before they are sorted.
    flat = F.sort_array(F.flatten(F.transform("e", lambda e: F.transform(e["vec_ids"], lambda i: F.struct(e["away"].alias("away"), i.alias("vec_id"))))))
    found = found.select("node", F.slice(flat, 1, k + 1).alias("e"))
    out = asked.join(found, "node").select("query_id", F.slice(F.filter("e", lambda e: e["vec_id"] != F.col("query_id")), 1, k).alias("e"))
    return out.select("query_id", F.posexplode("e").alias("at", "e")).select("query_id", (F.col("at") + 1).alias("rank"), "e.vec_id", (-F.col("e.away")).alias("score"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector, searched in a graph over all vectors."""
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
