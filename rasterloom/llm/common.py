"""Helpers that the operators share: reading, written tables, checked broadcasts and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of so many bytes may be broadcast; beyond it Spark's own shuffled join is used.
BROADCAST_BYTES = 16 << 20
#: While it is true, the shuffle files of a query go when the query ends, not when the driver collects its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a new local one only where that is unset and the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def saved(df: DataFrame, name: str, *by: str) -> DataFrame:
    """The same rows from a written table: cuts lineage and survives the loss of executors. What the write shuffled is deleted when it ends.

    by: columns whose values have folders of their own, so that a part can be read alone.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def size_of(df: DataFrame) -> int:
    """Bytes of the files of a saved table."""
    paths = [df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder) for folder in {f.rpartition("/")[0] for f in df.inputFiles()}]
    return sum(p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(p).getLength() for p in paths)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of saved tables from which nothing is read any more."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def narrow(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a saved narrow table for broadcast if its summed size allows it."""

    def width(c: str, kind: str):
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(c), F.lit(0))
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) if "<" in kind else F.lit(8)

    size = df.agg(F.sum(sum((width(*x) for x in df.dtypes), F.lit(16)))).first()[0]
    return F.broadcast(df) if (size or 0) <= limit else df


def ascii_lower(col):
    """Lower-cases A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key() -> list:
    """Key columns of a document row: its id and a hash of its text, so that rows that share an id don't mix."""
    return [F.col("doc_id"), F.xxhash64("text").alias("text_key")]


def same_row(a: DataFrame, b: DataFrame):
    """Join condition on the key columns; a null id equals a null id."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (u, v): component is the smallest node that can be reached.

    Alternating large-star and small-star rounds: each is a grouped minimum (combined before the shuffle) and
    an equi-join, so a node with very many edges needs no task of its own. Ends when the edges stay the same.
    """
    u, v = F.col("u"), F.col("v")
    e = edges.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v"))
    e, before = saved(e.distinct(), "edges"), None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            return e.select(v.alias("node"), u.alias("component")).union(e.select(u, u)).groupBy("node").agg(F.min("component").alias("component"))
        before = now
        both = e.select(u, v).union(e.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(v > u).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a").where(F.col("b") != F.col("m")).select(F.col("m").alias("u"), F.col("b").alias("v"))
        last, e = e, saved(small.union(root.select(F.col("m"), F.col("a"))).distinct(), "edges")
        discard(last)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 4096) -> Iterator[pa.Table]:
    """Joins the batches of a partition sorted by keys into tables that hold whole groups."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held)
        last = np.zeros(table.num_rows, bool)
        for k in keys:
            x = table.column(k).to_numpy()
            last |= x != x[-1]
        cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
        held, rows = rest.to_batches(), rest.num_rows
    if rows:
        yield pa.Table.from_batches(held)


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, end to end, and the n + 1 offsets in them (a null is empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


class PrefixHash:
    """Polynomial prefix hashes of a byte buffer modulo 2^64, with a random weight for each byte value."""

    BASE = 0x9E3779B97F4A7C15
    _byte = np.random.default_rng(20_240_601).integers(1, 2**63, 256, dtype=np.uint64)
    _power = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        self._grow(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self._byte[data] * self._power[: len(data)], out=self.sums[1:])

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls._power) < n:
            n = max(n, 1 << 16)
            cls._power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, cls.BASE, np.uint64))])
            cls._inverse = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, pow(cls.BASE, -1, 2**64), np.uint64))])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the substrings [start, end): equal strings have equal hashes wherever they stand."""
        return (self.sums[end] - self.sums[start]) * self._inverse[start]
