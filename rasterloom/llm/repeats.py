"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if it lies in a string of `width` bytes that also starts anywhere else. The steps:

1. Each start of a window of `width` bytes is assigned to the anchor of the window: the leftmost of its
   substrings of width/2 bytes with the least hash. Equal windows have equal anchors at equal offsets, so only starts whose
   anchor hash occurs twice can be repeated, and neighbouring starts that share an anchor form one row.
2. Rows whose whole range of bytes is equal to another row's are repeated whole (grouped counts in Spark). Equal is
   what has the same BLAKE2 digest of 128 bits: nothing goes because of the short polynomial hashes alone.
3. For the rest, the suffixes at the anchors are sorted, to the right and (reversed) to the left, by mergesort.
   Two suffixes are compared in logarithmic time: binary search over prefix polynomial hashes finds their
   common extension. Common extensions of neighbours are verified byte by byte. The start j bytes before an
   anchor is repeated if another row shares at least j bytes to the left and width - j to the right, that is,
   stands in the same stretch of both sorted orders.

Sorting the suffixes of every byte would need about nine times the input on disk; step 1 leaves about 1/100 of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import PrefixHash, binary_parts, discard, mix64, narrow, read, row_key, same_row, saved, whole_groups

WIDTH = 400
#: Anchors with more different surroundings than this aren't sorted in one task; their windows are grouped by Spark, by digests.
TASK_ROWS = 50_000
#: Starts for which one pass over a long text finds anchors.
CHUNK = 1 << 22


def _slide_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :])


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, also: np.ndarray) -> np.ndarray:
    """BLAKE2 digests of the strings [start, end), each together with a number; 2 x n uint64."""
    view, also = memoryview(np.ascontiguousarray(data)), also.astype(np.int64)
    found = b"".join(hashlib.blake2b(view[i:j], digest_size=16, salt=k.to_bytes(16, "little")).digest() for i, j, k in zip(start.tolist(), end.tolist(), also.tolist(), strict=True))
    return np.frombuffer(found, np.uint64).reshape(-1, 2).T


def anchor_rows(text: np.ndarray, width: int) -> np.ndarray:
    """Rows (anchor hash, digest of the whole range in two halves, anchor position, first start, last start) of one text, 6 x n uint64."""
    gram = width // 2
    parts = []
    for c in range(0, max(0, len(text) - width + 1), CHUNK):
        a = text[c : c + CHUNK + width - 1]
        h = PrefixHash(a)
        at = np.arange(len(a) - gram + 1)
        grams = mix64(h.of(at, at + gram))
        least = _slide_min((grams >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64), width - gram + 1) & np.uint64(0xFFFFFFFF)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(least) - 1]])
        p = least[first].astype(np.int64)
        parts.append(np.stack([grams[p], *digests(a, first, last + width, p - first), (p + c).astype(np.uint64), (first + c).astype(np.uint64), (last + c).astype(np.uint64)]))
    return np.concatenate(parts, axis=1) if parts else np.zeros((6, 0), np.uint64)


def _anchors(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = binary_parts(batch.column(2))
            rows = [anchor_rows(data[i:j], width) for i, j in zip(at[:-1], at[1:], strict=True)]
            of = pa.array(np.repeat(np.arange(len(rows)), [x.shape[1] for x in rows]))
            x = np.concatenate([np.zeros((6, 0), np.uint64), *rows], axis=1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), *map(pa.array, x)], names=["doc_id", "text_key", "a", "f", "g", "p", "first", "last"])

    return run


def _surroundings(width: int):
    """The bytes around each listed row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = binary_parts(batch.column(2))
            lists = batch.column(3)
            of = np.repeat(np.arange(batch.num_rows), lists.value_lengths().fill_null(0).to_numpy())
            flat = lists.flatten()
            a, p, first, last, single = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("a", "p", "first", "last", "single"))
            for i in range(0, len(of), 4096):
                part = slice(i, i + 4096)
                bytes_ = [data[at[o] + s : at[o] + e + width].tobytes() for o, s, e in zip(of[part], first[part], last[part], strict=True)]
                ids = pa.array(of[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[part]), batch.column(0).take(ids), batch.column(1).take(ids), pa.array(p[part]), pa.array((p - first)[part]), pa.array(single[part]), pa.array(bytes_, pa.binary())],
                    names=["a", "doc_id", "text_key", "p", "before", "single", "bytes"],
                )

    return run


class Suffixes:
    """Suffixes of a buffer that start at `at`, to the right or to the left, each at most `most` bytes long, within groups."""

    def __init__(self, data: np.ndarray, hashes: PrefixHash, group: np.ndarray, at: np.ndarray, most: np.ndarray, left: bool):
        self.data, self.hashes, self.group, self.at, self.most, self.left = data, hashes, group, at, most, left

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension, by binary search over prefix hashes."""
        low, high = np.zeros(len(x), np.int64), np.minimum(self.most[x], self.most[y])
        p, q = self.at[x], self.at[y]
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            if self.left:
                same = self.hashes.of(p - mid, p) == self.hashes.of(q - mid, q)
            else:
                same = self.hashes.of(p, p + mid) == self.hashes.of(q, q + mid)
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        return low

    def byte(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The byte after n bytes of the suffix; -1 at its end."""
        k = self.at[x] - 1 - n if self.left else self.at[x] + n
        return np.where(n < self.most[x], self.data[np.clip(k, 0, len(self.data) - 1)].astype(np.int64), -1)

    def compare(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.sign(self.group[x] - self.group[y])
        k = np.flatnonzero(out == 0)
        n = self.common(x[k], y[k])
        out[k] = np.sign(self.byte(x[k], n) - self.byte(y[k], n))
        return out

    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """The order of the suffixes, and the common extension of each with the one before it (-1: another group)."""
        n, width = len(self.at), 1
        order = np.arange(n)
        spot = np.arange(n)
        while width < n:  # bottom-up mergesort: each item finds its rank in the neighbouring run
            run = spot // width
            low = np.minimum((run ^ 1) * width, n)
            start, high = low, np.minimum(low + width, n)
            second = (run & 1).astype(bool)
            while (open_ := low < high).any():
                mid = np.where(open_, (low + high) // 2, 0)
                c = np.ones(n, np.int64)
                k = np.flatnonzero(open_)
                c[k] = self.compare(order[mid[k]], order[k])
                before = open_ & np.where(second, c <= 0, c < 0)
                low, high = np.where(before, mid + 1, low), np.where(open_ & ~before, mid, high)
            to = (run // 2) * 2 * width + (spot - run * width) + (low - start)
            order = order[np.argsort(to, kind="stable")]
            width *= 2
        shared = self._shared(order)
        if not self._verified(order, shared):  # two strings had one hash: compare bytes instead
            order = np.array(sorted(range(n), key=lambda i: (self.group[i], self._bytes(i))), np.int64)
            shared = np.array([-1] + [self._equal(i, j) if self.group[i] == self.group[j] else -1 for i, j in zip(order[:-1], order[1:], strict=True)], np.int64)
        return order, shared

    def _shared(self, order: np.ndarray) -> np.ndarray:
        shared = np.full(len(order), -1, np.int64)
        k = np.flatnonzero(self.group[order[1:]] == self.group[order[:-1]])
        shared[k + 1] = self.common(order[k], order[k + 1])
        return shared

    def _bytes(self, i: int) -> bytes:
        p, n = self.at[i], self.most[i]
        return self.data[p - n : p][::-1].tobytes() if self.left else self.data[p : p + n].tobytes()

    def _equal(self, i: int, j: int) -> int:
        x, y = self._bytes(i), self._bytes(j)
        n = min(len(x), len(y))
        differ = np.flatnonzero(np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n))
        return int(differ[0]) if len(differ) else n

    def _verified(self, order: np.ndarray, shared: np.ndarray) -> bool:
        k = np.flatnonzero(shared > 0)
        for part in np.array_split(k, max(1, len(k) // 2048)):
            n = shared[part]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            step = -1 - step if self.left else step
            x, y = (np.repeat(self.at[order[part - d]], n) + step for d in (0, 1))
            if (self.data[x] != self.data[y]).any():
                return False
        return True


def repeated_starts(group: np.ndarray, data: np.ndarray, offsets: np.ndarray, before: np.ndarray, width: int) -> np.ndarray:
    """repeated[j, i]: whether the window that starts j bytes before the anchor of row i stands in another row of its group too."""
    n, most = len(group), width - width // 2 + 1
    hashes = PrefixHash(data)
    at = offsets[:-1] + before
    right_order, right_shared = Suffixes(data, hashes, group, at, offsets[1:] - at, False).sorted()
    left_order, left_shared = Suffixes(data, hashes, group, at, before, True).sorted()
    out = np.zeros((most, n), bool)
    stretch_r, stretch_l = np.empty(n, np.int64), np.empty(n, np.int64)
    after = offsets[1:] - at
    for j in range(most):
        stretch_r[right_order] = np.cumsum(right_shared < width - j)
        stretch_l[left_order] = np.cumsum(left_shared < j)
        can = np.flatnonzero((before >= j) & (after >= width - j))
        _, which, count = np.unique(stretch_r[can] * (n + 1) + stretch_l[can], return_inverse=True, return_counts=True)
        out[j, can] = count[which] > 1
    return out


def _edges(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["a"]):
            data, offsets = binary_parts(table.column("bytes"))
            _, group = np.unique(table.column("a").to_numpy(), return_inverse=True)
            p, before = table.column("p").to_numpy(), table.column("before").to_numpy()
            found = repeated_starts(group.astype(np.int64), data, offsets, before, width)
            single = np.flatnonzero(table.column("single").to_numpy(zero_copy_only=False))
            edge = np.diff(np.pad(found[:, single].T.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            row, low = np.nonzero(edge == 1)
            _, high = np.nonzero(edge == -1)
            of = single[row]
            ids = pa.array(of)
            yield pa.RecordBatch.from_arrays([table.column("doc_id").take(ids).combine_chunks(), table.column("text_key").take(ids).combine_chunks(), pa.array(p[of] - high + 1), pa.array(p[of] - low + width)], names=["doc_id", "text_key", "lo", "hi"])

    return run


def _windows(width: int):
    """A row for each start of the rows: the offset to the anchor and the digest of the window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = binary_parts(batch.column("bytes"))
            before = batch.column("before").to_numpy()
            n = np.diff(offsets) - width + 1
            of = np.repeat(np.arange(batch.num_rows), n)
            step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            h = digests(data, offsets[of] + step, offsets[of] + step + width, np.zeros(len(of))).astype(np.int64)
            start = (batch.column("p").to_numpy() - before)[of] + step
            ids = pa.array(of)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(ids), pa.array(before[of] - step), pa.array(h[0]), pa.array(h[1]), *(batch.column(k).take(ids) for k in ("doc_id", "text_key", "single")), pa.array(start)], names=["a", "j", "h", "g", "doc_id", "text_key", "single", "start"])

    return run


def repeated_spans(docs: DataFrame, width: int = WIDTH, task_rows: int = TASK_ROWS) -> DataFrame:
    """(doc_id, text_key, spans): byte ranges [lo, hi) of each text, some overlapping, that cover just the repeated strings."""
    d = docs.select(*row_key(), F.encode("text", "utf-8").alias("bytes"))
    kinds = "doc_id long, text_key long"
    rows = saved(d.mapInArrow(_anchors(width), f"{kinds}, a long, f long, g long, p long, first long, last long"), "anchors")
    twice = saved(rows.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a"), "anchors-twice")
    every, rows = rows, saved(rows.join(twice, "a", "left_semi"), "anchors-rows")
    discard(every, twice)
    classes = rows.groupBy("a", "f", "g").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key", "p", "first", "last")).alias("r"))
    classes = saved(classes, "anchors-classes")
    whole = rows.join(classes.where("n > 1").select("a", "f", "g"), ["a", "f", "g"]).select("doc_id", "text_key", F.col("first").alias("lo"), (F.col("last") + width).alias("hi"))
    mixed = classes.groupBy("a").agg(F.count("*").alias("size"), F.min("n").alias("least")).where("least = 1").select("a", "size")
    listed = classes.join(mixed, "a").select("a", "size", (F.col("n") == 1).alias("single"), "r.*")
    listed = listed.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("a", "p", "first", "last", "single", "size")).alias("listed"))
    listed = saved(listed, "anchors-listed")
    ids = narrow(listed.select("doc_id", "text_key"))
    d = d.join(ids, same_row(d, ids), "left_semi")
    around = d.join(listed, same_row(d, listed)).select(d["doc_id"], d["text_key"], "bytes", "listed")
    around = around.mapInArrow(_surroundings(width), f"a long, {kinds}, p long, before long, single boolean, bytes binary")
    around = saved(around, "anchors-bytes")
    large = narrow(saved(mixed.where(F.col("size") > task_rows).select("a"), "anchors-large"))
    edges = around.join(large, "a", "left_anti").repartition("a").sortWithinPartitions("a").mapInArrow(_edges(width), f"{kinds}, lo long, hi long")
    starts = around.join(large, "a", "left_semi").mapInArrow(_windows(width), f"a long, j long, h long, g long, {kinds}, single boolean, start long")
    starts = saved(starts, "anchors-starts")
    again = starts.groupBy("a", "j", "h", "g").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    starts = starts.where("single").join(again, ["a", "j", "h", "g"], "left_semi").select("doc_id", "text_key", F.col("start").alias("lo"), (F.col("start") + width).alias("hi"))
    spans = whole.union(edges).union(starts)
    return spans.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = binary_parts(batch.column(1))
        spans = batch.column(2)
        flat = spans.flatten()
        lo, hi = flat.field("lo").to_numpy(zero_copy_only=False), flat.field("hi").to_numpy(zero_copy_only=False)
        n = spans.value_lengths().fill_null(0).to_numpy()
        ends = np.cumsum(n)
        kept, removed, runs = [], [], []
        for i in range(batch.num_rows):
            text = data[at[i] : at[i + 1]]
            change = np.zeros(len(text) + 1, np.int32)
            np.add.at(change, lo[ends[i] - n[i] : ends[i]], 1)
            np.add.at(change, hi[ends[i] - n[i] : ends[i]], -1)
            gone = np.cumsum(change)[:-1] > 0
            kept.append(text[~gone].tobytes())
            removed.append(int(gone.sum()))
            runs.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, width: int = WIDTH, task_rows: int = TASK_ROWS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row of docs: kept holds the bytes that stay.

    All occurrences of a repeated string go, in copies and within one text too. A null text counts as empty;
    texts shorter than width stay whole, and long ones are read in pieces of CHUNK starts; repeated rows are copies of each other; null ids stay; an empty table
    gives no rows; other columns are left out.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spans = saved(repeated_spans(d, width, task_rows), "repeat-spans")
    d = d.select(*row_key(), F.encode("text", "utf-8").alias("bytes"))
    cut = d.join(spans, same_row(d, spans), "left").select(d["doc_id"], "bytes", "spans")
    return cut.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op5_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the strings of 400 bytes that start more than once in all documents."""
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
