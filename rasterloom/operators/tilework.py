"""Tiles as rows: each holds its channels as arrays, with a margin as wide as the work needs.

Pixels are sent to the tiles that they are part of (no join: the tiles follow from a pixel's place), dealt out by tile and
written into arrays in one Arrow pass. What is done with a tile needs nothing else, so a lost task is done again alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import kernels

GEOMETRY = ["h", "w", "ty", "tx", "y0", "y1", "x0", "x1"]
#: (channels, their part, values of h, w, ty, tx and the keys) -> parts of the result with the result's h and w.
Work = Callable[[np.ndarray, kernels.Part, tuple], Iterator[tuple[kernels.Part, np.ndarray, int, int]]]


def cut_with_margin(px: DataFrame, side: Column, margin: Column) -> DataFrame:
    """Adds ty, tx, y0, y1, x0, x1 (the tile with its margin): a row for each tile that holds the pixel. Side and margin are the same for all pixels of an image."""
    d = px.withColumns({"__t": side.cast("int"), "__m": margin.cast("int")})
    t, m = F.col("__t"), F.col("__m")
    for at, size, k, lo, hi in (("y", "h", "ty", "y0", "y1"), ("x", "w", "tx", "x0", "x1")):
        whole = lambda v: F.floor(v / t).cast("int")
        near = F.sequence(F.greatest(F.lit(0), whole(F.col(at) - m)), F.least(whole(F.col(size) - 1), whole(F.col(at) + m)))
        d = d.withColumn(k, F.explode(near))
        d = d.withColumns({lo: F.greatest(F.lit(0), F.col(k) * t - m), hi: F.least(F.col(size), (F.col(k) + 1) * t + m)})
    return d.drop("__t", "__m")


def dealt(cut: DataFrame) -> DataFrame:
    """Pixels of a tile together, in as many partitions as shuffles have here."""
    parts = max(1, int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut.repartition(parts, "image_id", "ty", "tx").sortWithinPartitions("image_id", "ty", "tx")


def _whole_tiles(batches: Iterator[pa.RecordBatch], least: int = 1 << 16) -> Iterator[pa.Table]:
    """Joins the batches of a sorted partition into tables of whole tiles, of at least so many rows but for the last."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < least:
            continue
        table = pa.Table.from_batches(held)
        same = np.ones(n, bool)
        for c in ("image_id", "ty", "tx"):
            v = table.column(c).to_numpy()
            same &= v == v[-1]
        cut = int(np.argmax(same))
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        n -= cut
    if n:
        yield pa.Table.from_batches(held)


def in_arrays(batches: Iterator[pa.RecordBatch], names: list[str], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Pixels of tiles, tile by tile, to a row for each tile with an array for each channel (row by row; pixels that aren't there are 0)."""
    for table in _whole_tiles(batches):
        column = {c: table.column(c).to_numpy() for c in ("image_id", *GEOMETRY, "y", "x", *names)}
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for c in ("image_id", "ty", "tx"):
            new[1:] |= column[c][1:] != column[c][:-1]
        first, tile = np.flatnonzero(new), np.cumsum(new) - 1
        y0, y1, x0, x1 = (column[c][first].astype(np.int64) for c in ("y0", "y1", "x0", "x1"))
        ends = np.concatenate([[0], np.cumsum((y1 - y0) * (x1 - x0))])
        at = ends[tile] + (column["y"] - y0[tile]) * (x1 - x0)[tile] + column["x"] - x0[tile]
        arrays = []
        for c in names:
            flat = np.zeros(ends[-1])
            flat[at] = column[c]
            arrays.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)))
        heads = table.select(["image_id", *GEOMETRY, *keys]).take(pa.array(first)).combine_chunks()
        yield pa.RecordBatch.from_arrays([*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in heads.columns), *arrays], names=["image_id", *GEOMETRY, *keys, *names])


def schema_of(px: DataFrame, fields: list[str]) -> str:
    return ", ".join(f"{c} {px.schema[c].dataType.simpleString()}" for c in fields)


def tile_rows(cut: DataFrame, names: list[str], keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(image_id, h, w, ty, tx, y0, y1, x0, x1, keys, names): a row for each tile of cut pixels; each name is an array of doubles, row by row."""
    d = cut.select("image_id", *GEOMETRY, *keys, "y", "x", *(F.col(c).cast("double").alias(c) for c in names))
    kinds = f"{schema_of(d, ['image_id', *GEOMETRY, *keys])}, {', '.join(f'{c} array<double>' for c in names)}"
    return dealt(d).mapInArrow(lambda batches: in_arrays(batches, names, keys), kinds)


def stacked(rows: pa.RecordBatch, names: list[str], keys: list[str], most: int = kernels.MOST) -> Iterator[tuple[tuple, np.ndarray, kernels.Part, np.ndarray]]:
    """((h, w, ty, tx, keys), ids, part, channels) of the tiles that are alike in all of these, as many at once as have `most` pixels."""
    ids = rows.column("image_id").to_numpy(zero_copy_only=False)
    alike: dict[tuple, list[int]] = {}
    for i, k in enumerate(zip(*(rows.column(c).to_pylist() for c in (*GEOMETRY, *keys)), strict=True)):
        alike.setdefault(k, []).append(i)
    starts = rows.column(names[0]).offsets.to_numpy()
    flat = [rows.column(c).values.to_numpy() for c in names]
    for (h, w, ty, tx, y0, y1, x0, x1, *own), some in alike.items():
        part = (y0, y1, x0, x1)
        size = (part[1] - part[0]) * (part[3] - part[2])
        step = max(1, most // max(1, size))
        for lo in range(0, len(some), step):
            take = np.array(some[lo : lo + step])
            at = starts[take][:, None] + np.arange(size)
            v = np.stack([c[at] for c in flat]).reshape(len(names), len(take), part[1] - part[0], part[3] - part[2])
            yield (h, w, ty, tx, *own), ids[take], part, v


def in_tasks(cut: DataFrame, names: list[str], keys: list[str], work: Callable[..., Iterator[pa.RecordBatch]], schema: str, most: int = kernels.MOST) -> DataFrame:
    """The rows, of a schema, that work(channels, ids, part, values of h, w, ty, tx and the keys) makes of tiles that are alike, as many at once as have `most` pixels."""
    d = cut.select("image_id", *GEOMETRY, *keys, "y", "x", *(F.col(c).cast("double").alias(c) for c in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in in_arrays(batches, names, keys):
            for own, ids, part, v in stacked(rows, names, keys, most):
                yield from work(v, ids, part, own)

    return dealt(d).mapInArrow(run, schema)


#: Pixels of the images, as rows of arrays, that are changed at once.
STACK = 1 << 17


def by_rows(df: DataFrame) -> bool:
    """Whether images are rows (image_id, h, w, and an array for each channel, row by row) instead of a row for each pixel."""
    return "y" not in df.columns


def stacks(batch: pa.RecordBatch, names: list[str], most: int = STACK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, channels) of the images of a batch of rows that have one size, as many at once as have `most` pixels."""
    h, w = (batch.column(c).to_numpy().astype(np.int64) for c in ("h", "w"))
    starts = {c: batch.column(c).offsets.to_numpy() for c in names}
    flat = {c: batch.column(c).values.to_numpy() for c in names}
    for size in np.unique(h << 32 | w):
        own_h, own_w = int(size >> 32), int(size & 0xFFFFFFFF)
        some = np.flatnonzero((h == own_h) & (w == own_w))
        step = max(1, most // max(1, own_h * own_w))
        for lo in range(0, len(some), step):
            take = some[lo : lo + step]
            at = np.arange(own_h * own_w)
            yield take, np.stack([flat[c][starts[c][take][:, None] + at] for c in names]).reshape(len(names), len(take), own_h, own_w)


def arrays_of(v: np.ndarray) -> pa.ListArray:
    """An array for each image of (images, ...)."""
    n, size = v.shape[0], v[0].size if len(v) else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(np.ascontiguousarray(v).ravel()))


def changed(rows: DataFrame, names: list[str], change: Callable[[np.ndarray], np.ndarray], into: list[str] | None = None, most: int = STACK) -> DataFrame:
    """Images as rows of arrays with the channels `into` (names, if not given) that change makes of names (channels, images, h, w); it may change h and w.

    An image lies whole in a row, so there is no shuffle; other columns come along. For images of up to some thousand pixels.
    """
    into = into or names
    rest = [c for c in rows.columns if c not in ("h", "w", *into)]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest), "h int", "w int", *(f"`{c}` array<double>" for c in into)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for take, v in stacks(batch, names, most):
                out = change(v)
                size = [pa.array(np.full(len(take), n, np.int32)) for n in out.shape[2:]]
                kept = batch.select(rest).take(pa.array(take))
                yield pa.RecordBatch.from_arrays([*kept.columns, *size, *(arrays_of(c) for c in out)], names=[*rest, "h", "w", *into])

    return rows.mapInArrow(run, schema)


def of_rows(rows: DataFrame, names: list[str], work: Callable[[pa.Array, np.ndarray], pa.RecordBatch], schema: str, most: int = STACK) -> DataFrame:
    """The rows, of a schema, that work(image_ids, channels) makes of images as rows of arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for take, v in stacks(batch, names, most):
                yield work(batch.column("image_id").take(pa.array(take)), v)

    return rows.select("image_id", "h", "w", *names).mapInArrow(run, schema)


def as_pixels(rows: DataFrame, names: list[str]) -> DataFrame:
    """(image_id, h, w, y, x, names): a row for each pixel of images that are rows."""
    d = rows.select("image_id", "h", "w", F.posexplode(F.arrays_zip(*names)).alias("__i", "__p"))
    at = F.col("__i")
    return d.select("image_id", "h", "w", F.floor(at / F.col("w")).cast("int").alias("y"), (at % F.col("w")).cast("int").alias("x"), *(F.col(f"__p.{c}").alias(c) for c in names))


def whole(px: DataFrame, layer: Column | None = None) -> DataFrame:
    """Images (or, with a layer, each layer of them) as tiles."""
    layer = F.lit(0) if layer is None else layer
    return px.withColumns({"ty": layer.cast("int"), "tx": F.lit(0), "y0": F.lit(0), "y1": F.col("h"), "x0": F.lit(0), "x1": F.col("w")})


def strips(px: DataFrame, axis: str, layer: Column | None = None, width: Column | None = None, most: int = kernels.MOST) -> DataFrame:
    """Whole rows (axis x) or columns (axis y) of images, as many in a tile as have `most` pixels. width: that of the rows, if it isn't w."""
    w = F.col("w") if width is None else width
    layer = F.lit(0) if layer is None else layer
    along, across, at = (w, F.col("h"), F.col("y")) if axis == "x" else (F.col("h"), w, F.col("x"))
    n = F.greatest(F.lit(1), F.floor(F.lit(most) / along)).cast("int")
    k = F.floor(at / n).cast("int")
    lo, hi = k * n, F.least(across, (k + 1) * n)
    zero = F.lit(0)
    y0, y1, x0, x1 = (lo, hi, zero, w) if axis == "x" else (zero, F.col("h"), lo, hi)
    return px.withColumns({"ty": k, "tx": layer.cast("int"), "y0": y0, "y1": y1, "x0": x0, "x1": x1})


def worked(cut: DataFrame, names: list[str], keys: list[str], work: Work, carried: list[str] = [], one_by_one: bool = False) -> DataFrame:  # noqa: B006
    """The pixels (image_id, h, w, y, x, names, carried) of what work makes of each tile. carried: keys that come along.

    Tiles that are alike are given to work together; with one_by_one, each of its parts is that of one of them, whose number follows the part.
    """
    at = [keys.index(c) + 4 for c in carried]
    kinds = [cut.schema[c].dataType.simpleString() for c in carried]

    def run(v: np.ndarray, ids: np.ndarray, part: kernels.Part, own: tuple) -> Iterator[pa.RecordBatch]:
        for to, *which, out, h, w in work(v, part, own):
            made = kernels.pixels(ids[which] if one_by_one else ids, out, names, to, h, w)
            more = [pa.array([own[i]] * made.num_rows, pa.int32() if kind == "int" else pa.float64()) for i, kind in zip(at, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*made.columns, *more], names=[*made.schema.names, *carried])

    schema = ", ".join([f"{schema_of(cut, ['image_id'])}, h int, w int, y int, x int", *(f"{c} double" for c in names), *([schema_of(cut, carried)] if carried else [])])
    return in_tasks(cut, names, keys, run, schema)
