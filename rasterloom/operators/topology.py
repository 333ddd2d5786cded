"""Peaks and pits: merge trees, pooling, persistence, matching by radius, stamps and signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.operators import kernels, tilework
from rasterloom.sources.tables import dropped, written

MOST = 65_536


def pool_max(df: DataFrame, value: str, most: int = MOST) -> DataFrame:
    """(image_id, h, w, factor, py, px, v): the greatest value of each block; blocks have a side of 1 if the image has at most `most` pixels."""
    n = F.col("h").cast("long") * F.col("w")
    f = F.when(n <= most, 1).otherwise(F.greatest(F.lit(2), F.ceil(F.sqrt(n / F.lit(float(most)))).cast("int")))
    d = df.withColumn("factor", f)
    return d.groupBy("image_id", "h", "w", "factor", F.floor(F.col("y") / F.col("factor")).cast("int").alias("py"), F.floor(F.col("x") / F.col("factor")).cast("int").alias("px")).agg(F.max(value).alias("v"))


def persistence_threshold(df: DataFrame, value: str, relative: float) -> DataFrame:
    """(image_id, tau): relative times the span of percentiles 1 to 99."""
    p = F.percentile(value, F.array(F.lit(0.01), F.lit(0.99)))
    return df.groupBy("image_id").agg(p.alias("p")).select("image_id", (relative * F.greatest(F.col("p")[1] - F.col("p")[0], F.lit(0.0))).alias("tau"))


#: The eight neighbours of a pixel; each pair of neighbours stands once in the first half.
_PAIRS = [(0, 1), (1, 0), (1, 1), (1, -1)]


def _shifted(a: np.ndarray, dy: int, dx: int) -> tuple[np.ndarray, np.ndarray]:
    """a and a moved by (dy, dx), where both are there."""
    h, w = a.shape[-2:]
    at = lambda d, n: (slice(max(0, -d), n - max(0, d)), slice(max(0, d), n - max(0, -d)))
    (y, to_y), (x, to_x) = at(dy, h), at(dx, w)
    return a[..., y, x], a[..., to_y, to_x]


def _basins(rank: np.ndarray, end: np.ndarray | None = None) -> np.ndarray:
    """For each rank, that of the pixel at which the steepest descent from it ends; places of end stop any descent."""
    down = rank.copy()
    for dy, dx in _PAIRS:
        for a, b in ((_shifted(down, dy, dx)[0], _shifted(rank, dy, dx)[1]), (_shifted(down, dy, dx)[1], _shifted(rank, dy, dx)[0])):
            np.minimum(a, b, out=a)
    if end is not None:
        down[end] = rank[end]
    to = np.empty(rank.size, np.int64)
    to[rank.ravel()] = down.ravel()
    while True:
        further = to[to]
        if (further == to).all():
            return to
        to = further


def _passes(rank: np.ndarray, basin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(basin, other basin, lowest pass) of neighbouring basins: a pass is the higher of two neighbouring pixels."""
    found = [np.zeros((3, 0), np.int64)]
    for dy, dx in _PAIRS:
        p, q = (x.ravel() for x in _shifted(rank, dy, dx))
        a, b = basin[p], basin[q]
        some = a != b
        found.append(np.stack([np.minimum(a, b)[some], np.maximum(a, b)[some], np.maximum(p, q)[some]]))
    a, b, s = np.concatenate(found, axis=1)
    order = np.lexsort((s, b, a))
    a, b, s = a[order], b[order], s[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[first], b[first], s[first]


def _settle(n: int, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The pass at which each of n basins, numbered from the lowest, meets a lower one (-1: none), by rounds.

    In a round each basin looks at its lowest pass; if the basin beyond is lower, it ends there and becomes part of that one.
    """
    death, none = np.full(n, -1), np.iinfo(np.int64).max
    while len(a):
        best = np.full(n, none)
        np.minimum.at(best, np.concatenate([a, b]), (np.concatenate([s, s]) << 32) | np.concatenate([b, a]))
        at = np.flatnonzero(best != none)
        at = at[(best[at] & 0xFFFFFFFF) < at]
        death[at] = best[at] >> 32
        into = np.arange(n)
        into[at] = best[at] & 0xFFFFFFFF
        while (into[into] != into).any():
            into = into[into]
        a, b = into[a], into[b]
        some = a != b
        a, b, s = a[some], b[some], s[some]
    return death


def merge_trees(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minima of fields (images, h, w): places in the flat array, births and deaths by the elder rule over 8 neighbours.

    Ties are broken by place. The lowest minimum of a field never dies (death: the field's greatest value). All fields are worked on at once.
    """
    n, flat = v.shape[0], v.ravel()
    image = np.repeat(np.arange(n), v[0].size if n else 0)
    order = np.lexsort((flat, image))
    rank = np.empty(flat.size, np.int64)
    rank[order] = np.arange(flat.size)
    rank = rank.reshape(v.shape)
    basin = _basins(rank)
    low = np.flatnonzero(basin == np.arange(flat.size))
    number = np.full(flat.size, -1)
    number[low] = np.arange(len(low))
    a, b, s = _passes(rank, basin)
    death = _settle(len(low), number[a], number[b], s)
    at = order[low]
    most = v.reshape(n, -1).max(axis=1, initial=-np.inf)[image[at]] if n else flat
    return at, flat[at], np.where(death >= 0, flat[order[death]], most)


def merge_tree(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """merge_trees of one field, by place."""
    at, birth, death = merge_trees(values[None])
    order = np.argsort(at)
    return at[order], birth[order], death[order]


_MINIMA = "image_id {}, y int, x int, birth double, death double"


def minima(df: DataFrame, value: str, most: int = kernels.MOST) -> DataFrame:
    """(image_id, y, x, birth, death): the merge tree of each field, exactly. Fields of over `most` pixels are worked on by tiles."""
    small = F.col("h").cast("long") * F.col("w") <= most
    d = df.select("image_id", "h", "w", "y", "x", F.col(value).alias("v"))

    def at_once(v: np.ndarray, ids: np.ndarray, part: kernels.Part, own: tuple) -> Iterator[pa.RecordBatch]:
        h, w = own[:2]
        at, birth, death = merge_trees(v[0])
        y, x = np.divmod(at % (h * w), w)
        yield pa.RecordBatch.from_arrays([pa.array(ids[at // (h * w)]), *(pa.array(c.astype(np.int32)) for c in (y, x)), pa.array(birth), pa.array(death)], names=["image_id", "y", "x", "birth", "death"])

    kind = d.schema["image_id"].dataType.simpleString()
    out = tilework.in_tasks(tilework.whole(d.where(small)), ["v"], [], at_once, _MINIMA.format(kind))
    large = d.where(~small)
    # The rounds over tiles need jobs of their own; they are left out where no image is large.
    return out.unionByName(_minima_by_tiles(large, most)) if large.limit(1).count() else out


_POINT = "struct<v:double,i:long>"  # compared by value, then place


def _led_on(ended: DataFrame) -> DataFrame:
    """(image_id, i, to) with to led on to one that isn't among i. Each step leads to a lower one, so there are no circles."""
    t = ended.select("image_id", "i", "to")
    while True:
        then = t.select(F.col("image_id").alias("__k"), F.col("i").alias("__i"), F.col("to").alias("then"))
        t = written(t.join(then.hint("merge"), (F.col("image_id") == F.col("__k")) & (F.col("to.i") == F.col("__i")), "left").select("image_id", "i", F.coalesce("then", "to").alias("to"), F.col("then").isNotNull().alias("moved")))
        if not t.where("moved").limit(1).count():
            return t


def _minima_by_tiles(d: DataFrame, most: int) -> DataFrame:
    """minima of large fields. A tile, with a margin of one pixel, follows descents to a minimum or out of it, and gives the lowest passes between where they end.

    Ends in other tiles are looked up there until they are minima; the passes are then settled in rounds, each a grouped minimum and
    joins on basins. No task holds more than a tile, and a round's tables hold basins, not pixels. They grow with the field, so their joins are
    shuffled: left to Spark, each that is small enough would be sent to the driver and from there to all.
    """
    kind = d.schema["image_id"].dataType.simpleString()

    def work(v: np.ndarray, ids: np.ndarray, part: kernels.Part, own: tuple) -> Iterator[pa.RecordBatch]:
        h, w, ty, tx, side = own
        y0, y1, x0, x1 = part
        place = (np.arange(y0, y1)[:, None] * w + np.arange(x0, x1)).ravel()
        inside = np.zeros((y1 - y0, x1 - x0), bool)
        core = (ty * side, min(h, (ty + 1) * side), tx * side, min(w, (tx + 1) * side))
        kernels.cropped(inside, part, core)[...] = True
        # The core's pixels that are in other tiles' margins.
        rim = inside.copy()
        kernels.cropped(rim, part, (core[0] + (core[0] > 0), core[1] - (core[1] < h), core[2] + (core[2] > 0), core[3] - (core[3] < w)))[...] = False
        for k, image in enumerate(ids.tolist()):
            flat = v[0, k].ravel()
            order = np.argsort(flat, kind="stable")
            rank = np.empty(flat.size, np.int64)
            rank[order] = np.arange(flat.size)
            rank = rank.reshape(inside.shape)
            basin = _basins(rank, ~inside)
            a, b, s = _passes(rank, basin)
            low = np.flatnonzero(basin == np.arange(flat.size))
            low = low[inside.ravel()[order[low]]]
            out = rank[rim]
            what = np.repeat(np.array([0, 1, 2]), [len(low), len(out), len(a)])
            cols = [np.concatenate(c) for c in ((low, out, a), (low, basin[out], b), (low, out, s))]
            arrays = [pa.array([image] * len(what)), pa.array(what.astype(np.int32))]
            for c in cols:
                arrays.append(pa.StructArray.from_arrays([pa.array(flat[order[c]]), pa.array(place[order[c]])], names=["v", "i"]))
            yield pa.RecordBatch.from_arrays(arrays, names=["image_id", "what", "a", "b", "s"])

    # A tile has a quarter of `most` pixels at most, margin included.
    side = max(2, int(most**0.5) // 2)
    cut = tilework.cut_with_margin(d.withColumn("side", F.lit(side)), F.col("side"), F.lit(1))
    rows = written(tilework.in_tasks(cut, ["v"], ["side"], work, f"image_id {kind}, what int, a {_POINT}, b {_POINT}, s {_POINT}", most))
    found = rows.where("what = 0").select("image_id", F.col("a").alias("low"))
    # Where descents that leave a tile end: doubled until all are minima.
    ends = written(rows.where("what = 1").select("image_id", F.col("a.i").alias("i"), F.col("b").alias("to"), F.lit(True).alias("moved")))
    while ends.where("moved").limit(1).count():
        then = ends.select(F.col("image_id").alias("__k"), F.col("i").alias("__i"), F.col("to").alias("then"))
        now = ends.join(then.hint("merge"), (F.col("image_id") == F.col("__k")) & (F.col("to.i") == F.col("__i")), "left")
        now = written(now.select("image_id", "i", F.coalesce("then", "to").alias("to"), F.coalesce(F.col("then.i") != F.col("to.i"), F.lit(False)).alias("moved")))
        dropped(ends)
        ends = now

    def led(e: DataFrame, table: DataFrame) -> DataFrame:
        """Passes between what the table (image_id, i, to) leads their sides to, the lowest of each two."""
        for c in ("a", "b"):
            t = table.select(F.col("image_id").alias("__k"), F.col("i").alias("__i"), F.col("to").alias("__to"))
            e = e.join(t.hint("merge"), (e["image_id"] == t["__k"]) & (e[f"{c}.i"] == t["__i"]), "left").withColumn(c, F.coalesce("__to", c)).drop("__k", "__i", "__to")
        e = e.where(F.col("a.i") != F.col("b.i")).select("image_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s")
        return e.groupBy("image_id", "a", "b").agg(F.min("s").alias("s"))

    e = written(led(rows.where("what = 2").select("image_id", "a", "b", "s"), ends))
    dead = None
    while e.limit(1).count():
        both = e.select("image_id", F.col("a").alias("me"), F.struct("s", F.col("b").alias("o")).alias("p")).unionAll(e.select("image_id", F.col("b").alias("me"), F.struct("s", F.col("a").alias("o")).alias("p")))
        ended = written(both.groupBy("image_id", "me").agg(F.min("p").alias("p")).where(F.col("p.o") < F.col("me")).select("image_id", F.col("me.i").alias("i"), F.col("p.s.v").alias("death"), F.col("p.o").alias("to")))
        gone = ended.select("image_id", "i", "death")
        dead = gone if dead is None else dead.unionAll(gone)
        ended = _led_on(ended)
        now = written(led(e, ended))
        dropped(e)
        e = now
    most_of = d.groupBy("image_id").agg(F.max("v").alias("__most"))
    size = d.select("image_id", "w").distinct()
    found = found.join(dead.withColumnRenamed("i", "__i").withColumnRenamed("image_id", "__k").hint("merge"), (F.col("image_id") == F.col("__k")) & (F.col("low.i") == F.col("__i")), "left") if dead is not None else found.withColumn("death", F.lit(None).cast("double"))
    found = found.join(most_of, "image_id").join(size, "image_id")
    w = F.col("w")
    return found.select("image_id", F.floor(F.col("low.i") / w).cast("int").alias("y"), (F.col("low.i") % w).cast("int").alias("x"), F.col("low.v").alias("birth"), F.coalesce("death", "__most").alias("death"))


def _extrema_in_rows(rows: DataFrame, value: str, kind: str, most: int) -> DataFrame:
    sign = -1.0 if kind == "peak" else 1.0
    names = ["image_id", "kind", "y", "x", "value", "persistence", "factor"]

    def work(ids: pa.Array, v: np.ndarray) -> pa.RecordBatch:
        at, birth, death = merge_trees(sign * v[0])
        some = death > birth
        image, place = np.divmod(at[some], v[0, 0].size)
        y, x = (c.astype(np.int32) for c in np.divmod(place, v.shape[-1]))
        n = len(image)
        cols = [pa.array([kind] * n, pa.string()), y, x, sign * birth[some], (death - birth)[some], np.ones(n, np.int32)]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(image)), *(c if isinstance(c, pa.Array) else pa.array(c) for c in cols)], names=names)

    over = F.raise_error(F.lit("images that are rows of arrays aren't pooled")).cast("int")
    d = rows.withColumn("w", F.when(F.col("h").cast("long") * F.col("w") > (most or 2**62), over).otherwise(F.col("w")))
    d = d.select("image_id", "h", "w", F.col(value).alias("v"))
    return tilework.of_rows(d, ["v"], work, f"{tilework.schema_of(rows, ['image_id'])}, kind string, y int, x int, value double, persistence double, factor int")


def extrema(df: DataFrame, value: str, kind: str = "peak", most: int = MOST) -> DataFrame:
    """(image_id, kind, y, x, value, persistence, factor): peaks (or pits) of each image, pooled to `most` cells (0: not pooled).

    Peaks pool the greatest value of a block and pits the least, so no extremum is lost to its block. Extrema of
    no persistence are left out; places are block centres, within the image. Images that are rows of arrays are worked on in their rows; they
    may have `most` pixels at most.
    """
    if tilework.by_rows(df):
        return _extrema_in_rows(df, value, kind, most)
    sign = -1.0 if kind == "peak" else 1.0
    d = df.select("image_id", "h", "w", "y", "x", (F.col(value) * -sign).alias("v"))
    f, whole = F.col("factor"), F.col("h").cast("long") * F.col("w") <= (most or 2**62)
    pooled = pool_max(d.where(~whole), "v", most or 2**62)
    cells = pooled.select("image_id", F.ceil(F.col("h") / f).cast("int").alias("h"), F.ceil(F.col("w") / f).cast("int").alias("w"), F.col("py").alias("y"), F.col("px").alias("x"), "v")
    cells = d.where(whole).unionByName(cells).withColumn("v", -F.col("v"))
    sizes = df.select("image_id", "h", "w").distinct()
    factor = F.when(F.col("h").cast("long") * F.col("w") <= (most or 2**62), 1).otherwise(F.greatest(F.lit(2), F.ceil(F.sqrt(F.col("h").cast("long") * F.col("w") / F.lit(float(most or 1)))).cast("int")))
    m = minima(cells, "v").where("death > birth").join(sizes.withColumn("factor", factor), "image_id")
    place = lambda c, n: F.least(F.col(c) * f + F.floor(f / 2), F.col(n) - 1).cast("int")
    return m.select("image_id", F.lit(kind).alias("kind"), place("y", "h").alias("y"), place("x", "w").alias("x"), (sign * F.col("birth")).alias("value"), (F.col("death") - F.col("birth")).alias("persistence"), "factor")


def significant(points: DataFrame, tau: DataFrame) -> DataFrame:
    return points.join(tau, "image_id").where(F.col("persistence") >= F.col("tau")).drop("tau")


def signature(points: DataFrame, kept: int = 32) -> DataFrame:
    """(image_id, peaks, pits, total, spectrum, sum_persistence); the spectrum holds the greatest persistences, as many as are kept.

    These are cut to the limit in each partition before the shuffle, and once more after it: no buffer holds more.
    """
    count = lambda k: F.count_if(F.col("kind") == k)
    place = F.row_number().over(Window.partitionBy("image_id").orderBy(F.col("persistence").desc()))
    top = points.select("image_id", "persistence").withColumn("__n", place).where(F.col("__n") <= kept)
    top = top.groupBy("image_id").agg(F.sort_array(F.collect_list("persistence"), False).alias("spectrum"))
    sums = points.groupBy("image_id").agg(count("peak").alias("peaks"), count("pit").alias("pits"), F.count("*").alias("total"), F.sum("persistence").alias("sum_persistence"))
    return sums.join(top, "image_id").select("image_id", "peaks", "pits", "total", "spectrum", "sum_persistence")


def matches(reference: Column, candidate: Column, tolerance: float = 0.25) -> Column:
    """Whether a candidate keeps within the reference's budget; only more counts as a breach."""
    return F.when(reference <= 0, candidate <= 1e-9).otherwise(candidate <= reference * (1 + tolerance))


def unmatched(candidates: DataFrame, reference: DataFrame, cell: Column | int, radius: Column | float) -> DataFrame:
    """Candidates (image_id, y, x, ...) without a reference point within radius (at most cell): a radius anti-join on grid cells.

    Cell and radius may depend on columns of both, equal for all points of an image.
    """
    cell, radius = (v if isinstance(v, Column) else F.lit(v) for v in (cell, radius))
    bucket = lambda c, s: F.floor(F.col(c) / F.col("__cell")) + s
    around = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    r = reference.select("image_id", F.col("y").alias("__ry"), F.col("x").alias("__rx"), cell.alias("__cell"), around.alias("s"))
    r = r.select("image_id", "__ry", "__rx", bucket("__ry", F.col("s.a")).alias("__by"), bucket("__rx", F.col("s.b")).alias("__bx"))
    c = candidates.withColumns({"__cell": cell, "__r": radius}).withColumns({"__by": bucket("y", F.lit(0)), "__bx": bucket("x", F.lit(0))})
    near = (F.col("y") - F.col("__ry")) * (F.col("y") - F.col("__ry")) + (F.col("x") - F.col("__rx")) * (F.col("x") - F.col("__rx")) <= F.col("__r") * F.col("__r")
    same = (c["image_id"] == r["image_id"]) & (c["__by"] == r["__by"]) & (c["__bx"] == r["__bx"])
    return c.join(r, same & near, "left_anti").drop("__by", "__bx", "__cell", "__r")


def stamp(points: DataFrame, radius: Column | int) -> DataFrame:
    """(image_id, y, x, mask): Gaussian stamps of points (image_id, h, w, y, x), summed and cut at 1. Offsets beyond the edge fall on it."""
    r = F.col("__r")
    step = F.explode(F.sequence(-r, r))
    d = points.withColumn("__r", radius if isinstance(radius, Column) else F.lit(radius))
    d = d.select("image_id", "h", "w", "y", "x", "__r", step.alias("dy")).withColumn("dx", step)
    w = F.exp(-(F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")) / F.greatest(0.5 * r * r, F.lit(1e-6)))
    d = d.withColumn("wt", w).where(F.col("wt") >= 1e-3)
    at = lambda c, s, n: F.greatest(F.lit(0), F.least(F.col(n) - 1, F.col(c) + F.col(s)))
    d = d.groupBy("image_id", at("y", "dy", "h").alias("y"), at("x", "dx", "w").alias("x")).agg(F.sum("wt").alias("mask"))
    return d.withColumn("mask", F.least(F.lit(1.0), F.col("mask")))


def spurious(candidate: DataFrame, reference: DataFrame, value: str, tau: DataFrame, most: int = MOST) -> DataFrame:
    """(image_id, h, w, factor, y, x): significant peaks of the candidate field that the reference doesn't have.

    A peak without a significant reference peak nearby counts only if it is still the height of its 5 x 5 surroundings.
    Peaks of pooled images stand at block centres, so what is nearby grows with the pooling factor.
    """
    radius = F.greatest(F.lit(2), F.col("factor") + 2)
    peaks = lambda d: significant(extrema(d, value, "peak", most), tau)
    lone = unmatched(peaks(candidate), peaks(reference), F.greatest(F.lit(4), 2 * F.col("factor") + 4), radius)
    step = F.explode(F.sequence(F.lit(-2), F.lit(2)))
    around = lone.select("image_id", "factor", F.col("y").alias("py"), F.col("x").alias("px"), F.col("value").alias("height"), step.alias("dy")).withColumn("dx", step)
    around = around.withColumns({"y": F.col("py") + F.col("dy"), "x": F.col("px") + F.col("dx")})
    top = around.join(candidate.select("image_id", "h", "w", "y", "x", value), ["image_id", "y", "x"]).groupBy("image_id", "h", "w", "factor", "py", "px", "height").agg(F.max(value).alias("top"))
    return top.join(tau, "image_id").where(F.col("top") >= F.col("height") - 0.02 * F.col("tau")).select("image_id", "h", "w", "factor", F.col("py").alias("y"), F.col("px").alias("x"))


def suppress(candidate: DataFrame, reference: DataFrame, value: str, tau: DataFrame, strength: float = 1.0, most: int = MOST, points: DataFrame | None = None) -> DataFrame:
    """Blends the candidate field to the reference around its spurious peaks (points, if these are known already).

    How far a stamp reaches grows with the pooling factor.
    """
    if points is None:
        points = spurious(candidate, reference, value, tau, most)
    mask = stamp(points, F.greatest(F.lit(2), F.col("factor") + 2))
    ref = reference.select("image_id", "y", "x", F.col(value).alias("__ref"))
    d = candidate.join(ref, ["image_id", "y", "x"]).join(mask, ["image_id", "y", "x"], "left")
    m = F.coalesce("mask", F.lit(0.0)) * strength
    return d.withColumn(value, F.col(value) * (1 - m) + F.col("__ref") * m).drop("__ref", "mask")


def _surroundings(field: DataFrame, peaks: DataFrame, value: str, radius: int) -> DataFrame:
    """The pixels around each peak (py, px, apex) with their values in __v."""
    pooled = F.col("factor") if "factor" in peaks.columns else F.lit(1)
    r = F.col("__r")
    step = F.explode(F.sequence(-r, r))
    peaks = peaks.withColumn("__r", F.greatest(F.lit(max(2, radius)), F.floor(pooled / 2).cast("int") + 2))
    p = peaks.select("image_id", "__r", F.rint("y").cast("int").alias("py"), F.rint("x").cast("int").alias("px"), F.col("value").alias("apex"), step.alias("dy")).withColumn("dx", step)
    p = p.withColumns({"y": F.col("py") + F.col("dy"), "x": F.col("px") + F.col("dx")})
    return p.join(field.select("image_id", "y", "x", F.col(value).alias("__v")), ["image_id", "y", "x"])


def _lost(near: DataFrame, tau: DataFrame) -> DataFrame:
    tops = near.groupBy("image_id", "py", "px", "apex").agg(F.max("__v").alias("top"))
    return tops.join(tau, "image_id").where(F.col("top") < F.col("apex") - 0.25 * F.col("tau")).select("image_id", "py", "px", "apex")


def lost(field: DataFrame, peaks: DataFrame, value: str, tau: DataFrame, radius: int = 2) -> DataFrame:
    """(image_id, py, px, apex): peaks (image_id, y, x, value[, factor]) whose surroundings in the field stay a quarter tau below the height."""
    return _lost(_surroundings(field, peaks, value, radius), tau)


def restore(field: DataFrame, peaks: DataFrame, value: str, tau: DataFrame, radius: int = 2, points: DataFrame | None = None) -> DataFrame:
    """Raises the field to lost peaks (points, if these are known already): a bump is put in.

    radius: how far around a peak is looked; a column factor of the peaks (that of their pooling) widens it to half of
    itself and 2. Bumps act on the field as it came in, and where several meet the highest counts, so the order of peaks has no effect.
    """
    near = _surroundings(field, peaks, value, radius)
    if points is None:
        points = _lost(near, tau)
    bump = F.exp(-0.5 * (F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")) / (1.5 * 1.5))
    raised = near.join(points, ["image_id", "py", "px", "apex"]).withColumn("__r", F.greatest(F.col("__v"), F.col("__v") * (1 - bump) + F.col("apex") * bump))
    raised = raised.groupBy("image_id", "y", "x").agg(F.max("__r").alias("__r"))
    return field.join(raised, ["image_id", "y", "x"], "left").withColumn(value, F.coalesce("__r", F.col(value))).drop("__r")
