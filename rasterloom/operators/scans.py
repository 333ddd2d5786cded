"""Box means along long lines, by blocks: a line, however long, is never one window group.

A line is cut into blocks of equal length. Up to a radius of one block, a block gets copies of the pixels within the radius of
its ends, and the mean is the difference of two running sums of the block: one exchange, at most three rows for each pixel.

Beyond, copies would grow with the radius. Running sums are taken inside blocks then; the sums of blocks, one row each, are
summed along the line and give what a block starts from. The two running sums that a pixel needs are sent to its block and lie
beside it there after the sort, so that the radius has no bearing on the size of a task either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.sources import tables

#: Name of the column that numbers the blocks of a line while an axis is worked on.
BLOCK = "__block"


def with_blocks(df: DataFrame, along: str, block: int) -> DataFrame:
    return df.withColumn(BLOCK, F.floor(F.col(along) / block).cast("int"))


def margin_axis(df: DataFrame, values: list[str], radius: int, along: str, across: str, size: str, block: int) -> DataFrame:
    """Means of 2r+1 samples along an axis, as neighbourhood's: ends repeat beyond the edges, r is at most size - 1."""
    at, last = F.col(along), F.col(size) - 1
    number = lambda x: F.floor(x / block).cast("int")
    blocks = F.sequence(number(F.greatest(at - radius, F.lit(0))), number(F.least(at + radius, last)))
    near = df.withColumn(BLOCK, F.explode(blocks))
    line = Window.partitionBy("image_id", across, BLOCK).orderBy(along)
    upto, whole = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = near.withColumns({f"__sum_{c}": F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).over(upto) for c in values})
    r = F.least(F.lit(radius), last)
    before, after = F.greatest(F.lit(0), r - at).cast("double"), F.greatest(F.lit(0), at + r - last).cast("double")

    def mean(c: str) -> Column:
        # What lies beyond a block and its margin lies beyond the line.
        upper = F.coalesce(F.lead(f"__sum_{c}", radius).over(line), F.last(f"__sum_{c}").over(whole))
        lower = F.coalesce(F.lag(f"__sum_{c}", radius + 1).over(line), F.lit(0.0))
        return (upper - lower + before * F.first(c).over(whole) + after * F.last(c).over(whole)) / (2 * r + 1).cast("double")

    out = near.withColumns({f"__mean_{c}": mean(c) for c in values}).where(number(at) == F.col(BLOCK))
    return out.select(*(F.col(f"__mean_{c}").alias(c) if c in values else F.col(c) for c in df.columns))


def running_sums(df: DataFrame, values: list[str], along: str, across: str, size: str) -> DataFrame:
    """Adds __sum_* (sum of the line up to here), __all_* (of the whole line), __first_* and __last_* (values at its ends).

    df has its blocks numbered. A null counts as 0. The sums of blocks are partial sums before the shuffle.
    """
    key = ["image_id", across, BLOCK]
    inside = Window.partitionBy(*key).orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0.0)
    ends = {"__first": F.col(along) == 0, "__last": F.col(along) == F.col(size) - 1}
    parts = [F.sum(F.coalesce(F.col(c).cast("double"), zero)).alias(f"__all_{c}") for c in values]
    parts += [F.sum(F.when(at, F.col(c))).alias(f"{end}_{c}") for end, at in ends.items() for c in values]
    line = Window.partitionBy("image_id", across)
    before = line.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*key).agg(*parts).select(
        *key,
        *(F.coalesce(F.sum(f"__all_{c}").over(before), zero).alias(f"__start_{c}") for c in values),
        *(F.sum(f"{name}_{c}").over(line).alias(f"{name}_{c}") for name in ("__all", *ends) for c in values),
    )
    own = df.withColumns({f"__sum_{c}": F.sum(F.coalesce(F.col(c).cast("double"), zero)).over(inside) for c in values})
    own = own.join(starts, key)
    return own.withColumns({f"__sum_{c}": F.col(f"__start_{c}") + F.col(f"__sum_{c}") for c in values}).drop(*(f"__start_{c}" for c in values))


def carry_axis(df: DataFrame, values: list[str], radius: int, along: str, across: str, size: str, block: int) -> DataFrame:
    """As margin_axis, for a radius of any size. Reads df twice."""
    kept = df.columns
    sums = running_sums(with_blocks(df, along, block), values, along, across, size)
    r, at, last = F.least(F.lit(radius), F.col(size) - 1), F.col(along), F.col(size) - 1
    # A running sum goes to the pixel that it precedes (0) and to the one whose frame it ends (1), each pixel to itself (2).
    places = F.array(F.struct((at + r + 1).alias("at"), F.lit(0).alias("role")), F.struct((at - r).alias("at"), F.lit(1).alias("role")), F.struct(at.alias("at"), F.lit(2).alias("role")))
    sent = sums.withColumn("__to", F.explode(F.filter(places, lambda p: (p["at"] >= 0) & (p["at"] <= last))))
    own = F.col("__to.role") == 2
    line = ["image_id", across, size]
    wide = [c for c in sums.columns if c not in (*line, along, BLOCK) and not c.startswith("__sum_")]
    sent = sent.select(
        *line,
        F.col("__to.at").cast(df.schema[along].dataType).alias(along),
        F.col("__to.role").alias("__role"),
        *(F.when(own, F.col(c)).alias(c) for c in wide),
        *(f"__sum_{c}" for c in values),
    )
    sent = with_blocks(sent, along, block)
    beside = Window.partitionBy("image_id", across, BLOCK).orderBy(along, "__role")
    preceded, followed = at - r - 1 >= 0, at + r <= last

    def mean(c: str) -> Column:
        one, two = F.lag(f"__sum_{c}", 1).over(beside), F.lag(f"__sum_{c}", 2).over(beside)
        upper = F.when(followed, one).otherwise(F.col(f"__all_{c}"))
        lower = F.when(~preceded, F.lit(0.0)).when(followed, two).otherwise(one)
        before, after = F.greatest(F.lit(0), r - at).cast("double"), F.greatest(F.lit(0), at + r - last).cast("double")
        return (upper - lower + before * F.col(f"__first_{c}") + after * F.col(f"__last_{c}")) / (2 * r + 1).cast("double")

    out = sent.withColumns({f"__mean_{c}": mean(c) for c in values}).where("__role = 2")
    return out.select(*(F.col(f"__mean_{c}").alias(c) if c in values else F.col(c) for c in kept))


def box(df: DataFrame, values: list[str], radius: int, passes: int, along: str, across: str, size: str, block: int) -> DataFrame:
    """passes of means along an axis; the pixels of a line are together only by blocks. With a radius beyond a block, each pass is written first."""
    if block < 1:
        raise ValueError("a block holds one pixel at least")
    for _ in range(passes):
        if radius <= block:
            df = margin_axis(df, values, radius, along, across, size, block)
        else:
            df = carry_axis(tables.written(df), values, radius, along, across, size, block)
    return df
