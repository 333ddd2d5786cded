"""Percentiles of very many values: a histogram of fixed size for each group, then exact selection inside the bins that hold the ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 4096


def percentiles(df: DataFrame, value: str, at: dict[str, float], group: str = "image_id") -> DataFrame:
    """(group, a column for each name of at): percentiles, interpolated between the two nearest ranks. Null and NaN values take no part.

    Counts are summed before each shuffle: first of the bins between a group's least and greatest value, then of the different values
    in the bins that hold a rank. So no task holds more of a group than its bins and, sorted on disk if need be, one bin's values.
    """
    v = F.col(value).cast("double")
    d = df.select(F.col(group).alias("__k"), v.alias("v")).where(v.isNotNull() & ~F.isnan(v))
    span = d.groupBy("__k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    step = lambda: F.when(F.col("hi") > F.col("lo"), F.least(F.lit(BINS - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS).cast("int"))).otherwise(0)
    binned = d.join(span, "__k").select("__k", "n", step().alias("bin"), "v")
    counts = binned.groupBy("__k", "n", "bin").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("__k").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    # Ranks from 0: the two nearest to each place.
    places = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), (F.lit(q) * (F.col("n") - 1)).alias("place"), r(F.lit(q) * (F.col("n") - 1)).cast("long").alias("rank")) for k, q in at.items() for r in (F.floor, F.ceil))))
    ranks = counts.withColumn("upto", upto).withColumn("p", places).where((F.col("p.rank") < F.col("upto")) & (F.col("p.rank") >= F.col("upto") - F.col("c")))
    ranks = ranks.select("__k", "bin", F.col("p.name").alias("name"), F.col("p.place").alias("place"), F.col("p.rank").alias("rank"), (F.col("p.rank") - F.col("upto") + F.col("c")).alias("inside"))
    # A bin may hold several ranks; its values are counted once.
    wanted = ranks.select("__k", "bin").distinct()
    values = binned.join(wanted, ["__k", "bin"]).groupBy("__k", "bin", "v").agg(F.count("*").alias("c"))
    values = values.withColumn("upto", F.sum("c").over(Window.partitionBy("__k", "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    found = ranks.join(values, ["__k", "bin"]).where((F.col("inside") < F.col("upto")) & (F.col("inside") >= F.col("upto") - F.col("c")))
    # A place on a rank has the same rank twice.
    low = found.groupBy("__k", "name").agg(F.min_by("v", "rank").alias("a"), F.max_by("v", "rank").alias("b"), F.max(F.col("place") - F.floor("place")).alias("t"))
    low = low.withColumn("v", F.col("a") + (F.col("b") - F.col("a")) * F.col("t"))
    return low.groupBy(F.col("__k").alias(group)).agg(*(F.max(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in at))
