from pyspark.sql import functions as F

from rasterloom.operators import resample


def test_both_axes_in_blocks_of_bounded_size(spark, tmp_path):
    """A long field is dealt out by blocks in one exchange, in more partitions if it is read from larger files; values are those of tiles as arrays."""
    px = spark.range(900 * 3).select(F.lit(0).cast("long").alias("image_id"), F.lit(900).alias("h"), F.lit(3).alias("w"), (F.col("id") / 3).cast("int").alias("y"), (F.col("id") % 3).cast("int").alias("x"), F.rand(5).alias("v"))
    px.write.parquet(str(tmp_path / "px"))
    px = spark.read.parquet(str(tmp_path / "px")).withColumn("image_id", F.lit(0).cast("long"))
    got = resample.resize(px, ["v"], F.col("w") * 2, F.col("h") * 2)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = resample.enlarge(px, ["v"], 2.0).withColumnRenamed("v", "want")
    both = got.join(want, ["image_id", "h", "w", "y", "x"])
    assert both.count() == got.count() == 900 * 3 * 4
    assert both.where(F.abs(F.col("v") - F.col("want")) > 1e-9).count() == 0
