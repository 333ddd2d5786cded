"""Images and fields derived from tables: relations of pixels (image_id, h, w, y, x, channels)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Side of the images made from parts.
SIDE = 8


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder of spark.checkpoint.dir (a new local one where that is unset).

    For what a plan reads several times: it is worked out once, and the loss of executors doesn't lose it.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    path = f"{spark.conf.get('spark.checkpoint.dir')}/pixels-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of written tables from which nothing is read any more (of others: nothing)."""
    for df in tables:
        if hasattr(df, "written_to"):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def embedding_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One grey field: a row for each vector in the order of vec_id (0, 1, ...), a column for each component, value clipped to 0..1."""
    e = read(spark, sf_dir, "embeddings")
    v = e.select(F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "v"))
    size = F.broadcast(e.agg((F.max("vec_id") + 1).cast("int").alias("h"), F.max(F.size("embedding")).alias("w")))
    v = v.join(size)  # one row: the size of the field
    return v.select(F.lit(0).cast("long").alias("image_id"), "h", "w", "y", "x", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("v").cast("double") + 0.5)).alias("v"))


EMBEDDING_FIELD = """
SELECT CAST(0 AS BIGINT) AS image_id, (SELECT CAST(max(vec_id) + 1 AS INT) FROM embeddings) AS h, 64 AS w, CAST(vec_id AS INT) AS y, CAST(x AS INT) AS x,
  GREATEST(0e0, LEAST(1e0, CAST(v AS DOUBLE) + 0.5e0)) AS v
FROM (SELECT vec_id, UNNEST(range(0, 64)) AS x, UNNEST(embedding) AS v FROM embeddings)"""


def _parts_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts dealt out by key, in as many partitions as shuffles have.

    The number is given: parts are few bytes before they become pixels, so that adaptive execution would join their partitions into one or two tasks.
    """
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice").repartition(n, "p_partkey")


def part_images(spark: SparkSession, sf_dir: str, side: int = SIDE) -> DataFrame:
    """A small RGB image with alpha for each part: ramps and waves whose phases come from the part's columns."""
    # Parts are dealt out by their key before they become pixels, so that all pixels of an image lie together.
    p = _parts_by_key(spark, sf_dir)
    at = F.sequence(F.lit(0), F.lit(side - 1))
    p = p.withColumn("y", F.explode(at)).withColumn("x", F.explode(at))
    k, s, c = F.col("p_partkey") % 17, F.col("p_size").cast("double"), F.col("p_retailprice") / 2500.0
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    n = F.lit(float(side - 1))
    clip = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return p.select(
        F.col("p_partkey").alias("image_id"),
        F.lit(side).alias("h"),
        F.lit(side).alias("w"),
        "y",
        "x",
        clip(x / n * 0.8 + 0.02 * k.cast("double")).alias("r"),
        clip(0.5 + 0.4 * F.sin((x * y + s) / 9.0)).alias("g"),
        clip(c * 0.6 + 0.3 * F.cos((x + y + s) / 5.0)).alias("b"),
        clip((x + y) / (2.0 * n)).alias("a"),
    )


def part_rows(spark: SparkSession, sf_dir: str, side: int = SIDE) -> DataFrame:
    """The images of part_images as rows (image_id, h, w, r, g, b, a): an array for each channel, row by row."""
    n, at = float(side - 1), F.sequence(F.lit(0), F.lit(side * side - 1))
    p = _parts_by_key(spark, sf_dir)
    k, s, c = F.col("p_partkey") % 17, F.col("p_size").cast("double"), F.col("p_retailprice") / 2500.0
    clip = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))

    def channel(value):
        return F.transform(at, lambda i: clip(value(F.floor(i / side).cast("double"), (i % side).cast("double"))))

    return p.select(
        F.col("p_partkey").alias("image_id"),
        F.lit(side).alias("h"),
        F.lit(side).alias("w"),
        channel(lambda y, x: x / n * 0.8 + 0.02 * k.cast("double")).alias("r"),
        channel(lambda y, x: 0.5 + 0.4 * F.sin((x * y + s) / 9.0)).alias("g"),
        channel(lambda y, x: c * 0.6 + 0.3 * F.cos((x + y + s) / 5.0)).alias("b"),
        channel(lambda y, x: (x + y) / (2.0 * n)).alias("a"),
    )


PART_IMAGES = f"""
SELECT p_partkey AS image_id, {SIDE} AS h, {SIDE} AS w, CAST(y AS INT) AS y, CAST(x AS INT) AS x,
  GREATEST(0e0, LEAST(1e0, x / {SIDE - 1}e0 * 0.8e0 + 0.02e0 * CAST(p_partkey % 17 AS DOUBLE))) AS r,
  GREATEST(0e0, LEAST(1e0, 0.5e0 + 0.4e0 * SIN((x * y + CAST(p_size AS DOUBLE)) / 9e0))) AS g,
  GREATEST(0e0, LEAST(1e0, p_retailprice / 2500e0 * 0.6e0 + 0.3e0 * COS((x + y + CAST(p_size AS DOUBLE)) / 5e0))) AS b,
  GREATEST(0e0, LEAST(1e0, (x + y) / {2 * (SIDE - 1)}e0)) AS a
FROM (SELECT *, CAST(i // {SIDE} AS DOUBLE) AS y, CAST(i % {SIDE} AS DOUBLE) AS x FROM part, range(0, {SIDE * SIDE}) t(i))"""


def event_raster(spark: SparkSession, sf_dir: str, side: int = 64) -> DataFrame:
    """A raster of events: row by event id, column by user, value the share of the greatest count."""
    e = read(spark, sf_dir, "events")
    c = e.groupBy((F.col("event_id") % side).cast("int").alias("y"), (F.col("user_id") % side).cast("int").alias("x")).agg(F.avg("value").alias("v"))
    return c.select(F.lit(0).cast("long").alias("image_id"), F.lit(side).alias("h"), F.lit(side).alias("w"), "y", "x", "v")


EVENT_RASTER = """
SELECT CAST(0 AS BIGINT) AS image_id, 64 AS h, 64 AS w, CAST(event_id % 64 AS INT) AS y, CAST(user_id % 64 AS INT) AS x, avg(value) AS v
FROM events GROUP BY event_id % 64, user_id % 64"""


def event_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line of all events in the order of event_id (0, 1, ...): an image of height 1."""
    e = read(spark, sf_dir, "events").select(F.col("event_id").cast("int").alias("x"), F.col("value").alias("v"))
    size = F.broadcast(e.agg((F.max("x") + 1).alias("w")))
    return e.join(size).select(F.lit(0).cast("long").alias("image_id"), F.lit(1).alias("h"), "w", F.lit(0).alias("y"), "x", "v")


EVENT_LINE = """
SELECT CAST(0 AS BIGINT) AS image_id, 1 AS h, (SELECT CAST(max(event_id) + 1 AS INT) FROM events) AS w, 0 AS y, CAST(event_id AS INT) AS x, value AS v
FROM events"""


def synthetic(spark: SparkSession, size: int) -> DataFrame:
    """A generated image: ramps, a product of waves and a checker of 5 pixels; no input is read."""
    s = spark.range(size * size).select((F.col("id") / size).cast("int").alias("y"), (F.col("id") % size).cast("int").alias("x"))
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    n = F.lit(float(max(1, size - 1)))
    checker = F.pmod(F.floor(x / 5) + F.floor(y / 5), F.lit(2)).cast("double")
    return s.select(F.lit(0).cast("long").alias("image_id"), F.lit(size).alias("h"), F.lit(size).alias("w"), "y", "x", (x / n).alias("r"), (0.5 + 0.5 * F.sin(x / 7.0) * F.cos(y / 9.0)).alias("g"), (0.7 * y / n + 0.3 * checker).alias("b"))
