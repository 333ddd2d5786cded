"""python -m rasterloom.cli upscale|batch|capabilities|models|benchmark: exit codes 0 done, 1 some failed, 2 wrong settings."""

from __future__ import annotations

import argparse
import json
import statistics
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators import models
from rasterloom.plans import config
from rasterloom.plans.pipeline import BACKENDS, PRESETS, Options, enhance
from rasterloom.sources import images, tables
from rasterloom.streaming import jobs


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rasterloom")
    p.add_argument("--config")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("upscale", "batch"):
        c = sub.add_parser(name)
        c.add_argument("inputs", nargs="+")
        c.add_argument("--out", required=True)
        c.add_argument("--suffix", default="_upscaled")
        c.add_argument("--overwrite", action="store_true")
        for flag, kind in (("scale", float), ("width", int), ("height", int), ("longest-side", int), ("backend", str), ("detail", float), ("sharpen", float), ("denoise", float), ("gamma", float), ("contrast", float), ("saturation", float)):
            c.add_argument(f"--{flag}", type=kind)
    sub.add_parser("capabilities")
    c = sub.add_parser("models")
    c.add_argument("action", choices=("list", "usage"))
    c.add_argument("--folder", required=True)
    c.add_argument("--json", action="store_true")
    c = sub.add_parser("benchmark")
    c.add_argument("--size", type=int, default=256)
    c.add_argument("--scale", type=float, default=2.0)
    c.add_argument("--repeat", type=int, default=3)
    return p


def batch(spark: SparkSession, inputs: list[str], out: str, opts: Options, suffix: str, overwrite: bool) -> dict[str, int]:
    """Totals by status: all inputs enhanced to PNG files in out; what is there is skipped, what can't be read is an error."""
    files = spark.read.format("binaryFile").load(inputs)
    probed = images.probe(files).select("path", "error")
    name = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    plan = probed.withColumn("target", F.concat(F.lit(f"{out}/"), name, F.lit(f"{suffix}.png")))
    there = spark.read.format("binaryFile").load(out).select(images.plain_path("path").alias("path")) if not overwrite else plan.select("path").limit(0)
    plan = images.batch_plan(plan, there).withColumn("status", F.when(F.col("error").isNotNull(), "error").otherwise(F.col("status"))).persist()
    todo = plan.where("status = 'pending'").select(F.xxhash64(images.plain_path("path")).alias("image_id"), F.regexp_extract("target", r"([^/]+)\.png$", 1).alias("name"))
    px = images.load(spark, inputs).drop("path").join(todo.select("image_id"), "image_id", "left_semi")
    has_alpha = bool(px.where("a is not null").limit(1).count())
    made = images.encode_png(enhance(px.withColumn("a", F.coalesce("a", F.lit(1.0))) if has_alpha else px.drop("a"), opts))
    # A file whose header was fine but whose pixels can't be decoded has no output: that is an error too.
    names = tables.written(images.save_files(made.join(todo, "image_id"), out, "name")).withColumn("made", F.lit(True))
    done = plan.withColumn("name", F.regexp_extract("target", r"([^/]+)\.png$", 1)).join(names, "name", "left")
    done = done.withColumn("status", F.when(F.col("status") != "pending", F.col("status")).when(F.col("made"), "ok").otherwise("error"))
    totals = {r.status: r.n for r in jobs.batch_report(done).collect()}  # at most three rows
    plan.unpersist()  # else another batch on the same folders would see this one's files
    return totals


def capabilities() -> dict:
    try:
        import onnxruntime

        providers = onnxruntime.get_available_providers()
    except ImportError:
        providers = []
    return {"backends": sorted(BACKENDS), "providers": providers, "presets": sorted(PRESETS), "aliases": models.PROVIDERS}


def model_list(spark: SparkSession, folder: str) -> list[dict]:
    """The catalogue in the order of names, with the files in folder that each model has, and whether there is any."""
    found = models.presence(models.catalogue(spark), _files(spark, folder))
    found = found.withColumn("present", F.col("onnx").isNotNull() | F.col("weights").isNotNull())
    return [r.asDict() for r in found.orderBy("name").collect()]  # as many rows as the catalogue has


def model_usage(spark: SparkSession, folder: str) -> dict:
    return models.disk_usage(_files(spark, folder)).first().asDict()


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of all files below folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")


def benchmark(spark: SparkSession, size: int, scale: float, repeat: int) -> dict:
    took = []
    for _ in range(repeat):
        began = time.time()
        enhance(tables.synthetic(spark, size), Options(scale=scale)).write.format("noop").mode("overwrite").save()
        took.append(time.time() - began)
    median = statistics.median(took)
    return {"size": size, "scale": scale, "median_ms": round(median * 1000, 1), "least_ms": round(min(took) * 1000, 1), "source_mp_s": round(size * size / 1e6 / median, 3)}


def main(argv: list[str] | None = None) -> int:
    ns = parser().parse_args(argv)
    if ns.command == "capabilities":
        print(json.dumps(capabilities()))
        return 0
    try:
        flags = {k: v for k, v in vars(ns).items() if k in Options.__dataclass_fields__}
        opts = config.load(ns.config, **flags)
    except config.ConfigError as e:
        print(e, file=sys.stderr)
        return 2
    spark = SparkSession.builder.getOrCreate()
    if ns.command == "models":
        if ns.action == "usage":
            print(json.dumps(model_usage(spark, ns.folder)))
            return 0
        rows = model_list(spark, ns.folder)
        print(json.dumps(rows, indent=2) if ns.json else "\n".join(f"[{'x' if r['present'] else ' '}] {r['name']:<20} x{r['scale']} {r['arch']}" for r in rows))
        return 0
    if ns.command == "benchmark":
        print(json.dumps(benchmark(spark, ns.size, ns.scale, ns.repeat)))
        return 0
    totals = batch(spark, ns.inputs, ns.out, opts, ns.suffix, ns.overwrite)
    print(json.dumps(totals))
    return int("error" in totals)


if __name__ == "__main__":
    sys.exit(main())
