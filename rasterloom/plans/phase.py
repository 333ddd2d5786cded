"""The phase method: split into bands, transport their phasors, add up, keep the topology, and carry chroma along."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.color import clip01, rgb_to_ycbcr, ycbcr_to_rgb
from rasterloom.operators import neighbourhood, phasors, resample, spectral, tilework, topology, transport
from rasterloom.sources.tables import written

#: Pixels of the sources of a stack; some fifty arrays of their and of the results' size are held.
_MOST = 1 << 15
_SIGNATURE = "struct<peaks: bigint, pits: bigint, total: bigint, spectrum: array<double>, sum_persistence: double>"


def plan(h: int, w: int, scale: float, max_pixels: int = 0) -> tuple[int, int]:
    """Output size; refuses scales below 1 and outputs over max_pixels (0: no bound)."""
    if scale < 1:
        raise ValueError("the phase method only enlarges")
    oh, ow = max(1, round(h * scale)), max(1, round(w * scale))
    if max_pixels and oh * ow > max_pixels:
        raise ValueError(f"{ow} x {oh} is more than {max_pixels} pixels")
    return oh, ow


def analyse(field: DataFrame, value: str = "v", bands: int = 3) -> DataFrame:
    """Bands with theta, r, amp, phi, gx, gy; the low pass stays in as band -1."""
    parts = written(spectral.decompose(field, value, bands))
    theta = transport.orientation(parts.where("band >= 0")).select("image_id", "y", "x", "theta")
    return spectral.phase_gradient(transport.amplitude_phase(parts.join(theta, ["image_id", "y", "x"])))


@dataclass
class Run:
    """The tables of a run: the source field, its analysed bands, the field assembled of them, a plain enlargement, and the result.

    suppressed and restored hold the peaks that were dealt with and tau the threshold of each image; they are None without topology.
    """

    field: DataFrame
    parts: DataFrame
    assembled: DataFrame
    plain: DataFrame
    out: DataFrame
    scale: float
    bands: int
    tau: DataFrame | None = None
    suppressed: DataFrame | None = None
    restored: DataFrame | None = None


def _bounded(field: DataFrame, scale: float, max_pixels: int) -> DataFrame:
    """The same, with an error for fields that would have more than max_pixels (0: no bound)."""
    if scale < 1:
        raise ValueError("the phase method only enlarges")
    if not max_pixels:
        return field
    many = F.greatest(F.lit(1), F.rint(F.col("h") * scale)) * F.greatest(F.lit(1), F.rint(F.col("w") * scale)) > max_pixels
    return field.withColumn("w", F.when(many, F.raise_error(F.format_string(f"%d x %d enlarged {scale} times has more than {max_pixels} pixels", "h", "w")).cast("int")).otherwise(F.col("w")))


def _rows(field: DataFrame, scale: float, max_pixels: int) -> DataFrame:
    """Images as rows, bounded by what isn't pooled: larger ones are relations of pixels."""
    return _bounded(field, scale, min(max_pixels or topology.MOST, topology.MOST))


def reconstruct(field: DataFrame, scale: float, value: str = "v", bands: int = 3, relative: float = 0.18, keep_topology: bool = True, max_pixels: int = 0) -> Run:
    """The run of a grey field (value) to scale times its size. Fields that would have more than max_pixels (0: no bound) raise an error."""
    field = _bounded(field, scale, max_pixels)
    field = field.select("image_id", "h", "w", "y", "x", F.col(value).alias("v"))
    parts = written(analyse(field, "v", bands))
    moved = transport.transport(parts.where("band >= 0"), scale).groupBy("image_id", "h", "w", "y", "x").agg(F.sum("v").alias("detail"))
    low = resample.enlarge(parts.where("band = -1").select("image_id", "h", "w", "y", "x", F.col("b").alias("low")), ["low"], scale)
    out = low.join(moved.drop("h", "w"), ["image_id", "y", "x"]).select("image_id", "h", "w", "y", "x", (F.col("low") + F.col("detail")).alias("v"))
    plain = resample.enlarge(field, ["v"], scale)
    if not keep_topology:
        return Run(field, parts, out, plain, out, scale, bands)
    plain, assembled, tau = written(plain), written(out), written(topology.persistence_threshold(field, "v", relative))
    suppressed = written(topology.spurious(assembled, plain, "v", tau))
    kept = written(topology.suppress(assembled, plain, "v", tau, points=suppressed))
    peaks = topology.significant(topology.extrema(field, "v"), tau).select("image_id", ((F.col("y") + 0.5) * scale - 0.5).alias("y"), ((F.col("x") + 0.5) * scale - 0.5).alias("x"), "value", "factor")
    peaks = written(peaks)
    restored = written(topology.lost(kept, peaks, "v", tau))
    return Run(field, parts, assembled, plain, topology.restore(kept, peaks, "v", tau, points=restored), scale, bands, tau, suppressed, restored)


def enlarge(field: DataFrame, scale: float, value: str = "v", bands: int = 3, relative: float = 0.18, keep_topology: bool = True, max_pixels: int = 0) -> DataFrame:
    """(image_id, h, w, y, x, v): a grey field at scale times its size, as reconstruct says. Fields that are rows of arrays are worked on where they lie."""
    if tilework.by_rows(field):
        change = lambda v: phasors.reconstructed(v[0], scale, bands, relative, keep_topology)["out"][None]
        d = _rows(field, scale, max_pixels).select("image_id", "h", "w", F.col(value).alias("v"))
        return tilework.as_pixels(tilework.changed(d, ["v"], change, most=_MOST), ["v"])
    return reconstruct(field, scale, value, bands, relative, keep_topology, max_pixels).out


def _signatures(field: DataFrame, tau: DataFrame, name: str) -> DataFrame:
    points = topology.extrema(field, "v").unionByName(topology.extrema(field, "v", "pit"))
    found = topology.signature(topology.significant(points, tau))
    return found.select("image_id", F.struct("peaks", "pits", "total", "spectrum", "sum_persistence").alias(name))


def report(run: Run) -> DataFrame:
    """One row for each image of a run, from the tables that the run has written.

    image_id, scale, bands, h, w and out_h, out_w (sizes), mean_coherence, residual_energy (mean absolute difference of the assembled field to the plain
    enlargement) and, with topology (else null): tau, baseline and candidate (signatures of the plain enlargement and of the result above tau, of zeros where nothing is
    above it), matches (whether the result's sum of persistences, to six places, keeps within the baseline's budget), suppressed_peaks, restored_peaks and
    suppressed_energy (mean absolute difference of the assembled field to the result). The tau of a flat image is 0, so that the signatures count the
    rounding errors of its values.
    """
    at, key = ["image_id", "y", "x"], "image_id"
    sizes = run.field.select(key, "h", "w").distinct().withColumns({"scale": F.lit(float(run.scale)), "bands": F.lit(run.bands)})
    coherent = transport.coherence(run.parts.where("band >= 0")).groupBy(key).agg(F.avg("kappa").alias("mean_coherence"))
    fields = run.assembled.select(*at, F.col("h").alias("out_h"), F.col("w").alias("out_w"), "v").join(run.plain.select(*at, F.col("v").alias("p")), at)
    if run.tau is not None:
        fields = fields.join(run.out.select(*at, F.col("v").alias("o")), at)
    off = lambda c: F.avg(F.abs(F.col("v") - F.col(c)))
    energy = fields.groupBy(key, "out_h", "out_w").agg(off("p").alias("residual_energy"), (off("o") if run.tau is not None else F.lit(None).cast("double")).alias("suppressed_energy"))
    d = sizes.join(coherent, key, "left").join(energy, key, "left")
    none = F.struct(*(F.lit(0).cast("long").alias(c) for c in ("peaks", "pits", "total")), F.array().cast("array<double>").alias("spectrum"), F.lit(0.0).alias("sum_persistence"))
    if run.tau is None:
        nothing = {"tau": "double", "baseline": _SIGNATURE, "candidate": _SIGNATURE, "matches": "boolean", "suppressed_peaks": "long", "restored_peaks": "long"}
        return d.withColumns({c: F.lit(None).cast(t) for c, t in nothing.items()})
    d = d.join(run.tau, key, "left").join(_signatures(run.plain, run.tau, "baseline"), key, "left").join(_signatures(written(run.out), run.tau, "candidate"), key, "left")
    for name, points in (("suppressed_peaks", run.suppressed), ("restored_peaks", run.restored)):
        d = d.join(points.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    d = d.withColumns({"baseline": F.coalesce("baseline", none), "candidate": F.coalesce("candidate", none)})
    return d.withColumn("matches", topology.matches(F.round("baseline.sum_persistence", 6), F.round("candidate.sum_persistence", 6)))


def report_rows(field: DataFrame, scale: float, value: str = "v", bands: int = 3, relative: float = 0.18, max_pixels: int = 0) -> DataFrame:
    """What report says of the run, with topology, of fields that are rows of arrays, in one pass."""

    def work(ids: pa.Array, v: np.ndarray) -> pa.RecordBatch:
        v = v[0]
        run = phasors.reconstructed(v, scale, bands, relative, True)
        h, w, oh, ow = (pa.array(np.full(len(v), n, np.int32)) for n in (*v.shape[1:], *run["out"].shape[1:]))
        off = lambda c: np.abs(run["assembled"] - run[c]).mean(axis=(1, 2))
        own = [ids, h, w, oh, ow, phasors.coherence(run["parts"]).mean(axis=(1, 2)), off("plain"), off("out"), run["tau"], run["suppressed"], run["restored"]]
        for c in ("plain", "out"):
            found = phasors.signature(run[c], run["tau"])
            arrays = [pa.array(found[n], pa.list_(pa.float64()) if n == "spectrum" else None) for n in ("peaks", "pits", "total", "spectrum", "sum_persistence")]
            own.append(pa.StructArray.from_arrays(arrays, names=["peaks", "pits", "total", "spectrum", "sum_persistence"]))
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in own], names=names)

    names = ["image_id", "h", "w", "out_h", "out_w", "mean_coherence", "residual_energy", "suppressed_energy", "tau", "suppressed_peaks", "restored_peaks", "baseline", "candidate"]
    kinds = [tilework.schema_of(field, ["image_id"]).split(" ", 1)[1], *["int"] * 4, *["double"] * 4, "bigint", "bigint", _SIGNATURE, _SIGNATURE]
    d = _rows(field, scale, max_pixels).select("image_id", "h", "w", F.col(value).alias("v"))
    d = tilework.of_rows(d, ["v"], work, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)), _MOST)
    d = d.withColumns({"scale": F.lit(float(scale)), "bands": F.lit(bands)})
    return d.withColumn("matches", topology.matches(F.round("baseline.sum_persistence", 6), F.round("candidate.sum_persistence", 6)))


def enlarge_rgb(px: DataFrame, scale: float, chroma_detail: float = 0.25, chroma_guided: bool = True, **options) -> DataFrame:
    """r, g, b at scale times the size: luma by enlarge, chroma by Lanczos plus the part of luma's residual that chroma follows.

    The gate of that part is the cosine between the gradients of luma and chroma times their ratio, both within 0..1; guided, it is smoothed along the
    dominant orientation of the luma's bands, so that it follows contours. Images that are rows of arrays are worked on where they lie.
    """
    if tilework.by_rows(px):
        options = {"bands": 3, "relative": 0.18, "keep_topology": True} | options
        d = _rows(px, scale, options.pop("max_pixels", 0)).select("image_id", "h", "w", "r", "g", "b")
        change = lambda v: phasors.enlarged_rgb(v, scale, chroma_detail, chroma_guided, **options)
        return tilework.as_pixels(tilework.changed(d, ["r", "g", "b"], change, most=_MOST), ["r", "g", "b"])
    ycc = rgb_to_ycbcr(px.select("image_id", "h", "w", "y", "x", "r", "g", "b"))
    run = reconstruct(ycc, scale, "luma", **options)
    luma = written(run.out).withColumnRenamed("v", "luma")
    names = ["image_id", "y", "x"]
    d = neighbourhood.gradient(ycc, "luma").withColumnsRenamed({"gx": "lx", "gy": "ly", "magnitude": "lm"})
    for c in ("cb", "cr"):
        d = neighbourhood.gradient(d, c)
        cos = (F.col("gx") * F.col("lx") + F.col("gy") * F.col("ly")) / F.greatest(F.col("magnitude") * F.col("lm"), F.lit(1e-8))
        d = d.withColumn(f"gate_{c}", clip01(cos) * clip01(F.col("magnitude") / F.greatest("lm", F.lit(1e-8)))).drop("gx", "gy", "magnitude")
    if chroma_guided:
        theta = transport.dominant_orientation(run.parts.where("band >= 0")).select(*names, "theta")
        d = written(d.join(theta, names))
        for c in ("cb", "cr"):
            d = neighbourhood.orient_smooth(d, f"gate_{c}", "theta", 2).drop(f"gate_{c}").withColumnRenamed("smooth", f"gate_{c}")
    d = resample.enlarge(d.withColumn("plain", F.col("luma")), ["cb", "cr", "plain", "gate_cb", "gate_cr"], scale)
    d = d.join(luma.select(*names, "luma"), names)
    residual = F.col("luma") - F.col("plain")
    d = d.withColumns({c: F.col(c) + chroma_detail * residual * clip01(F.col(f"gate_{c}")) for c in ("cb", "cr")})
    out = ycbcr_to_rgb(d.drop("plain", "gate_cb", "gate_cr"))
    return out.withColumns({c: clip01(F.col(c)) for c in ("r", "g", "b")})
